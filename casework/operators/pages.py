"""Field extraction from saved case pages.

The original drives a browser page by page; the data work is reading a few
fields out of each page. Here a page is a row ``(key, html)``. Elements, rows
and nested tables need a parser, so one narrow stage over Arrow batches reads
each page once, in time that follows its length, and returns the few fields
it holds; the name patterns over the raw page and all rules on the fields are
column expressions. Nothing is shuffled.

Java regexes recurse on repeated groups; the judge patterns are evaluated in
their possessive form (same matches, nothing follows the repeated group and
the repeated classes are disjoint), which keeps very long pages from
overflowing the stack.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casework import constants as K
from casework.functions import text as X
from casework.session import ship_package

# Elements without content, and those whose text nobody sees.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset(("script", "style", "template", "noscript"))
# Elements whose content is text up to their end tag, tags and all; in the
# last two, character references count.
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A) for tag in ("script", "style", "xmp", "iframe", "noembed", "noframes", "textarea", "title")}
REFERENCES = frozenset(("textarea", "title"))
# Elements that stand on lines of their own.
BLOCKS = frozenset("address article div dl dd dt fieldset form h1 h2 h3 h4 h5 h6 hr li ol p section table tbody td th thead tr ul br".split())

CELLS = ("tr", "td", "th")

# Text and the tag behind it. Quotes count behind an equals sign only, and what is once
# matched is never tried another way, so a tag costs its length.
_TAG = re.compile(r"""([^<]*+)<(/?)([a-zA-Z][^\t\n\r\f />]*+)((?:[^>=]++|=[\t\n\r\f ]*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_COMMENT_BEGUN = re.compile(r"-?>")
_COMMENT_END = re.compile(r"--!?>")


def _ident(attributes: str) -> str | None:
    """The element's id; the first one counts."""
    if "id" not in attributes.lower():
        return None
    return _read_ident(attributes) if len(attributes) < 100 else _read_ident.__wrapped__(attributes)


@lru_cache(maxsize=1000)
def _read_ident(attributes: str) -> str | None:
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() == "id":
            return unescape(m[2] or m[3] or m[4] or "")
    return None


class _Cell:
    """A table cell: where its text begins and ends, the number of the cell
    after it in its row, and whether it lies in the table of parties."""

    __slots__ = ("begin", "end", "follows", "parties")

    def __init__(self, begin: int, parties: bool):
        self.begin, self.end, self.follows, self.parties = begin, begin, None, parties


class CasePage:
    """One pass over a page: its text, and as ranges of it the judge's span
    and the table cells in the order they begin.

    The text is kept once. An element is two places in it, so open elements cost
    nothing as text goes by; open elements are found by tag and counted by id, not
    searched. A tag that the page does not finish ends the page, as in a browser.
    """

    def __init__(self, page: str) -> None:
        self._parts: list[str] = []
        self._size = 0
        # Open elements: tag, id, cell, whether it holds the judge's name.
        self._open: list[tuple[str, str | None, _Cell | None, bool]] = [("", None, None, False)]
        self._by_tag: dict[str, list[int]] = defaultdict(list)
        self._by_ident: Counter[str] = Counter()
        # The last cell of each open row or table, and outside of all.
        self._last: list[_Cell | None] = [None]
        self._unseen = 0
        self._judge: list[int] | None = None
        self.cells: list[_Cell] = []
        self._read(page)
        self._cut(1)
        self.text = "".join(self._parts)
        self.judge = self.text[slice(*self._judge)] if self._judge else ""

    def _read(self, page: str) -> None:
        match, by_tag, size, at = _TAG.match, self._by_tag, len(page), 0
        while at < size:
            found = match(page, at)
            if found is None:
                mark = page.find("<", at)
                if mark != at:
                    self._say(page[at:mark] if mark >= 0 else page[at:])
                if mark < 0:
                    return
                at = self._other(page, mark)
                continue
            at = found.end()
            text, slash, name, attributes = found.groups()
            if text:
                self._say(text)
            name = name.lower()
            if slash:
                places = by_tag.get(name)
                if places and (name not in CELLS or places[-1] > self._floor()):
                    self._cut(places[-1])
                continue
            self._start(name, attributes)
            if name in RAW:
                end = RAW[name].search(page, at)
                stop = end.start() if end else size
                self._say(page[at:stop], name in REFERENCES)
                at = stop

    def _other(self, page: str, mark: int) -> int:
        """Where a ``<`` that begins no whole tag leaves off: a comment, a tag that the page does not finish, or text."""
        begin, after = page[mark + 1:mark + 2], page[mark + 2:mark + 3]
        if page.startswith("<!--", mark):
            # <!--> and <!---> are whole comments.
            end = _COMMENT_BEGUN.match(page, mark + 4) or _COMMENT_END.search(page, mark + 4)
            return end.end() if end else len(page)
        if begin.isascii() and begin.isalpha() or begin == "/" and after.isascii() and after.isalpha():
            return len(page)
        if begin in ("!", "?") or begin == "/" and after:
            return page.find(">", mark) + 1 or len(page)
        self._say("<")
        return mark + 1

    def _say(self, text: str, references: bool = True) -> None:
        if not self._unseen:
            if references and "&" in text:
                text = unescape(text)
            self._parts.append(text)
            self._size += len(text)

    def _start(self, tag: str, attributes: str) -> None:
        by_tag, cell, is_judge = self._by_tag, None, False
        if tag in CELLS:
            # A cell or row that was not closed ends where the next begins.
            floor = self._floor()
            ended = [p[bisect_right(p, floor)] for p in map(by_tag.get, CELLS if tag == "tr" else CELLS[1:]) if p and p[-1] > floor]
            if ended:
                self._cut(min(ended))
        if tag in BLOCKS and not self._unseen:
            self._parts.append("\n")
            self._size += 1
        if tag in VOID:
            return
        ident = _ident(attributes) if "d" in attributes or "D" in attributes else None
        if tag == "td":
            cell = _Cell(self._size, self._by_ident[K.PARTIES_TABLE_ID] > 0)
            if self._last[-1] is not None:
                self._last[-1].follows = cell
            self._last[-1] = cell
            self.cells.append(cell)
        elif tag == "tr" or tag == "table":
            self._last.append(None)
        elif tag == "span":
            if self._judge is None and self._by_ident[K.JUDGE_ELEMENT_ID] > 0:
                is_judge, self._judge = True, [self._size, self._size]
        elif tag in UNSEEN:
            self._unseen += 1
        by_tag[tag].append(len(self._open))
        self._open.append((tag, ident, cell, is_judge))
        if ident is not None:
            self._by_ident[ident] += 1

    def _floor(self) -> int:
        """The innermost open table: rows and cells outside it are left alone."""
        tables = self._by_tag.get("table")
        return tables[-1] if tables else 0

    def _cut(self, at: int) -> None:
        """End the open elements from ``at``."""
        opened, by_tag = self._open, self._by_tag
        while len(opened) > at:
            tag, ident, cell, is_judge = opened.pop()
            by_tag[tag].pop()
            if ident is not None:
                self._by_ident[ident] -= 1
            if cell is not None:
                cell.end = self._size
            elif tag == "tr" or tag == "table":
                self._last.pop()
            elif is_judge:
                self._judge[1] = self._size
            elif tag in UNSEEN:
                self._unseen -= 1


def _lower(text: str) -> str:
    """Lower case, place for place: the one letter that grows matches nothing."""
    return text.replace("İ", "\0").lower()


def _phrase(words: str) -> re.Pattern:
    """A phrase with any white space between its words."""
    return re.compile(r"\s+".join(map(re.escape, words.lower().split())))


_NOT_FOUND = _phrase(K.NOT_FOUND_MARKER)
_LABELS = [_phrase(label) for label in K.CLAIMANT_LABELS]
_TERMS = [re.compile(re.escape(term.lower())) for term in K.DECISION_TEXT_TERMS]


def _first_with(cells: list[_Cell], pattern: re.Pattern, lower: str) -> _Cell | None:
    """The first cell with a match inside. All places are found once, so cells
    in cells do not read the text again."""
    matches = [m.span() for m in pattern.finditer(lower)]
    if not matches:
        return None
    begins = [m[0] for m in matches]
    for cell in cells:
        i = bisect_left(begins, cell.begin)
        if i < len(matches) and matches[i][1] <= cell.end:
            return cell
    return None


def _follows(page: CasePage, lower: str) -> str | None:
    """Text of the cell after the first cell of the parties table that
    contains a label and has one after it, labels tried in order."""
    cells = [c for c in page.cells if c.parties and c.follows is not None]
    for label in _LABELS if cells else ():
        cell = _first_with(cells, label, lower)
        if cell is not None:
            return page.text[cell.follows.begin:cell.follows.end]
    return None


def _decision(page: CasePage, lower: str) -> str | None:
    """The first cell with a term, if it is long enough, terms in order."""
    for term in _TERMS if page.cells else ():
        cell = _first_with(page.cells, term, lower)
        if cell is not None:
            text = page.text[cell.begin:cell.end].strip()
            if len(text) > K.DECISION_TEXT_MIN_CHARS:
                return text
    return None


def page_values(page: str | None) -> tuple[bool | None, str, str | None, str | None]:
    """not found, judge's element ('' without), claimant's cell, decision text."""
    if page is None:
        return None, "", None, None
    parsed = CasePage(page)
    lower = _lower(parsed.text)
    return _NOT_FOUND.search(lower) is not None, parsed.judge.strip(), _follows(parsed, lower), _decision(parsed, lower)


def possessive(pattern: str) -> str:
    """Possessive form of a name pattern: ``\\s+``, ``]+``, ``]{n,}`` and a
    repeated group closing the capture become possessive."""
    return (pattern.replace(r"\s+", r"\s++").replace("]+", "]++")
            .replace("]{2,}", "]{2,}+").replace(")+)", ")++)"))


def spark_pattern(pattern: str) -> str:
    return "(?iU)" + possessive(pattern)


def with_fields(df: DataFrame, html_col: str = "html") -> DataFrame:
    """``df`` with _missing, _primary, _req and _texto read from the page."""
    fields = T.StructType([T.StructField("_missing", T.BooleanType()), *[T.StructField(c, T.StringType()) for c in ("_primary", "_req", "_texto")]])
    schema = T.StructType(df.schema.fields + fields.fields)
    at = df.columns.index(html_col)
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [page_values(page) for page in batch.column(at).to_pylist()]
            new = [pa.array([r[i] for r in rows], pa.string() if i else pa.bool_()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *fields.names])

    return df.mapInArrow(run, schema)


def _stage(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add columns in their own projection. Expressions inside conditional
    branches (``when``/``coalesce``) get no common-subexpression
    elimination, so anything referenced more than once is computed here once;
    the optimizer does not inline a non-cheap column used several times."""
    return df.withColumns(cols)


def with_judge(df: DataFrame, html_col: str = "html", out: str = "juiz",
               primary_col: str | None = None) -> DataFrame:
    """X2 then X3: the judge's element, else the pattern cascade over the raw
    page. Per pattern only its first match is tried; a candidate failing the
    name validator (F7) passes to the next pattern."""
    html = F.col(html_col)
    need = F.lit(True) if primary_col is None else F.col(primary_col) == F.lit("")
    cands = {f"_cand{i}": F.when(need, X.strip_ws(F.regexp_extract(html, spark_pattern(p), 1)))
             for i, p in enumerate(K.JUDGE_PATTERNS)}
    df = _stage(df, cands)
    chosen = F.coalesce(*[F.when(X.valid_judge_name(F.col(c)), F.col(c)) for c in cands])
    if primary_col is not None:
        chosen = F.coalesce(F.nullif(F.col(primary_col), F.lit("")), chosen)
    return df.withColumn(out, chosen).drop(*cands)


def judge_element(pages: DataFrame, key: str = "numero_processo", html_col: str = "html") -> DataFrame:
    """X2 alone: the text of the first span in the judge's element, null without."""
    return with_fields(pages.select(key, html_col), html_col).select(key, F.nullif("_primary", F.lit("")).alias("juiz"))


def extract(pages: DataFrame, key: str = "numero_processo", html_col: str = "html") -> DataFrame:
    """One record per page: judge, claimant, status, decision text.
    One narrow stage (no shuffle)."""
    df = with_fields(pages.select(key, F.col(html_col).alias("_html")), "_html")
    df = with_judge(df, "_html", "_juiz", "_primary")
    juiz, req = F.col("_juiz"), X.first_line("_req")
    complete = (F.coalesce(F.length(juiz), F.lit(0)) > 0) & (F.coalesce(F.length(req), F.lit(0)) > 0)
    status = (F.when(F.col("_html").isNull(), F.lit(K.STATUS_ERROR))
              .when(F.col("_missing"), F.lit(K.STATUS_NOT_FOUND))
              .when(complete, F.lit(K.STATUS_OK)).otherwise(F.lit(K.STATUS_INCOMPLETE)))
    df = _stage(df, {"status": status})
    found = ~F.col("status").isin(K.STATUS_ERROR, K.STATUS_NOT_FOUND)
    return df.select(
        key,
        F.when(found, juiz).alias("juiz"),
        F.when(found, req).alias("requerente"),
        "status",
        F.when(found, F.col("_texto")).alias("texto_decisao"))


def headline(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Native web pages: primary field = first ``h1`` text, fallback =
    ``title``, plus the document language."""
    html = F.col("html")
    h1 = X.strip_ws(X.html_text(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)))
    title = X.strip_ws(X.html_text(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)))
    lang = F.regexp_extract(html, r'(?is)<html\b[^>]*\blang="([^"]*)"', 1)
    use_h1 = F.length(h1) > 0
    return pages.select(
        key, "url",
        F.when(use_h1, h1).otherwise(F.nullif(title, F.lit(""))).alias("titulo"),
        F.when(use_h1, F.lit("h1")).when(F.length(title) > 0, F.lit("title")).alias("fonte"),
        F.nullif(lang, F.lit("")).alias("lang"))
