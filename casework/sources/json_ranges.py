"""Pretty-printed search responses, read by many tasks a file.

JSON strings hold no raw line break, so a range begins outside strings; what it does not
know is the containers that are open there. The first scan leaves a row for each range: how
many open containers it closes and which ones it leaves open. Composed in file order these
give every range its stack at its begin. The second scan cuts the elements of ``hits.hits`` out of
the text: whole ones go on as rows, the parts of those that cross a border are joined, and
what is left of a document (its envelope) is parsed strictly.

A file holds one response, a list of responses, or responses one after the other.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casework.sources.ranges import LAST, joined_fragments, lines, numbered, stored, texts_by_range, volumes

_STRING = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
_PLAIN = r'[^"\[\]{}]*+(?:%s[^"\[\]{}]*+)*+' % _STRING


def _whole(levels: int) -> str:
    """A container with its content, where that is no more than ``levels`` deep."""
    content = _PLAIN if not levels else f"{_PLAIN}(?:(?:{_whole(levels - 1)}){_PLAIN})*+"
    return rf"\{{{content}\}}|\[{content}\]"


# What is passed over before a bracket, and the bracket: "" at the text's end, a quote where a
# string does not end on its line. With _OVER whole containers are passed over too.
_NEXT = re.compile(rf'{_PLAIN}([\[\]{{}}"]|\Z)')
_OVER = re.compile(rf'{_PLAIN}(?:(?:{_whole(3)}){_PLAIN})*+([\[\]{{}}"]|\Z)')
_WHOLE = re.compile(_whole(3))
_STRINGS = re.compile(_STRING)
_RUN = re.compile(r"\{\}(?:\s*,\s*\{\})+")
_KEY = "hits"

# A frame of a stack: the bracket, and whether the last string before it was
# "hits" (1, 0, or ? where the range has had no string yet).
Frame = str


def _is_key(token: str) -> str:
    # Even with every letter escaped the key has no more than 26 characters.
    return "1" if token[1:-1] == _KEY or len(token) <= 26 and "\\" in token and json.loads(token) == _KEY else "0"


def _frames(text: str) -> list[Frame]:
    return [text[i:i + 2] for i in range(0, len(text), 2)]


def list_depth(stack: list[Frame]) -> int | None:
    """How many frames lead to the list of hits, where the stack lies in one."""
    base = 1 if stack[:1] and stack[0][0] == "[" else 0
    path = stack[base:base + 3]
    return base + 3 if [f[0] for f in path] == ["{", "{", "["] and path[1][1] == path[2][1] == "1" else None


def _last_string(text: str, begin: int, end: int) -> str | None:
    """The last string of a part of a text that begins and ends outside strings."""
    quote = text.rfind('"', begin, end)
    if quote < 0:
        return None
    # No string goes on over a line break.
    for m in _STRINGS.finditer(text, max(begin, text.rfind("\n", begin, quote) + 1), end):
        last = m.group()
    return last


def closed_and_opened(texts: Iterator[str]) -> tuple[int, list[Frame], str]:
    """Of a range's text: how many containers open before it closes, those that
    it leaves open, and whether its last string was "hits"."""
    closes, opened, last = 0, [], None
    for text in texts:
        at = known = 0
        while True:
            m = _OVER.match(text, at)
            c, at = m.group(1), m.end()
            if c == "{" or c == "[":
                # Containers that end in the text are mostly passed over.
                last, known = _last_string(text, known, at) or last, at
                opened.append((c, last))
            elif c == '"':
                raise ValueError("a string does not end on its line: not JSON")
            elif not c:
                last = _last_string(text, known, at) or last
                break
            elif opened:
                if opened.pop()[0] != ("[" if c == "]" else "{"):
                    raise ValueError("brackets do not match: not JSON")
            else:
                closes += 1
    # Only strings before what stays open are looked at.
    flag = lambda string: "?" if string is None else _is_key(string)
    return closes, [c + flag(string) for c, string in opened], flag(last)


class Walk:
    """A range's text from its true stack on: ``feed`` takes its parts in order."""

    def __init__(self, stack: list[Frame], last: str, origin: int, block: int):
        self.stack, self.last, self.block = list(stack), last, block
        depth = list_depth(self.stack)
        self.list_at = depth if depth == len(self.stack) else None
        self.inside = depth if depth is not None and depth < len(self.stack) else None
        self.crossing, self.origin = self.inside is not None, origin  # the open element began in an earlier range
        self.doc, self.counts = 0, {0: 0}
        self.held: list[str] = []
        self.envelope: list[str] = []
        self.fragments: list[tuple[int, int, str]] = []

    def feed(self, text: str) -> list[tuple[int, str]]:
        """(document of the range, element) of the elements that end here and began in the range."""
        whole, stack, begin, at, known = [], self.stack, 0, 0, 0
        while True:
            m = (_NEXT if self.inside is None else _OVER).match(text, at)
            c, before, at = m.group(1), m.start(1), m.end()
            if c == "{" or c == "[":
                if self.inside is not None:
                    stack.append(c)
                    continue
                if self.list_at is not None:
                    if c == "[":
                        raise ValueError("an element of hits is not an object")
                    self._leave(text[begin:before] + "{}")
                    if element := _WHOLE.match(text, before):
                        whole.append((self.doc, element.group()))
                        self.counts[self.doc] += 1
                        begin = at = element.end()
                        continue
                    self.inside, self.list_at, begin = self.list_at, None, before
                elif c == "{" and (not stack or len(stack) == 1 and stack[0][0] == "["):
                    self.doc += 1
                    self.counts[self.doc] = 0
                self._read(text, known, before)
                known = before
                stack.append(c + self.last)
                if self.inside is None and list_depth(stack) == len(stack):
                    self.list_at = len(stack)
            elif c == '"':
                raise ValueError("a string does not end on its line: not JSON")
            elif not c:
                break
            else:
                if not stack or stack.pop()[0] != ("[" if c == "]" else "{"):
                    raise ValueError("brackets do not match: not JSON")
                if self.inside is None:
                    self.list_at = None
                elif len(stack) == self.inside:
                    self.held.append(text[begin:at])
                    element, self.held, begin = "\n".join(self.held), [], at
                    if self.crossing:
                        self.fragments.append((self.origin, 0, element))
                    else:
                        whole.append((self.doc, element))
                        self.counts[self.doc] += 1
                    self.crossing, self.list_at, self.inside = False, self.inside, None
        self._read(text, known, len(text))
        (self.held.append if self.inside is not None else self._leave)(text[begin:])
        return whole

    def _read(self, text: str, begin: int, end: int) -> None:
        """Keeps whether the last string so far was "hits"."""
        string = _last_string(text, begin, end)
        if string is not None:
            self.last = _is_key(string)

    def _leave(self, text: str) -> None:
        if text.strip():
            self.envelope.append(text)
            if len(self.envelope) > 1000:
                self.envelope = [self.rest()]

    def rest(self) -> str:
        """The range's text without its elements; runs of them are one."""
        return _RUN.sub("{}", "\n".join(self.envelope))

    def end(self) -> None:
        if self.inside is not None:
            self.fragments.append((self.origin if self.crossing else self.block, 0 if self.crossing else self.doc, "\n".join(self.held)))


def _composed(group: pd.DataFrame) -> pd.DataFrame:
    """Each range's stack, last string and open element's origin at its begin."""
    group = group.sort_values("block")
    stack, last, origin, out = [], "0", -1, []
    for r in group.itertuples(index=False):
        out.append((r.file, r.block, "".join(stack), last, origin))
        if r.closes > len(stack):
            raise ValueError("brackets do not match: not JSON")
        kept = len(stack) - r.closes
        stack = stack[:kept] + [f.replace("?", last) for f in _frames(r.opened)]
        last = last if r.last == "?" else r.last
        depth = list_depth(stack)
        if depth is not None and depth < len(stack) and depth >= kept:
            origin = r.block
    if stack:
        raise ValueError("a document does not end: not JSON")
    return pd.DataFrame(out, columns=["file", "block", "stack", "last", "origin"])


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names=names)


def _first_scan(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, key, closes, opened, last = [], None, 0, [], "?"
        for at, part, new in texts_by_range(batches):
            if new:
                if key is not None:
                    rows.append((*key, closes, "".join(opened), last))
                key, closes, opened, last = at, 0, [], "?"
            more, frames, end = closed_and_opened(iter([part]))
            frames = [f.replace("?", last) for f in frames]
            kept = len(opened) - more
            closes, opened = closes + max(0, -kept), opened[:max(0, kept)] + frames
            last = last if end == "?" else end
        if key is not None:
            rows.append((*key, closes, "".join(opened), last))
            yield _batch(rows, ["file", "block", "closes", "opened", "last"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])

    return df.mapInArrow(run, "file string, block long, closes long, opened string, last string")


_SIDES = "file string, block long, kind string, origin long, doc long, n long, text string"


def _second_scan(df: DataFrame, begins: dict[tuple[str, int], tuple[str, str, int]], sides: bool) -> DataFrame:
    """file, block, place, doc, text of the elements that lie in one range; or, with ``sides``, what else
    there is of each range: counts by document (n), fragments (f), the envelope (e)."""
    shared = df.sparkSession.sparkContext.broadcast(begins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, walk, place, found = None, None, 0, []
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = [c.split()[0] for c in _SIDES.split(", ")]

        def left() -> list[tuple]:
            walk.end()
            out = [(*key, "n", -1, doc, n, None) for doc, n in walk.counts.items()]
            out += [(*key, "f", origin, doc, 0, text) for origin, doc, text in walk.fragments]
            return out + [(*key, "e", -1, 0, 0, walk.rest())]

        for at, part, new in texts_by_range(batches):
            if new:
                if walk is not None and sides:
                    yield _batch(left(), names, kinds)
                stack, last, origin = shared.value.get(at, ("", "0", -1))
                key, walk, place = at, Walk(_frames(stack), last, origin, at[1]), 0
            found = walk.feed(part)
            if found and not sides:
                yield _batch([(*key, place + i, doc, text) for i, (doc, text) in enumerate(found)],
                             ["file", "block", "place", "doc", "text"], [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()])
                place += len(found)
        if walk is not None and sides:
            yield _batch(left(), names, kinds)

    return df.mapInArrow(run, _SIDES if sides else "file string, block long, place long, doc long, text string")


def documents(envelope: str) -> list[dict]:
    """The responses of a file from its text without their hits."""
    def checked(pairs: list[tuple[str, object]]) -> dict:
        if sum(k == _KEY for k, _ in pairs) > 1:
            raise ValueError("a response names its hits twice")
        return dict(pairs)

    text, decoder, out, at = envelope.removeprefix("﻿").strip(), json.JSONDecoder(object_pairs_hook=checked), [], 0
    while at < len(text):
        value, at = decoder.raw_decode(text, at)
        out += value if isinstance(value, list) else [value]
        while at < len(text) and text[at].isspace():
            at += 1
    for doc in out:
        if not isinstance(doc, dict):
            raise ValueError("a response is not an object")
        hits = doc.get(_KEY)
        if isinstance(hits, dict) and isinstance(hits.get(_KEY), list) and any(x != {} for x in hits[_KEY]):
            raise ValueError("an element of hits is not an object")
    return out


def _page(value: object) -> int:
    """A response's own page number; 0 where it has none that is a whole number."""
    if isinstance(value, bool) or not re.fullmatch(r"\s*[+-]?[0-9]{1,18}\s*", str(value)):
        return 0
    return int(value)


class JsonFiles:
    """Files of pretty-printed responses: the ranges' stacks, the documents, and their hits as texts.

    A range has one row in what is gathered for a file, and a document's fields beside its hits
    are parsed in one task; hits are not gathered, but for those that cross a border."""

    def __init__(self, spark: SparkSession, path: str, in_volumes: bool = False):
        self.lines = volumes(spark, path) if in_volumes else lines(spark, path)
        ranges = stored(_first_scan(self.lines), "json-ranges")
        states = stored(ranges.groupBy("file").applyInPandas(_composed, "file string, block long, stack string, last string, origin long"), "json-stacks")
        # Ranges that begin a file need no entry; of the others one short row each.
        self.begins = {(r.file, r.block): (r.stack, r.last, r.origin) for r in states.where("stack <> ''").collect()}
        self.sides = stored(_second_scan(self.lines, self.begins, True), "json-sides")
        self.first = self._first_documents()
        self.docs = self._documents()

    def _first_documents(self) -> DataFrame:
        """file, block, before: how many documents begin before each range."""
        begun = self.sides.where("kind = 'n'").groupBy("file", "block").agg(F.max("doc").alias("begun"))
        before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        return stored(begun.select(F.col("file").alias("_f"), F.col("block").alias("_b"), F.coalesce(F.sum("begun").over(before), F.lit(0)).alias("before")), "json-first")

    def _documents(self) -> DataFrame:
        """file, doc (1, 2, ... in the file), page."""
        parts = F.sort_array(F.collect_list(F.struct("block", "text")))
        envelopes = self.sides.where("kind = 'e'").groupBy("file").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for file, text in zip(*(c.to_pylist() for c in batch.columns)):
                    rows += [(file, i, _page(doc.get("pagina"))) for i, doc in enumerate(documents(_RUN.sub("{}", text)), 1)]
                yield _batch(rows, ["file", "doc", "page"], [pa.string(), pa.int64(), pa.int64()])

        return stored(envelopes.select("file", "text").mapInArrow(run, "file string, doc long, page long"), "json-documents")

    def _in_file(self, rows: DataFrame) -> DataFrame:
        """The rows with doc counted from the file's begin."""
        placed = rows.join(F.broadcast(self.first), (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
        return placed.withColumn("doc", F.col("doc") + F.col("before")).drop("_f", "_b", "before")

    def in_order(self) -> DataFrame:
        """text of every hit and _at: its number from 0 on by page, file and place."""
        fragments = self.sides.where("kind = 'f'")
        begins = fragments.where("origin = block").select(F.col("file").alias("_of"), F.col("origin").alias("_oo"), "doc")
        joined = joined_fragments(fragments).join(begins, (F.col("file") == F.col("_of")) & (F.col("origin") == F.col("_oo")))
        joined = stored(joined.select("file", F.col("origin").alias("block"), F.lit(LAST).alias("place"), "doc", "text"), "json-joined")
        rows = _second_scan(self.lines, self.begins, False).unionByName(joined)
        more = joined.groupBy("file", "block", "doc").agg(F.count("*").alias("more"))
        sizes = self.sides.where("kind = 'n'").select("file", "block", "doc", "n").join(more, ["file", "block", "doc"], "left").na.fill(0, ["more"])
        sizes = stored(sizes, "json-counts")
        rows = numbered(rows, sizes.groupBy("file", "block").agg(F.sum("n").alias("n"), F.sum("more").alias("more")), 0)
        pages = self.docs.agg(F.min("page").alias("a"), F.max("page").alias("b")).first()
        if pages.a == pages.b:
            return rows.select("_at", "text")
        # A document's hits follow each other; each moves as a whole. One row for each document here.
        order = Window.orderBy("file", "doc").rowsBetween(Window.unboundedPreceding, -1)
        paged = Window.orderBy("page", "file", "doc").rowsBetween(Window.unboundedPreceding, -1)
        total = self._in_file(sizes).groupBy("file", "doc").agg(F.sum(F.col("n") + F.col("more")).alias("size")).join(self.docs, ["file", "doc"])
        shift = F.coalesce(F.sum("size").over(paged), F.lit(0)) - F.coalesce(F.sum("size").over(order), F.lit(0))
        shifts = stored(total.select("file", "doc", shift.alias("shift")), "json-shifts")
        moved = self._in_file(rows).join(F.broadcast(shifts), ["file", "doc"])
        return moved.select((F.col("_at") + F.col("shift")).alias("_at"), "text")
