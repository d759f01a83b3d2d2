"""Queries: field extraction from saved pages (fixture case pages built from
the collected records, and the driver's own web pages)."""

from __future__ import annotations

from pyspark.sql import functions as F

from casework import constants as K
from casework.operators import pages as PG
from casework.plans import datasets as DS
from casework.plans.oracle import with_base
from casework.plans.registry import register
from casework.plans.sqlfrag import contains_any, q, strip_ws
from casework.sources.fixtures import ERROR_RESIDUE, PAGE_SPEC


def _sql_frag(conds, parts) -> str:
    body = " || ".join(f"coalesce({p[1:]}, '')" if p.startswith("@") else q(p) for p in parts)
    if not conds:
        return f"({body})"
    cond = " AND ".join(f"(o_orderkey % {m}) IN ({', '.join(map(str, r))})" for m, r in conds)
    return f"(CASE WHEN {cond} THEN {body} ELSE '' END)"


_HTML_SQL = (f"CASE WHEN o_orderkey % {ERROR_RESIDUE[0]} = {ERROR_RESIDUE[1]} THEN NULL ELSE "
             + " || ".join(_sql_frag(c, p) for c, p in PAGE_SPEC) + " END")


def html_text_sql(c: str) -> str:
    x = f"regexp_replace({c}, '(?is)<script\\b.*?</script\\s*>', '', 'g')"
    x = f"regexp_replace({x}, '(?is)<style\\b.*?</style\\s*>', '', 'g')"
    x = f"regexp_replace({x}, '(?i)<br\\s*/?>', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for ent, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        x = f"replace({x}, {q(ent)}, {q(ch)})"
    return x


def _valid_sql(c: str) -> str:
    return (f"coalesce({c} IS NOT NULL AND {c} <> '' AND NOT regexp_matches({c}, '(?i)^de\\s+') "
            f"AND NOT ({' OR '.join(f'suffix({c}, {q(s)})' for s in K.INVALID_JUDGE_SUFFIXES)}) "
            f"AND NOT {contains_any(c, K.INVALID_JUDGE_WORDS)}, false)")


def _cascade_sql(html: str) -> str:
    cands = []
    for p in K.JUDGE_PATTERNS:
        cand = strip_ws(f"regexp_extract({html}, {q('(?i)' + p)}, 1)")
        cands.append(f"CASE WHEN {_valid_sql(cand)} THEN {cand} END")
    return "coalesce(" + ", ".join(cands) + ")"


_PRIMARY_SQL = strip_ws(html_text_sql(
    "regexp_extract(html, " + q(rf'(?is)<[a-z0-9]+\b[^>]*\bid="{K.JUDGE_ELEMENT_ID}"[^>]*>.*?<span\b[^>]*>(.*?)</span>')
    + ", 1)"))
_CELLS = f"regexp_extract_all({{src}}, {q(r'(?is)<td[^>]*>(.*?)</td>')}, 1)"
_TABLE = "regexp_extract(html, " + q(rf'(?is)<table\b[^>]*\bid="{K.PARTIES_TABLE_ID}"[^>]*>(.*?)</table>') + ", 1)"


def _labelled_sql() -> str:
    outs = []
    for label in K.CLAIMANT_LABELS:
        idx = (f"list_filter(list_transform(cells, lambda c, i: {{'i': i, 't': lower({html_text_sql('c')})}}), "
               f"lambda s: contains(s.t, {q(label.lower())}))[1].i")
        cell = f"coalesce(cells[{idx} + 1], '')"
        value = strip_ws(f"split_part({html_text_sql(cell)}, chr(10), 1)")
        outs.append(f"CASE WHEN {idx} IS NOT NULL THEN {value} END")
    return "coalesce(" + ", ".join(outs) + ")"


def _decision_sql() -> str:
    outs = []
    for term in K.DECISION_TEXT_TERMS:
        first = f"list_filter(texts, lambda t: contains(lower(t), {q(term.lower())}))[1]"
        outs.append(f"CASE WHEN length({first}) > {K.DECISION_TEXT_MIN_CHARS} THEN {first} END")
    return "coalesce(" + ", ".join(outs) + ")"


_PAGES_CTES = {
    "pg": f"pg AS (SELECT numero_processo, {_HTML_SQL} AS html FROM coll)",
    "pgx": f"""pgx AS (
  SELECT numero_processo, html,
    contains(lower({html_text_sql('html')}), {q(K.NOT_FOUND_MARKER.lower())}) AS missing,
    coalesce(nullif({_PRIMARY_SQL}, ''), {_cascade_sql('html')}) AS juiz0,
    {_cascade_sql('html')} AS juiz_regex,
    {_CELLS.format(src=_TABLE)} AS cells,
    list_transform({_CELLS.format(src='html')}, lambda c: {strip_ws(html_text_sql('c'))}) AS texts
  FROM pg)""",
    "pgy": f"""pgy AS (
  SELECT numero_processo, html, missing, juiz0, juiz_regex, texts, {_labelled_sql()} AS req0 FROM pgx)""",
    "pgs": f"""pgs AS (
  SELECT *, CASE WHEN html IS NULL THEN {q(K.STATUS_ERROR)} WHEN missing THEN {q(K.STATUS_NOT_FOUND)}
    WHEN coalesce(length(juiz0), 0) > 0 AND coalesce(length(req0), 0) > 0 THEN {q(K.STATUS_OK)}
    ELSE {q(K.STATUS_INCOMPLETE)} END AS status FROM pgy)""",
    "pge": f"""pge AS (
  SELECT numero_processo, status,
    CASE WHEN status NOT IN ({q(K.STATUS_ERROR)}, {q(K.STATUS_NOT_FOUND)}) THEN juiz0 END AS juiz,
    CASE WHEN status NOT IN ({q(K.STATUS_ERROR)}, {q(K.STATUS_NOT_FOUND)}) THEN req0 END AS requerente,
    CASE WHEN status NOT IN ({q(K.STATUS_ERROR)}, {q(K.STATUS_NOT_FOUND)}) THEN {_decision_sql()} END AS texto_decisao,
    juiz_regex
  FROM pgs)""",
}


def _pages(spark, sf):
    return DS.pages(spark, sf)


@register("page_status", with_base("SELECT numero_processo, status FROM pge", _PAGES_CTES))
def page_status(spark, sf):
    return PG.extract(_pages(spark, sf)).select("numero_processo", "status")


# X2 by the fixture's rule: the element stands on pages of four residues.
@register("page_field_primary", with_base(f"""
SELECT numero_processo, CASE WHEN o_orderkey % {ERROR_RESIDUE[0]} >= 2 AND o_orderkey % 8 IN (0, 1, 4, 5)
  THEN nullif({strip_ws("coalesce(juiz, '')")}, '') END AS juiz FROM coll"""))
def page_field_primary(spark, sf):
    return PG.judge_element(_pages(spark, sf))


@register("page_field_regex_cascade", with_base("SELECT numero_processo, juiz_regex FROM pge", _PAGES_CTES))
def page_field_regex_cascade(spark, sf):
    return PG.with_judge(_pages(spark, sf), "html", "juiz_regex").select(
        "numero_processo", "juiz_regex")


@register("page_labelled_cell", with_base("SELECT numero_processo, requerente FROM pge", _PAGES_CTES))
def page_labelled_cell(spark, sf):
    return PG.extract(_pages(spark, sf)).select("numero_processo", "requerente")


@register("page_decision_text", with_base("SELECT numero_processo, texto_decisao FROM pge", _PAGES_CTES))
def page_decision_text(spark, sf):
    return PG.extract(_pages(spark, sf)).select("numero_processo", "texto_decisao")


@register("page_extract", with_base(
    "SELECT numero_processo, juiz, requerente, status, texto_decisao FROM pge", _PAGES_CTES))
def page_extract(spark, sf):
    return PG.extract(_pages(spark, sf))


def _h(tag: str) -> str:
    return strip_ws(html_text_sql(f"regexp_extract(html, {q(rf'(?is)<{tag}\b[^>]*>(.*?)</{tag}>')}, 1)"))


@register("page_headline", with_base(f"""
SELECT page_id, url,
  CASE WHEN length(h1) > 0 THEN h1 ELSE nullif(title, '') END AS titulo,
  CASE WHEN length(h1) > 0 THEN 'h1' WHEN length(title) > 0 THEN 'title' END AS fonte,
  nullif(regexp_extract(html, {q('(?is)<html\\b[^>]*\\blang="([^"]*)"')}, 1), '') AS lang
FROM (SELECT page_id, url, html, {_h('h1')} AS h1, {_h('title')} AS title FROM pages)"""))
def page_headline(spark, sf):
    return PG.headline(DS.tables(spark, sf).pages)


# Pages with every irregularity, one for each nation; the expected fields are
# written out by hand.
_PARTIES = '<table id="tablePartesPrincipais">{}</table>'
EDGE_PAGES = [
    # html, juiz, requerente, status
    ('<div id="juizPrimeiraDivTable"></div><span>Imprimir esta tela</span>', None, None, K.STATUS_INCOMPLETE),
    ("<div id='juizPrimeiraDivTable'><span>Ana <span>Beatriz</span> Reis</span><span>x</span></div>", "Ana Beatriz Reis", None, K.STATUS_INCOMPLETE),
    ("<DIV ID=juizPrimeiraDivTable><p><SPAN>Ana Reis</SPAN></p></DIV>" + _PARTIES.format("<tr><td>Autor</td><td>Rui</td></tr>"), "Ana Reis", "Rui", K.STATUS_OK),
    (_PARTIES.format("<tr><td>x</td><td>Requerente</td></tr><tr><td>Requerido</td><td>Banco</td></tr>"), None, None, K.STATUS_INCOMPLETE),
    (_PARTIES.format("<tr><td>x</td><td>Requerente</td></tr><tr><td>Autor</td><td>Rui</td></tr>"), None, "Rui", K.STATUS_INCOMPLETE),
    (_PARTIES.format("<tr><td>a<table><tr><td>b</td></tr></table></td></tr><tr><td>Requerente</td><td>Jo&#227;o<br>Adv.</td></tr>"), None, "João", K.STATUS_INCOMPLETE),
    (_PARTIES.format("<tr><td>Requerente<td> Maria &amp; Filhos <tr><td>Autor<td>z"), None, "Maria & Filhos", K.STATUS_INCOMPLETE),
    (_PARTIES.format("<tr><td>Requerente</td><td></td></tr><tr><td>Autor</td><td>Rui</td></tr>"), None, "", K.STATUS_INCOMPLETE),
    ("<p>N&atilde;o existem informa&ccedil;&otilde;es dispon&iacute;veis</p>", None, None, K.STATUS_NOT_FOUND),
    ("<p>Não existem\n   informa<b>ções</b></p>", None, None, K.STATUS_NOT_FOUND),
    ("<script>var t = 'Não existem informações';</script><p>ok</p>", None, None, K.STATUS_INCOMPLETE),
    (None, None, None, K.STATUS_ERROR),
    ("", None, None, K.STATUS_INCOMPLETE),
]


def _edge_cases(values: list) -> str:
    one = lambda v: "NULL" if v is None else q(v)
    return "CASE n_nationkey % " + str(len(values)) + " " + " ".join(f"WHEN {i} THEN {one(v)}" for i, v in enumerate(values)) + " END"


@register("page_edge_cases", f"""
SELECT n_nationkey, {_edge_cases([p[1] for p in EDGE_PAGES])} AS juiz, {_edge_cases([p[2] for p in EDGE_PAGES])} AS requerente,
  {_edge_cases([p[3] for p in EDGE_PAGES])} AS status FROM nation""")
def page_edge_cases(spark, sf):
    at = (F.col("n_nationkey") % len(EDGE_PAGES)).cast("int")
    html = F.get(F.array(*[F.lit(p[0]).cast("string") for p in EDGE_PAGES]), at)
    pages = DS.tables(spark, sf).nation.select("n_nationkey", html.alias("html"))
    return PG.extract(pages, "n_nationkey").drop("texto_decisao")
