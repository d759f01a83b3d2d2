"""Queries: the analysis notebook (subject filter, hour histogram, office
hours, monthly series, date range, top court units, subject combinations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from casework import constants as K
from casework.functions import arrays as A
from casework.functions import time as TM
from casework.operators import analytics as AN
from casework.plans import datasets as DS
from casework.plans.oracle import with_base
from casework.plans.registry import register
from casework.plans.sqlfrag import filing_utc, q, to_local

_MEMBER = {
    "member": f"""
member AS (
  SELECT c.*, {to_local(filing_utc('c.data_ajuizamento'))} AS local_ts FROM cases c
  WHERE list_contains(list_transform(c.assuntos, lambda a: a.nome), {q(K.MEMBER_SUBJECT)})
)""",
    "hist": """
hist AS (SELECT CAST(hour(local_ts) AS INTEGER) AS hora, count(*) AS n FROM member WHERE local_ts IS NOT NULL GROUP BY 1)""",
}
_INSIDE = f"hora BETWEEN {K.OFFICE_FIRST_HOUR} AND {K.OFFICE_END_HOUR - 1}"
_SPLIT_SQL = f"""SELECT CAST(coalesce(sum(CASE WHEN {_INSIDE} THEN n END), 0) AS BIGINT) AS expediente,
  CAST(coalesce(sum(CASE WHEN NOT ({_INSIDE}) THEN n END), 0) AS BIGINT) AS fora FROM hist"""


def member_hits(spark, sf):
    """cases whose subject list contains the subject of interest."""
    c = DS.cases(spark, sf)
    return c.filter(F.array_contains(A.subject_names("assuntos"), K.MEMBER_SUBJECT))


def _local_filing():
    return TM.to_local(TM.parse_filing_utc(F.col("data_ajuizamento")))


def _hist(spark, sf):
    return AN.hour_histogram(member_hits(spark, sf), _local_filing())


@register("subject_member_filter", with_base("SELECT hit_pos, numero_processo FROM member", _MEMBER))
def subject_member_filter(spark, sf):
    return member_hits(spark, sf).select("hit_pos", "numero_processo")


@register("hourly_histogram", with_base("SELECT hora, n FROM hist", _MEMBER))
def hourly_histogram(spark, sf):
    return _hist(spark, sf)


@register("event_hourly_histogram", with_base(f"""
SELECT CAST(hour({to_local('ts')}) AS INTEGER) AS hora, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1"""))
def event_hourly_histogram(spark, sf):
    ev = DS.tables(spark, sf).events
    return AN.hour_histogram(ev, TM.to_local(F.col("ts")))


@register("office_hours_split", with_base(_SPLIT_SQL, _MEMBER))
def office_hours_split(spark, sf):
    return AN.office_hours_by_value(_hist(spark, sf))


@register("office_hours_positional", with_base(f"""
SELECT CAST(coalesce(sum(CASE WHEN p BETWEEN {K.OFFICE_FIRST_HOUR} AND {K.OFFICE_END_HOUR - 1} THEN n END), 0) AS BIGINT) AS expediente,
  CAST(coalesce(sum(CASE WHEN NOT (p BETWEEN {K.OFFICE_FIRST_HOUR} AND {K.OFFICE_END_HOUR - 1}) THEN n END), 0) AS BIGINT) AS fora
FROM (SELECT n, row_number() OVER (ORDER BY hora) - 1 AS p FROM hist)""", _MEMBER))
def office_hours_positional(spark, sf):
    return AN.office_hours_by_position(_hist(spark, sf))


@register("office_hours_share", with_base(f"""
SELECT rotulo, n, CASE WHEN sum(n) OVER () > 0 THEN n * 100.0 / sum(n) OVER () END AS pct,
  printf('%.2f%%', CASE WHEN sum(n) OVER () > 0 THEN (n * 100.0 / sum(n) OVER ())::DOUBLE END) AS pct_rotulo FROM (
  SELECT {q(K.OFFICE_LABELS[0])} AS rotulo, expediente AS n FROM s
  UNION ALL SELECT {q(K.OFFICE_LABELS[1])}, fora FROM s)""", {**_MEMBER, "s": f"s AS ({_SPLIT_SQL})"}))
def office_hours_share(spark, sf):
    return AN.shares(AN.office_hours_by_value(_hist(spark, sf)))


_MONTH_CTES = {
    "mc": """mc AS (SELECT CAST(date_trunc('month', local_ts) AS DATE) AS mes, count(*) AS n FROM member
            WHERE local_ts IS NOT NULL GROUP BY 1)""",
    "b": "b AS (SELECT min(mes) AS lo, max(mes) AS hi FROM mc)",
    "cal": """cal AS (SELECT CAST(g AS DATE) AS mes, b.lo FROM b, LATERAL unnest(generate_series(
            CAST(b.lo AS TIMESTAMP), CAST(b.hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS t(g))""",
}


@register("monthly_series", with_base(f"""
SELECT {q(K.MONTH_LABEL_PREFIX)} || strftime(cal.mes, '%Y-%m') AS mes, CAST(coalesce(mc.n, 0) AS BIGINT) AS n
FROM cal LEFT JOIN mc ON mc.mes = cal.mes WHERE cal.mes > cal.lo""", {**_MEMBER, **_MONTH_CTES}))
def monthly_series(spark, sf):
    return AN.monthly_series(member_hits(spark, sf), _local_filing())


@register("date_range_summary", with_base("""
SELECT count(*) AS n, strftime(min(local_ts), '%Y-%m-%d %H:%M:%S') AS data_inicial,
  strftime(max(local_ts), '%Y-%m-%d %H:%M:%S') AS data_final FROM member""", _MEMBER))
def date_range_summary(spark, sf):
    r = AN.date_range(member_hits(spark, sf), _local_filing())
    return r.select("n", TM.format_ts("data_inicial").alias("data_inicial"),
                    TM.format_ts("data_final").alias("data_final"))


_TOPK_SQL = f"""
SELECT municipio, orgao_julgador, count(codigo) AS n FROM member
WHERE municipio IS NOT NULL AND orgao_julgador IS NOT NULL
GROUP BY municipio, orgao_julgador ORDER BY n DESC, municipio, orgao_julgador LIMIT {K.TOP_UNITS}"""
_KEYS = ["municipio", "orgao_julgador"]


@register("topk_units", with_base(_TOPK_SQL, _MEMBER))
def topk_units(spark, sf):
    return AN.top_units(member_hits(spark, sf), _KEYS, "codigo")


@register("topk_units_text", with_base(f"""
SELECT CAST(municipio AS VARCHAR) || ' | ' || orgao_julgador || ' |' || CAST(n AS VARCHAR) AS linha, n, municipio, orgao_julgador
FROM ({_TOPK_SQL})""", _MEMBER))
def topk_units_text(spark, sf):
    return AN.top_units_text(AN.top_units(member_hits(spark, sf), _KEYS, "codigo"), _KEYS)


@register("subject_combo_counts", with_base("""
SELECT array_to_string(nomes, ' | ') AS assuntos, count(*) AS n
FROM (SELECT list_transform(assuntos, lambda a: a.nome) AS nomes FROM cases) GROUP BY nomes"""))
def subject_combo_counts(spark, sf):
    c = DS.cases(spark, sf).select(A.subject_names("assuntos").alias("nomes"))
    counts = AN.value_counts(c, "nomes")
    return counts.select(F.array_join("nomes", " | ").alias("assuntos"), "n")
