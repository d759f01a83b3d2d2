"""Queries: decisions and case selection (the original's first notebook)."""

from __future__ import annotations

from pyspark.sql import functions as F

from casework import constants as K
from casework.operators import decisions as D
from casework.plans import datasets as DS
from casework.plans.oracle import with_base
from casework.plans.registry import register
from casework.plans.sqlfrag import q

BLOCK_TARGET = 100


@register("decisions_per_case", with_base("""
SELECT hit_pos, numero_processo, array_to_string(decisoes, ' | ') AS decisoes,
  CAST(len(decisoes) AS INTEGER) AS n_decisoes FROM dec WHERE len(decisoes) > 0"""))
def decisions_per_case(spark, sf):
    d = D.decisions_per_case(DS.cases(spark, sf))
    return d.select("hit_pos", "numero_processo", F.array_join("decisoes", " | ").alias("decisoes"),
                    F.size("decisoes").alias("n_decisoes"))


@register("first_decision", with_base("SELECT numero_processo, tipo_decisao, hit_pos FROM firstdec"))
def first_decision(spark, sf):
    return DS.first_decisions(spark, sf)


@register("decisions_union", with_base(
    "SELECT numero_processo, tipo_decisao, type_order, hit_pos FROM dunion"))
def decisions_union(spark, sf):
    return DS.union(spark, sf).select("numero_processo", "tipo_decisao", "type_order", "hit_pos")


@register("decision_flag", with_base(f"""
SELECT numero_processo, tipo_decisao, contains(tipo_decisao, {q(K.FAVOURABLE_MARKER)}) AS sentenca_favoravel
FROM dunion"""))
def decision_flag(spark, sf):
    return DS.union(spark, sf).select("numero_processo", "tipo_decisao",
                                      D.favourable().alias("sentenca_favoravel"))


@register("decision_type_top10", with_base(f"""
SELECT tipo_decisao, count(*) AS n FROM (SELECT unnest(decisoes) AS tipo_decisao FROM dec)
GROUP BY tipo_decisao ORDER BY n DESC, tipo_decisao LIMIT {K.TOP_DECISION_TYPES}"""))
def decision_type_top10(spark, sf):
    return D.decision_type_top(DS.cases(spark, sf))


@register("decision_type_rollup", with_base("""
SELECT CASE WHEN grouping(tipo_decisao) = 1 THEN 'Total' ELSE tipo_decisao END AS tipo_decisao, count(*) AS n
FROM dunion GROUP BY ROLLUP (tipo_decisao)"""))
def decision_type_rollup(spark, sf):
    return D.decision_type_rollup(DS.union(spark, sf))


@register("decision_coverage", with_base("""
SELECT count(CASE WHEN len(decisoes) > 0 THEN 1 END) AS com_decisao, count(*) AS total FROM dec"""))
def decision_coverage(spark, sf):
    return D.decision_coverage(DS.cases(spark, sf))


@register("text_estimate", with_base(f"""
SELECT count(*) AS n_decisoes, CAST(floor(count(*) * {K.PUBLIC_TEXT_SHARE}) AS BIGINT) AS estimativa_com_texto
FROM dunion"""))
def text_estimate(spark, sf):
    return D.text_estimate(DS.union(spark, sf))


@register("distinct_cases", with_base("""
SELECT numero_processo AS numeroProcesso,
  row_number() OVER (ORDER BY min_type, min_pos) AS ordem
FROM (SELECT numero_processo, arg_min(type_order, (type_order, hit_pos)) AS min_type,
             arg_min(hit_pos, (type_order, hit_pos)) AS min_pos
      FROM dunion GROUP BY numero_processo)"""))
def distinct_cases(spark, sf):
    return D.distinct_cases(DS.union(spark, sf))


@register("block_sample", with_base(f"""
SELECT numero_processo, tipo_decisao, hit_pos, p FROM (
  SELECT numero_processo, tipo_decisao, hit_pos,
    CAST(row_number() OVER (PARTITION BY tipo_decisao ORDER BY hit_pos) - 1 AS INTEGER) AS p
  FROM dunion)
WHERE p < {-(-BLOCK_TARGET // K.BLOCK_SIZE) * (K.BLOCK_SIZE + K.BLOCK_SKIP)}
  AND p % {K.BLOCK_SIZE + K.BLOCK_SKIP} < {K.BLOCK_SIZE}"""))
def block_sample(spark, sf):
    return D.block_sample(DS.union(spark, sf), BLOCK_TARGET)
