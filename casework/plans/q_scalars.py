"""Queries: scalar text and time functions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from casework.functions import arrays as A
from casework.functions import text as X
from casework.functions import time as TM
from casework.plans import datasets as DS
from casework.plans.oracle import first_name_sql, with_base
from casework.plans.registry import register
from casework import constants as K
from casework.plans.sqlfrag import contains_any, filing_utc, instant_utc, q, strip_ws, to_local


@register("first_name", with_base(f"""
SELECT numero_processo, juiz, {first_name_sql('juiz')} AS primeiro_nome_juiz,
  requerente, {first_name_sql('requerente')} AS primeiro_nome_requerente FROM coll"""))
def first_name(spark, sf):
    c = DS.collected(spark, sf)
    return c.select("numero_processo", "juiz", X.first_name("juiz").alias("primeiro_nome_juiz"),
                    "requerente", X.first_name("requerente").alias("primeiro_nome_requerente"))


def _zfill_sql(c: str) -> str:
    return f"CASE WHEN length({c}) < 20 THEN lpad({c}, 20, '0') ELSE {c} END"


@register("zfill_key", with_base(f"""
SELECT numero_processo, numero_int, {_zfill_sql('numero_int')} AS numero_zfill,
  {_zfill_sql("numero_processo || '77'")} AS numero_longo
FROM (SELECT numero_processo, CAST(CAST(numero_processo AS DECIMAL(20, 0)) AS VARCHAR) AS numero_int FROM cases)"""))
def zfill_key(spark, sf):
    # The collected-records file is read back by a CSV reader that types the
    # key as an integer: the zeros are lost and restored by zfill.
    c = DS.cases(spark, sf).select(
        "numero_processo", F.col("numero_processo").cast("decimal(20,0)").cast("string").alias("numero_int"))
    return c.select("numero_processo", "numero_int", X.zfill("numero_int").alias("numero_zfill"),
                    X.zfill(F.concat("numero_processo", F.lit("77"))).alias("numero_longo"))


def _slug_sql(c: str) -> str:
    x = f"regexp_replace(strip_accents(lower({c})), '[^\\x00-\\x7F]', '', 'g')"
    for a, b in [(" ", "_"), ("/", "_"), ("(", ""), (")", ""), ("-", "_"), ("__", "_")]:
        x = f"replace({x}, '{a}', '{b}')"
    return f"left('eh_' || trim({x}, '_'), 60)"


_LABELS_SQL = """
SELECT DISTINCT origem, rotulo FROM (
  SELECT 'assunto' AS origem, unnest(list_transform(assuntos, lambda a: a.nome)) AS rotulo FROM cases
  UNION ALL SELECT 'classe', classe FROM cases
  UNION ALL SELECT 'movimento', unnest(list_transform(movimentos, lambda m: m.nome)) FROM cases)
WHERE rotulo IS NOT NULL"""


@register("column_slug", with_base(f"SELECT origem, rotulo, {_slug_sql('rotulo')} AS slug FROM ({_LABELS_SQL})"))
def column_slug(spark, sf):
    c = DS.cases(spark, sf)
    labels = (c.select(F.lit("assunto").alias("origem"), F.explode(A.subject_names("assuntos")).alias("rotulo"))
              .unionByName(c.select(F.lit("classe").alias("origem"), F.col("classe").alias("rotulo")))
              .unionByName(c.select(F.lit("movimento").alias("origem"),
                                    F.explode(F.transform("movimentos", lambda m: m["nome"])).alias("rotulo")))
              .filter(F.col("rotulo").isNotNull()).distinct())
    return labels.select("origem", "rotulo", X.slug("rotulo").alias("slug"))


@register("local_time", with_base(f"""
SELECT hit_pos, data_ajuizamento,
  strftime({to_local(filing_utc('data_ajuizamento'))}, '%Y-%m-%d %H:%M:%S') AS data_ajuizamento_local,
  strftime({to_local(instant_utc('ultima_atualizacao'))}, '%Y-%m-%d %H:%M:%S') AS ultima_atualizacao_local
FROM cases"""))
def local_time(spark, sf):
    c = DS.cases(spark, sf)
    return c.select(
        "hit_pos", "data_ajuizamento",
        TM.format_ts(TM.to_local(TM.parse_filing_utc(F.col("data_ajuizamento")))).alias("data_ajuizamento_local"),
        TM.format_ts(TM.to_local(TM.parse_instant_utc(F.col("ultima_atualizacao"))))
        .alias("ultima_atualizacao_local"))


@register("cell_first_line", with_base(f"""
SELECT doc_id, {strip_ws("split_part(text, chr(10), 1)")} AS primeira_linha,
  length({strip_ws('text')}) > 50 AS longo FROM documents"""))
def cell_first_line(spark, sf):
    d = DS.tables(spark, sf).documents
    return d.select("doc_id", X.first_line("text").alias("primeira_linha"),
                    X.longer_than("text").alias("longo"))


_CAND_SQL = r"""
SELECT DISTINCT origem, candidato FROM (
  SELECT 'juiz' AS origem, juiz AS candidato FROM coll WHERE juiz IS NOT NULL
  UNION ALL SELECT 'orgao', orgao_julgador FROM cases
  UNION ALL SELECT 'orgao_sufixo', regexp_extract(orgao_julgador, ' (de .*)$', 1) FROM cases
  UNION ALL SELECT 'juiz_truncado', split_part(juiz, ' ', 1) || ' da' FROM coll WHERE juiz IS NOT NULL)"""


@register("valid_name_filter", with_base(f"""
SELECT origem, candidato,
  coalesce(candidato IS NOT NULL AND candidato <> ''
    AND NOT regexp_matches(candidato, '(?i)^de\\s+')
    AND NOT ({" OR ".join(f"suffix(candidato, {q(x)})" for x in K.INVALID_JUDGE_SUFFIXES)})
    AND NOT {contains_any('candidato', K.INVALID_JUDGE_WORDS)}, false) AS valido
FROM ({_CAND_SQL})"""))
def valid_name_filter(spark, sf):
    recs = DS.collected(spark, sf).filter(F.col("juiz").isNotNull())
    c = DS.cases(spark, sf)
    cands = (recs.select(F.lit("juiz").alias("origem"), F.col("juiz").alias("candidato"))
             .unionByName(c.select(F.lit("orgao").alias("origem"), F.col("orgao_julgador").alias("candidato")))
             .unionByName(c.select(F.lit("orgao_sufixo").alias("origem"),
                                   F.regexp_extract("orgao_julgador", r" (de .*)$", 1).alias("candidato")))
             .unionByName(recs.select(F.lit("juiz_truncado").alias("origem"),
                                      F.concat(F.split_part("juiz", F.lit(" "), F.lit(1)), F.lit(" da"))
                                      .alias("candidato")))
             .distinct())
    return cands.select("origem", "candidato", X.valid_judge_name("candidato").alias("valido"))
