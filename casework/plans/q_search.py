"""Queries: search, flatten, subject and movement projections, report."""

from __future__ import annotations

from pyspark.sql import functions as F

from casework import constants as K
from casework.functions import arrays as A
from casework.functions import time as TM
from casework.operators import cases as C
from casework.plans import datasets as DS
from casework.plans.oracle import with_base
from casework.plans.registry import register
from casework.plans.sqlfrag import filing_utc, instant_utc, local_with_offset, minstd, q, to_local

SEARCH_CLASS = 2  # class code present in the adapter's data (see adapter.CLASS_BY_PRIORITY)


def _hit_cols(df):
    return df.select("hit_pos", F.col("numeroProcesso").alias("numero_processo"), "grau",
                     F.col("dataAjuizamento").alias("data_ajuizamento"))


_HIT_SQL = "hit_pos, numeroProcesso AS numero_processo, grau, dataAjuizamento AS data_ajuizamento"


@register("search_subject_topn", with_base(f"""
SELECT {_HIT_SQL} FROM hits
WHERE len(list_filter(assuntos, lambda a: a.codigo = {K.SUBJECT_SEARCH_CODE})) > 0
ORDER BY {filing_utc('dataAjuizamento')} DESC NULLS LAST, hit_pos LIMIT {K.MAX_HITS_PER_REQUEST}"""))
def search_subject_topn(spark, sf):
    h = DS.hits(spark, sf)
    return _hit_cols(C.search(h, C.has_subject_code(K.SUBJECT_SEARCH_CODE)))


@register("search_class_topn", with_base(f"""
SELECT {_HIT_SQL} FROM hits WHERE classe.codigo = {SEARCH_CLASS}
ORDER BY {filing_utc('dataAjuizamento')} ASC NULLS LAST, hit_pos LIMIT {K.MAX_HITS_PER_REQUEST}"""))
def search_class_topn(spark, sf):
    # The original leaves the direction open ("desc, or asc"): ascending here.
    h = DS.hits(spark, sf)
    return _hit_cols(C.search(h, C.has_class_code(SEARCH_CLASS), desc=False))


@register("hits_total", with_base(f"""
SELECT count(CASE WHEN len(list_filter(assuntos, lambda a: a.codigo = {K.SUBJECT_SEARCH_CODE})) > 0 THEN 1 END) AS total_hits,
       least(count(CASE WHEN len(list_filter(assuntos, lambda a: a.codigo = {K.SUBJECT_SEARCH_CODE})) > 0 THEN 1 END), {K.MAX_HITS_PER_REQUEST}) AS returned_hits
FROM hits"""))
def hits_total(spark, sf):
    return C.hit_counts(DS.hits(spark, sf), C.has_subject_code(K.SUBJECT_SEARCH_CODE))


_FLAT_SQL = """hit_pos, numero_processo, classe, data_ajuizamento, ultima_atualizacao, formato, codigo,
  orgao_julgador, municipio, grau, CAST(len(assuntos) AS INTEGER) AS qtd_assuntos,
  CAST(len(movimentos) AS INTEGER) AS qtd_movimentos, sort"""


def _flat_columns():
    return ["hit_pos", "numero_processo", "classe", "data_ajuizamento",
            "ultima_atualizacao", "formato", "codigo", "orgao_julgador", "municipio",
            "grau", A.size0("assuntos").alias("qtd_assuntos"),
            A.size0("movimentos").alias("qtd_movimentos"), "sort"]


def _flat_scalars(cases):
    return cases.select(*_flat_columns())


@register("flatten_hits", with_base(f"SELECT {_FLAT_SQL} FROM cases"))
def flatten_hits(spark, sf):
    return _flat_scalars(DS.cases(spark, sf))


@register("head_n", with_base(f"SELECT {_FLAT_SQL} FROM cases WHERE hit_pos < 10"))
def head_n(spark, sf):
    return _flat_scalars(C.head_n(DS.cases(spark, sf), 10))


@register("sample_rows", with_base(f"""
SELECT hit_pos, numero_processo, grau, classe FROM cases
ORDER BY {minstd('hit_pos')}, hit_pos LIMIT {K.SAMPLE_ROWS}"""))
def sample_rows(spark, sf):
    return C.sample_rows(DS.cases(spark, sf)).select("hit_pos", "numero_processo", "grau", "classe")


@register("subject_names", with_base("""
SELECT hit_pos, numero_processo, array_to_string(list_transform(assuntos, lambda a: a.nome), ' | ') AS assuntos_nomes,
  CAST(len(assuntos) AS INTEGER) AS qtd_assuntos FROM cases"""))
def subject_names(spark, sf):
    c = C.with_subject_names(DS.cases(spark, sf))
    return c.select("hit_pos", "numero_processo",
                    F.array_join("assuntos", " | ").alias("assuntos_nomes"),
                    A.size0("assuntos").alias("qtd_assuntos"))


_EXPLODED = """
mx AS (
  SELECT hit_pos, numero_processo, i - 1 AS mov_pos, movimentos[i].codigo AS codigo,
    movimentos[i].nome AS nome, movimentos[i].dataHora AS data_hora
  FROM cases, LATERAL unnest(generate_series(1, len(movimentos))) AS t(i)
)"""


@register("movements_local_time", with_base(f"""
SELECT hit_pos, numero_processo, CAST(mov_pos AS INTEGER) AS mov_pos, codigo, nome,
  strftime({to_local(instant_utc('data_hora'))}, '%Y-%m-%d %H:%M:%S') AS data_hora_local
FROM mx""", {"mx": _EXPLODED}))
def movements_local_time(spark, sf):
    c = DS.cases(spark, sf)
    ex = C.explode_movements(c, C.local_movements(F.col("movimentos")), ["hit_pos", "numero_processo"])
    return ex.select("hit_pos", "numero_processo", "mov_pos", F.col("m.codigo").alias("codigo"),
                     F.col("m.nome").alias("nome"),
                     TM.format_ts(F.col("m.data_hora_local")).alias("data_hora_local"))


@register("movements_sorted", with_base(f"""
SELECT hit_pos, numero_processo,
  CAST(row_number() OVER (PARTITION BY hit_pos ORDER BY {instant_utc('data_hora')} ASC NULLS FIRST, mov_pos) - 1 AS INTEGER) AS sorted_pos,
  CAST(mov_pos AS INTEGER) AS mov_pos, codigo, nome,
  strftime({to_local(instant_utc('data_hora'))}, '%Y-%m-%d %H:%M:%S') AS data_hora_local
FROM mx""", {"mx": _EXPLODED}))
def movements_sorted(spark, sf):
    c = DS.cases(spark, sf)
    ex = c.select("hit_pos", "numero_processo",
                  F.posexplode(C.sorted_movements(F.col("movimentos"))).alias("sorted_pos", "m"))
    return ex.select("hit_pos", "numero_processo", "sorted_pos", F.col("m.mov_pos").alias("mov_pos"),
                     F.col("m.codigo").alias("codigo"), F.col("m.nome").alias("nome"),
                     TM.format_ts(F.col("m.data_hora_local")).alias("data_hora_local"))


_REPORT_LINES = f"""
rl AS (
  SELECT hit_pos, string_agg(
      CASE WHEN data_hora IS NULL THEN 'None' WHEN data_hora = '' THEN ''
           ELSE {local_with_offset(instant_utc('data_hora'))} END
      || ' | Cód: ' || coalesce(CAST(codigo AS VARCHAR), 'None') || ' | Mov.: ' || coalesce(nome, 'None') || ' ' || chr(10),
      '' ORDER BY {instant_utc('data_hora')} ASC NULLS FIRST, mov_pos) AS lines
  FROM mx GROUP BY hit_pos
)"""


@register("case_report_text", with_base(f"""
SELECT c.hit_pos, c.numero_processo,
  'Autos n. ' || c.numero_processo || ', Classe: ' || c.classe || chr(10)
  || 'Ajuizamento: ' || {local_with_offset(filing_utc('c.data_ajuizamento'))} || chr(10)
  || 'Assuntos: [' || array_to_string(list_transform(c.assuntos, lambda a: CASE WHEN a.nome IS NULL THEN 'None' ELSE '''' || a.nome || '''' END), ', ') || ']' || chr(10) || chr(10)
  || coalesce(rl.lines, '') || {q(K.REPORT_SEPARATOR).replace(chr(10), "' || chr(10) || '")} AS report
FROM cases c LEFT JOIN rl ON rl.hit_pos = c.hit_pos""", {"mx": _EXPLODED, "rl": _REPORT_LINES}))
def case_report_text(spark, sf):
    return C.case_report(DS.cases(spark, sf))


# S1/S2 below the number of matches, where the limit and its tiebreak decide.
@register("search_small_limit", with_base(f"""
SELECT * FROM (SELECT 'assunto' AS busca, hit_pos, numeroProcesso AS numero_processo FROM hits
  WHERE len(list_filter(assuntos, lambda a: a.codigo = {K.SUBJECT_SEARCH_CODE})) > 0
  ORDER BY {filing_utc('dataAjuizamento')} DESC NULLS LAST, hit_pos LIMIT 37)
UNION ALL
SELECT * FROM (SELECT 'classe', hit_pos, numeroProcesso FROM hits WHERE classe.codigo = {SEARCH_CLASS}
  ORDER BY {filing_utc('dataAjuizamento')} ASC NULLS LAST, hit_pos LIMIT 101)"""))
def search_small_limit(spark, sf):
    h = DS.hits(spark, sf)
    tag = lambda df, name: df.select(F.lit(name).alias("busca"), "hit_pos", F.col("numeroProcesso").alias("numero_processo"))
    return tag(C.search(h, C.has_subject_code(K.SUBJECT_SEARCH_CODE), size=37), "assunto").unionByName(
        tag(C.search(h, C.has_class_code(SEARCH_CLASS), size=101, desc=False), "classe"))


# Of each selected case the first hit alone.
@register("selected_hits_dedup", with_base("""
SELECT numero_processo, min(hit_pos) AS hit_pos FROM cases
WHERE numero_processo IN (SELECT numero_processo FROM dunion) GROUP BY numero_processo"""))
def selected_hits_dedup(spark, sf):
    from casework.plans.pipeline import select_cases

    return select_cases(DS.hits(spark, sf), dedup=True)["selected_hits"].select(
        F.col("numeroProcesso").alias("numero_processo"), "hit_pos")
