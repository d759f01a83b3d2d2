"""Queries over irregular values: literal values dealt to the nations by number,
with the results written out by hand in the SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casework.functions import arrays as A
from casework.functions import text as X
from casework.functions import time as TM
from casework.operators import cases as C
from casework.operators import features as FT
from casework.plans import datasets as DS
from casework.plans.registry import register
from casework.plans.sqlfrag import q
from casework.session import new_output_path
from casework.sources import readers as R
from casework.sources import writers as W

N = "n_nationkey"


def _at(values: list) -> Column:
    """The value of a nation's number, in turn."""
    texts = F.array(*[F.lit(v).cast("string") for v in values])
    return F.get(texts, (F.col(N) % len(values)).cast("int"))


def _sql(values: list, kind: str = "VARCHAR") -> str:
    one = lambda v: "NULL" if v is None else q(v) if isinstance(v, str) else str(v)
    cases = " ".join(f"WHEN {i} THEN {one(v)}" for i, v in enumerate(values))
    return f"CAST(CASE {N} % {len(values)} {cases} END AS {kind})"


# Text; naive ISO; hour as written; instant in UTC.
TIMES = [
    ("2025-09-25", "2025-09-25 00:00:00", 0, "2025-09-25 00:00:00"),
    ("2025", None, None, None),
    ("2025-09", None, None, None),
    ("2025-9-5T10:00:00Z", None, None, None),
    ("2025-09-25T15:00:00.000Z", "2025-09-25 15:00:00", 15, "2025-09-25 15:00:00"),
    ("2025-09-25T15:00:00+03", None, 15, "2025-09-25 12:00:00"),
    ("2025-09-25T15:00:00-0300", None, 15, "2025-09-25 18:00:00"),
    ("2025-09-25T15:00:00 America/Sao_Paulo", None, None, None),
    ("2025-09-25T11", "2025-09-25 11:00:00", 11, None),
    ("2025-02-30T10:00:00Z", None, None, None),
    ("2025-09-25T24:00:00Z", None, None, None),
    ("", None, None, None),
    (None, None, None, None),
]


@register("edge_times", f"""
SELECT {N}, {_sql([t[1] for t in TIMES])} AS ingenuo, {_sql([t[2] for t in TIMES], "INTEGER")} AS hora,
  {_sql([t[3] for t in TIMES])} AS instante FROM nation""")
def edge_times(spark, sf):
    text = _at([t[0] for t in TIMES])
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return DS.tables(spark, sf).nation.select(
        N, show(TM.parse_iso_naive(text)).alias("ingenuo"), TM.iso_hour(text).alias("hora"), show(TM.parse_instant_utc(text)).alias("instante"))


# M1, M3: filing date, update, time of the decision; days, lunch hour.
RECORDS = [
    ("20250901000000", "2025-09-11T10:00:00.000Z", "2025-09-25T11:59:59.000Z", 10, 1),
    ("20250901120000", "2025-09-01T00:00:00.000Z", "2025-09-25T14:00:00Z", -1, 0),
    ("2025-09-01", "2025-09-11T10:00:00.000Z", "2025-09-25", 0, 0),
    ("20250901000000", "2025-09-11T10:00:00+03:00", "12:00", 0, 0),
    ("20250931000000", "2025-09-11T10:00:00.000Z", "2025-09-25T13:00:00+03", 0, 1),
    (None, "2025-09-11", None, 0, 0),
]


@register("edge_features", f"""
SELECT {N}, {_sql([r[3] for r in RECORDS], "INTEGER")} AS dias_desde_ajuizamento, {_sql([r[4] for r in RECORDS], "INTEGER")} AS eh_horario_almoco
FROM nation""")
def edge_features(spark, sf):
    filed, updated, decided = (_at([r[i] for r in RECORDS]) for i in range(3))
    movement = F.array(F.struct(F.lit(1).cast("long").alias("codigo"), F.lit("Procedência").alias("nome"), decided.alias("dataHora")))
    rows = DS.tables(spark, sf).nation.select(N, filed.alias("a"), updated.alias("u"), movement.alias("m"))
    days = FT.temporal_features(F.col("a"), F.col("u"))["dias_desde_ajuizamento"]
    return rows.select(N, days.alias("dias_desde_ajuizamento"), FT.lunch_flag(F.col("m")).alias("eh_horario_almoco"))


# Label and its column name; C20 on text: text and its code.
LABELS = [("Ação (Cível) / Saúde", "eh_acao_civel__saude"), ("Ạção", "eh_acao"), ("A-B", "eh_a_b"), ("A  B", "eh_a_b"), ("__x__", "eh_x"), ("日本 x", "eh_x"),
          ("Muito " * 14, "eh_" + "muito_" * 9 + "mui")]
TARGETS = [("True", 1), ("true", 0), ("1", 0), ("False", 0), ("", 0), (None, 0)]


@register("edge_codes", f"""
SELECT {N}, {_sql([v[1] for v in LABELS])} AS coluna, {_sql([t[1] for t in TARGETS], "INTEGER")} AS alvo_texto,
  CASE WHEN n_regionkey = 1 THEN 1 ELSE 0 END AS alvo_numero, CASE WHEN n_regionkey > 2 THEN 1 ELSE 0 END AS alvo_logico FROM nation""")
def edge_codes(spark, sf):
    return DS.tables(spark, sf).nation.select(
        N, X.slug(_at([v[0] for v in LABELS])).alias("coluna"), FT.truthy_code(_at([t[0] for t in TARGETS])).alias("alvo_texto"),
        FT.truthy_code(F.col("n_regionkey").cast("double")).alias("alvo_numero"), FT.truthy_code(F.col("n_regionkey") > 2).alias("alvo_logico"))


# K6: a report without a class, without a number, and a subject with an apostrophe.
CLASSES = ["Classe A", None]
SUBJECTS = ["D'Água", 'a "b"', None, "it's \"x\""]
REPRS = ["\"D'Água\"", "'a \"b\"'", "None", "'it\\'s \"x\"'"]


@register("edge_report", f"""
SELECT {N}, 'Autos n. ' || {_sql(["7", "None", "9"])} || ', Classe: ' || {_sql(["Classe A", "None"])} || chr(10) || 'Ajuizamento: None' || chr(10)
  || 'Assuntos: [' || {_sql(REPRS)} || ']' AS cabecalho FROM nation""")
def edge_report(spark, sf):
    subject = F.array(F.struct(F.lit(1).cast("long").alias("codigo"), _at(SUBJECTS).alias("nome")))
    cases = DS.tables(spark, sf).nation.select(
        N, F.col(N).alias("hit_pos"), _at(["7", None, "9"]).alias("numero_processo"), _at(CLASSES).alias("classe"),
        F.lit("no date").alias("data_ajuizamento"), subject.alias("assuntos"),
        F.expr("cast(array() as array<struct<codigo: bigint, nome: string, dataHora: string>>)").alias("movimentos"))
    report = C.case_report(cases)
    return report.select(F.col("hit_pos").alias(N), F.substring_index("report", "\n", 3).alias("cabecalho"))


# Cells with quotes, separators and newlines, columns in another order.
CELLS = ['a "b", c', "two\nlines", ";", None, "'", "é\\n"]


@register("edge_csv", f"SELECT CAST({N} AS BIGINT) AS {N}, {_sql(CELLS)} AS texto, n_name FROM nation")
def edge_csv(spark, sf):
    path = new_output_path(spark, "edge-csv")
    W.write_csv(DS.tables(spark, sf).nation.select("n_name", _at(CELLS).alias("texto"), N), path)
    back = R.read_csv_strings(spark, path, ["texto", N, "n_name"])
    return back.select(F.col(N).cast("long").alias(N), "texto", "n_name")


# A dictionary whose columns stand in another order, with short and odd rows.
@register("edge_dictionary", f"""
SELECT n_name AS first_name, CASE WHEN {N} % 3 = 0 THEN NULL ELSE 'F' END AS classification,
  CASE WHEN {N} % 2 = 0 THEN CAST({N} AS BIGINT) END AS frequency_total FROM nation WHERE {N} % 5 <> 4""")
def edge_dictionary(spark, sf):
    path = new_output_path(spark, "edge-names")
    field = lambda c: F.coalesce(c, F.lit(""))
    line = F.concat_ws(",", field(F.when(F.col(N) % 3 != 0, "F")), F.when(F.col(N) % 2 == 0, F.col(N).cast("string")).otherwise("many"), "n_name",
                       F.when(F.col(N) % 5 == 4, F.lit("one field too many")))
    header = spark.range(1).select(F.lit("classification,frequency_total,first_name").alias("value"), F.lit(-1).alias("k"))
    lines = header.unionByName(DS.tables(spark, sf).nation.select(line.alias("value"), F.col(N).cast("int").alias("k")))
    lines.coalesce(1).sortWithinPartitions("k").select("value").write.option("compression", "gzip").text(path)
    from casework.sources.fixtures import DICTIONARY_SCHEMA

    return R.read_gzip_csv(spark, path, DICTIONARY_SCHEMA, skip_bad_lines=True)


# A response per nation; one subject is no object, one code no number.
@register("edge_responses", f"""
SELECT row_number() OVER (ORDER BY {N}) - 1 AS hit_pos, n_name AS numero_processo, CASE WHEN {N} % 2 = 0 THEN CAST({N} AS BIGINT) END AS codigo,
  '|' || n_name AS assuntos FROM nation""")
def edge_responses(spark, sf):
    path = new_output_path(spark, "edge-responses")
    code = F.when(F.col(N) % 2 == 0, F.col(N).cast("string")).otherwise(F.lit('"x"'))
    doc = F.concat(F.lit('{"hits": {"hits": [{"_source": {"numeroProcesso": "'), F.col("n_name"), F.lit('", "classe": {"codigo": '), code,
                   F.lit('}, "assuntos": ["no object", {"nome": "'), F.col("n_name"), F.lit('"}]}}]}}'))
    DS.tables(spark, sf).nation.repartitionByRange(3, N).sortWithinPartitions(N).select(doc.alias("value")).write.text(path)
    hits = R.read_search_responses(spark, path)
    return hits.select("hit_pos", F.col("numeroProcesso").alias("numero_processo"), F.col("classe.codigo").alias("codigo"),
                       F.array_join(A.subject_names("assuntos"), "|").alias("assuntos"))


# Whether both dates parse; the urgency flag with accents folded.
URGENT = [("Tutela de Urgência", 0, 1), ("tutela de urgencia", 1, 1), ("Urgência", 0, 0), (None, 0, 0)]
UPDATES = [("2025-09-11T10:00:00Z", 1), ("2025-09-11T10:00:00+03:00", 0), ("2025", 0)]


@register("edge_options", f"""
SELECT {N}, {_sql([u[1] for u in URGENT], "INTEGER")} AS literal, {_sql([u[2] for u in URGENT], "INTEGER")} AS sem_acento,
  {_sql([u[1] for u in UPDATES], "INTEGER")} AS date_ok FROM nation""")
def edge_options(spark, sf):
    rows = DS.tables(spark, sf).nation.select(
        N, F.array(F.struct(F.lit(1).cast("long").alias("codigo"), _at([u[0] for u in URGENT]).alias("nome"))).alias("a"),
        _at([u[0] for u in UPDATES]).alias("u"))
    flag = lambda fold: FT.subject_features(F.col("a"), fold)["tem_tutela_urgencia"]
    return rows.select(N, flag(False).alias("literal"), flag(True).alias("sem_acento"),
                       FT.dates_ok(F.lit("20250901000000"), F.col("u")).alias("date_ok"))
