"""Queries: counts and data-quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from casework import constants as K
from casework.operators import analytics as AN
from casework.functions.text import slug
from casework.operators.features import ml_base, ml_numbered
from casework.plans import datasets as DS
from casework.plans.oracle import with_base
from casework.plans.q_features import _FEAT_CTES, _ML_SQL
from casework.plans.registry import register
from casework.plans.sqlfrag import q
from casework.session import new_output_path
from casework.sources.writers import write_filtered

_DROPPED = ", ".join(q(x) for x in K.DROPPED_STATUSES)


@register("valid_results", with_base(f"""
SELECT count(*) AS n_total, count(CASE WHEN status NOT IN ({_DROPPED}) THEN 1 END) AS n_coletados,
  count(CASE WHEN status NOT IN ({_DROPPED}) AND texto_decisao IS NOT NULL THEN 1 END) AS n_com_texto,
  count(CASE WHEN status NOT IN ({_DROPPED}) THEN 1 END) - count(CASE WHEN status NOT IN ({_DROPPED}) AND texto_decisao IS NOT NULL THEN 1 END) AS n_sem_texto,
  CASE WHEN count(CASE WHEN status NOT IN ({_DROPPED}) THEN 1 END) > 0 THEN
    count(CASE WHEN status NOT IN ({_DROPPED}) AND texto_decisao IS NOT NULL THEN 1 END) * 100.0 / count(CASE WHEN status NOT IN ({_DROPPED}) THEN 1 END) END AS pct_com_texto
FROM coll"""))
def valid_results(spark, sf):
    c = DS.collected(spark, sf)
    return AN.filter_report(c, ~F.col("status").isin(*K.DROPPED_STATUSES), F.col("texto_decisao").isNotNull())


@register("valid_results_written", with_base(f"""
SELECT count(*) AS n_total, count(CASE WHEN status NOT IN ({_DROPPED}) THEN 1 END) AS n_mantidos,
  count(CASE WHEN status NOT IN ({_DROPPED}) AND texto_decisao IS NOT NULL THEN 1 END) AS n_marcados,
  count(CASE WHEN status NOT IN ({_DROPPED}) THEN 1 END) AS n_escritos FROM coll"""))
def valid_results_written(spark, sf):
    """The valid results are written; the counts before and after come from that job."""
    path = new_output_path(spark, "valid-results")
    counts = write_filtered(DS.collected(spark, sf), ~F.col("status").isin(*K.DROPPED_STATUSES), path, F.col("texto_decisao").isNotNull())
    written = spark.read.parquet(path).agg(F.count("*").alias("n_escritos"))
    return written.select(*[F.lit(n).cast("long").alias(c) for c, n in counts.items()], "n_escritos")


@register("status_counts", with_base(
    "SELECT count(*) AS total, " + ", ".join(f"count(CASE WHEN status = {q(s)} THEN 1 END) AS {s}" for s in K.STATUSES)
    + " FROM coll"))
def status_counts(spark, sf):
    return AN.count_per_value(DS.collected(spark, sf), "status", K.STATUSES)


_DIST = [("sexo_juiz_bin", [0, 1, -1]), ("sexo_requerente_bin", [0, 1, -1]), ("sentenca_favoravel", [0, 1])]


def _dist_name(col: str, v: int) -> str:
    return f"{col}_{'m' + str(-v) if v < 0 else v}"


@register("class_distribution", with_base(
    "SELECT " + ", ".join(f"count(CASE WHEN {c} = {v} THEN 1 END) AS {_dist_name(c, v)}" for c, vs in _DIST for v in vs)
    + f" FROM ({_ML_SQL})", _FEAT_CTES))
def class_distribution(spark, sf):
    base = ml_base(DS.ml_joined(spark, sf))
    return base.agg(*[F.count_if(F.col(c) == v).alias(_dist_name(c, v)) for c, vs in _DIST for v in vs])


_DOCS_SQL = "SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


def _docs(spark, sf):
    t = DS.tables(spark, sf)
    return t.documents.join(t.labels, "doc_id", "left")


_DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
_DOC_TYPES = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string",
              "n_chars": "bigint", "quality": "int", "toxic": "int"}


@register("null_counts", with_base(
    "SELECT coluna, n_nulos FROM (" + " UNION ALL ".join(
        f"SELECT {q(c)} AS coluna, count(CASE WHEN {c} IS NULL THEN 1 END) AS n_nulos FROM ({_DOCS_SQL})" for c in _DOC_COLS)
    + ") WHERE n_nulos > 0"))
def null_counts(spark, sf):
    return AN.null_counts(_docs(spark, sf).select(*_DOC_COLS))


@register("column_profile", with_base(
    " UNION ALL ".join(f"SELECT {q(c)} AS coluna, {q(_DOC_TYPES[c])} AS tipo, count({c}) AS nao_nulos FROM ({_DOCS_SQL})"
                       for c in _DOC_COLS)))
def column_profile(spark, sf):
    return AN.column_profile(_docs(spark, sf).select(*_DOC_COLS))


# Twenty columns are there in every table; each subject found adds one.
@register("dataset_summary", with_base(f"""
SELECT count(*) AS n_linhas, 20 + count(DISTINCT assunto_principal) AS n_colunas
FROM mlj WHERE status = {q(K.STATUS_OK)}""", _FEAT_CTES))
def dataset_summary(spark, sf):
    """M11 without building the wide table: the one-hot columns are counted by
    the names that their subjects would get."""
    base = ml_base(DS.ml_joined(spark, sf))
    fixed = len(base.columns) - 2 + 1  # without hit_pos and subject, with id
    return base.agg(F.count(F.lit(1)).alias("n_linhas"), (F.lit(fixed) + F.count_distinct(slug("assunto_principal"))).alias("n_colunas"))


# The first rows, and what is missing, of the table a model would read.
@register("dataset_preview", with_base(f"SELECT id, hit_pos, qtd_assuntos, qtd_movimentos FROM ("
                                       f"SELECT row_number() OVER (ORDER BY hit_pos) AS id, hit_pos, qtd_assuntos, qtd_movimentos "
                                       f"FROM mlj WHERE status = {q(K.STATUS_OK)}) ORDER BY id LIMIT {K.SAMPLE_ROWS}", _FEAT_CTES))
def dataset_preview(spark, sf):
    return ml_numbered(DS.ml_joined(spark, sf)).select("id", "hit_pos", "qtd_assuntos", "qtd_movimentos").orderBy("id").limit(K.SAMPLE_ROWS)


@register("dataset_missing", with_base(f"""
SELECT 'texto_decisao' AS coluna, count(*) AS faltantes FROM mlj WHERE status = {q(K.STATUS_OK)} AND texto_decisao IS NULL HAVING count(*) > 0
UNION ALL
SELECT 'nenhum', 0 FROM mlj WHERE status = {q(K.STATUS_OK)} HAVING count(*) FILTER (WHERE texto_decisao IS NULL) = 0""", _FEAT_CTES))
def dataset_missing(spark, sf):
    return AN.missing_values(ml_base(DS.ml_joined(spark, sf)))


@register("value_counts", with_base("""
SELECT sexo_juiz, count(*) AS n FROM enr WHERE sexo_juiz IS NOT NULL GROUP BY sexo_juiz"""))
def value_counts(spark, sf):
    return AN.value_counts(DS.enriched(spark, sf), "sexo_juiz")
