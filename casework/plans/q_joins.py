"""Queries: joins, enrichment, incremental planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from casework.operators import pages as PG
from casework.operators.joins import anti, dedupe_last, semi
from casework.plans import datasets as DS
from casework.plans.oracle import with_base
from casework.plans.q_features import _FEAT_CTES
from casework.plans.q_pages import _PAGES_CTES
from casework.plans.registry import register
from casework.session import new_output_path
from casework.sources.fixtures import collected_records
from casework.streaming.incremental import compact, plan_run, read_progress, run_counts, run_incremental, start_page_stream, store_batch

# Previous partial run of the collector: every other block of ten orders.
_CACHE_SQL = "SELECT * FROM res WHERE (o_orderkey // 10) % 2 = 0"


def _progress_path(spark, sf) -> str:
    """A progress table as that run left it: two batches, the second of which
    stores some keys again."""
    recs = collected_records(DS.tables(spark, sf))
    done = recs.filter(((F.col("o_orderkey") / 10).cast("long") % 2) == 0)
    path = new_output_path(spark, "progress")
    store_batch(done, path, "0")
    store_batch(done.where(F.col("o_orderkey") % 3 == 0), path, "1")
    return path


def _cache(spark, sf):
    return read_progress(spark, _progress_path(spark, sf))


@register("join_inner", with_base("""
SELECT numero_processo, hit_pos, status, sentenca_favoravel, sexo_juiz, sexo_requerente FROM mlj""", _FEAT_CTES))
def join_inner(spark, sf):
    return DS.ml_joined(spark, sf).select("numero_processo", "hit_pos", "status", "sentenca_favoravel",
                                          "sexo_juiz", "sexo_requerente")


@register("join_left_lookup", with_base("SELECT numero_processo, status, sentenca_favoravel FROM valid"))
def join_left_lookup(spark, sf):
    return DS.valid_records(spark, sf).select("numero_processo", "status", "sentenca_favoravel")


@register("join_semi", with_base("""
SELECT hit_pos, numero_processo, grau FROM cases WHERE numero_processo IN (SELECT numero_processo FROM dunion)"""))
def join_semi(spark, sf):
    return semi(DS.cases(spark, sf), DS.union(spark, sf), "numero_processo").select(
        "hit_pos", "numero_processo", "grau")


@register("join_anti", with_base(f"""
SELECT numero_processo AS numeroProcesso FROM dunion d
WHERE NOT EXISTS (SELECT 1 FROM ({_CACHE_SQL}) c WHERE c.numero_processo = d.numero_processo)"""))
def join_anti(spark, sf):
    listed = DS.union(spark, sf).select("numero_processo")
    return anti(listed, _cache(spark, sf), "numero_processo").select(
        F.col("numero_processo").alias("numeroProcesso"))


@register("incremental_pending", with_base(f"""
SELECT count(CASE WHEN l.k IS NOT NULL THEN 1 END) AS n_lista, count(CASE WHEN c.k IS NOT NULL THEN 1 END) AS n_cache,
  count(CASE WHEN c.k IS NOT NULL AND l.k IS NOT NULL THEN 1 END) AS n_cache_na_lista,
  count(CASE WHEN c.k IS NOT NULL AND l.k IS NULL THEN 1 END) AS n_ignorados,
  count(CASE WHEN l.k IS NOT NULL AND c.k IS NULL THEN 1 END) AS n_pendentes
FROM (SELECT DISTINCT numero_processo AS k FROM dunion) l
FULL OUTER JOIN (SELECT numero_processo AS k FROM ({_CACHE_SQL})) c ON l.k = c.k"""))
def incremental_pending(spark, sf):
    return run_counts(DS.union(spark, sf).select("numero_processo"), _cache(spark, sf))


@register("name_lookup", with_base(
    "SELECT numero_processo, juiz, sexo_juiz, requerente, sexo_requerente FROM enr"))
def name_lookup(spark, sf):
    return DS.enriched(spark, sf).select("numero_processo", "juiz", "sexo_juiz", "requerente",
                                         "sexo_requerente")


@register("name_lookup_mode", with_base(
    "SELECT numero_processo, juiz, sexo_juiz, requerente, sexo_requerente FROM enrm"))
def name_lookup_mode(spark, sf):
    return DS.enriched(spark, sf, ambiguous="mode").select(
        "numero_processo", "juiz", "sexo_juiz", "requerente", "sexo_requerente")


@register("progress_kept", with_base(f"""
SELECT numero_processo, juiz, requerente, status, texto_decisao FROM ({_CACHE_SQL})
WHERE numero_processo IN (SELECT numero_processo FROM dunion)"""))
def progress_kept(spark, sf):
    """The stored records of the listed keys, each once."""
    return plan_run(DS.union(spark, sf).select("numero_processo"), _cache(spark, sf))["kept"]


# A run over the list's keys that end in an even digit, then one over the whole
# list: the second keeps the first one's records and adds the others.
@register("incremental_rerun", with_base("""
SELECT numero_processo, juiz, requerente, status, texto_decisao,
  CASE WHEN substr(numero_processo, 20, 1) IN ('0', '2', '4', '6', '8') THEN 'mantido' ELSE 'novo' END AS origem
FROM pge WHERE numero_processo IN (SELECT numero_processo FROM dunion)""", _PAGES_CTES))
def incremental_rerun(spark, sf):
    path = new_output_path(spark, "progress")
    listed = DS.union(spark, sf).select("numero_processo")
    pages = DS.pages(spark, sf)
    half = listed.filter(F.substring("numero_processo", 20, 1).isin("0", "2", "4", "6", "8"))
    before = run_incremental(half, pages, path, PG.extract, batches=2).select(
        F.col("numero_processo"), F.lit("mantido").alias("antes"))
    first = new_output_path(spark, "first-run")
    before.write.parquet(first)
    after = run_incremental(listed, pages, path, PG.extract)
    return after.join(spark.read.parquet(first), "numero_processo", "left").select(
        *after.columns, F.coalesce("antes", F.lit("novo")).alias("origem"))


# J2 with several rows for a key: of a customer's orders the last one's values.
@register("lookup_last_duplicate", """
SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN (
  SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus
  FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""")
def lookup_last_duplicate(spark, sf):
    t = DS.tables(spark, sf)
    last = dedupe_last(t.orders.withColumn("pos", F.col("o_orderkey")), "o_custkey", ["o_orderkey", "o_orderstatus"], "pos")
    return t.customer.select("c_custkey").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")


@register("progress_compacted", with_base(f"""
SELECT numero_processo, juiz, requerente, status, texto_decisao FROM ({_CACHE_SQL})"""))
def progress_compacted(spark, sf):
    """K8: all stored records, each key once, after the batches were merged and one was done again."""
    path = _progress_path(spark, sf)
    compact(spark, path)
    again = read_progress(spark, path).where(F.pmod(F.xxhash64("numero_processo"), F.lit(3)) == 0)
    store_batch(again, path, "1")
    return read_progress(spark, path)


@register("page_stream", with_base("""
SELECT numero_processo, juiz, requerente, status, texto_decisao FROM pge""", _PAGES_CTES))
def page_stream(spark, sf):
    """K8, streaming face: the saved pages arrive as files, some in each micro-batch; the
    records of all, after the batches were merged along the way."""
    inbox, progress, checkpoint = (new_output_path(spark, n) for n in ("inbox", "progress", "stream"))
    pages = DS.pages(spark, sf).select("numero_processo", "html")
    pages.write.parquet(inbox)
    files = len(spark.read.parquet(inbox).inputFiles())
    start_page_stream(spark, inbox, pages.schema, progress, checkpoint, PG.extract, files_per_trigger=max(1, files // 4), compact_after=2).awaitTermination()
    return read_progress(spark, progress)
