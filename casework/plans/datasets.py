"""Named intermediate datasets shared by the registered queries.

Each function returns a lazy DataFrame built from the driver tables; nothing
is collected. The chain mirrors the original pipeline: hits, case table,
decisions, selected case numbers, collected records, enriched records,
feature table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casework.operators import cases as C
from casework.operators import decisions as D
from casework.session import configure
from casework.sources.adapter import ADAPTER_VERSION, build_hits
from casework.sources.tables import Tables


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    configure(spark)
    return Tables(spark, sf_dir)


HIT_INPUTS = ["orders", "lineitem", "part", "customer", "nation"]


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed hit table (built from the driver tables on first use)."""
    from casework.sources.landing import land

    t = tables(spark, sf_dir)
    inputs = [f"{sf_dir.rstrip('/')}/{n}.parquet" for n in HIT_INPUTS]
    return land(spark, f"hits-v{ADAPTER_VERSION}", inputs, lambda: build_hits(t))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.flatten_hits(hits(spark, sf_dir))


def first_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.first_decision(cases(spark, sf_dir))


def union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.decisions_union(first_decisions(spark, sf_dir))


# -- collection, enrichment, features ------------------------------------------

def selected_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case-number list handed to the page collector (distinct, ordered)."""
    return D.distinct_cases(union(spark, sf_dir))


def collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records collected for the listed case numbers."""
    from casework.operators.joins import semi
    from casework.sources.fixtures import collected_records

    return semi(collected_records(tables(spark, sf_dir)), union(spark, sf_dir), "numero_processo")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed table of saved case pages (numero_processo, html,
    o_orderkey), in files of even size: reading a page costs far more than its
    bytes suggest."""
    from casework.sources.fixtures import PAGES_VERSION, case_pages
    from casework.sources.landing import land

    inputs = [f"{sf_dir.rstrip('/')}/{n}.parquet" for n in HIT_INPUTS]
    return land(spark, f"pages-v{ADAPTER_VERSION}.{PAGES_VERSION}", inputs, lambda: case_pages(collected(spark, sf_dir)).hint("rebalance"))


def valid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 + J2: found records with decision text, plus the binary target
    looked up by case number (last duplicate wins, null when absent)."""
    from pyspark.sql import functions as F

    from casework import constants as K
    from casework.operators.joins import lookup_left

    recs = collected(spark, sf_dir).filter(
        ~F.col("status").isin(*K.DROPPED_STATUSES) & F.col("texto_decisao").isNotNull())
    flags = union(spark, sf_dir).select(
        "numero_processo", D.favourable().alias("sentenca_favoravel"),
        F.struct("type_order", "hit_pos").alias("_pos"))
    return lookup_left(recs, flags, "numero_processo", ["sentenca_favoravel"], "_pos")


def enriched(spark: SparkSession, sf_dir: str, ambiguous: str = "null",
             dictionary: DataFrame | None = None) -> DataFrame:
    """Sex of judge and claimant from the first-name dictionary."""
    from casework.operators.names import lookup_attribute
    from casework.sources.fixtures import name_dictionary

    dic = dictionary if dictionary is not None else name_dictionary(spark)
    return lookup_attribute(valid_records(spark, sf_dir),
                            {"juiz": "sexo_juiz", "requerente": "sexo_requerente"}, dic, ambiguous)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows of every hit whose case number was selected (all
    instances, rule N2)."""
    from casework.operators.features import case_features
    from casework.operators.joins import semi

    sel = semi(cases(spark, sf_dir), union(spark, sf_dir), "numero_processo")
    return case_features(sel, keep=["hit_pos"])


def ml_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows x enriched records (inner; duplicates multiply)."""
    e = enriched(spark, sf_dir).select("numero_processo", "sexo_juiz", "sexo_requerente",
                                       "sentenca_favoravel", "status", "texto_decisao")
    return features(spark, sf_dir).join(e, "numero_processo", "inner")


def ml_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casework.operators.features import ml_table

    return ml_table(ml_joined(spark, sf_dir))
