"""The corpus pipeline: documents in, packed sequences out.

Each stage works on all rows that the one before kept and applies its operator's decisions;
all but the last return the columns of documents, and further columns, whatever their names, as
they are. A null text counts as empty and stays null; texts of any length are read whole. The
deduplication stages number the rows and decide on each: rows without an id, or with one id and
different texts, do not stand or fall together. One row of each group stays: of equal texts one with the
largest id, of near copies one with the least, an id before none, and among rows that
tie, repeated rows too, the first. An empty table goes through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.llm.common import counted, table, written
from casework.llm.cqf_dedup import exact_groups
from casework.llm.histogram_packing import packed_documents
from casework.llm.minhash_dedup import near_groups
from casework.llm.rule_ensemble import accepted
from casework.llm.weak_pii import redacted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts."""
    return accepted(docs, table(spark, sf_dir, "labels"), threshold=0.3)


ROW = "row_number"
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(stage: Callable) -> Callable:
    """The stage with further columns under names that clash with none of its own."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inner = [c if c in DOCUMENT else f"further{i}" for i, c in enumerate(docs.columns)]
        out = stage(spark, docs.toDF(*inner), sf_dir)
        return out.select(*[F.col(i).alias(c) for i, c in zip(inner, docs.columns)])

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    # Written, so that every plan that reads it sees the same numbers.
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def _without(rows: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    # The rows that go are the fewer ones; while they are few enough to
    # broadcast by count, no text is shuffled.
    gone = counted(written(gone.select(F.col("row").alias("__gone")), name))
    return rows.join(gone, F.col(rows.columns[-1]) == F.col("__gone"), "left_anti")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    docs = _numbered(docs)
    groups = written(exact_groups(docs, row_col=ROW).where("group_size > 1"), "exact-groups")
    stays = groups.where("kept").groupBy("text_sha256").agg(F.min("row").alias("row")).select("row")
    return _without(docs, _without(groups.select("row"), stays, "staying"), "gone").drop(ROW)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group, the document with the least id."""
    docs = _numbered(docs)
    groups = near_groups(docs, id_col=ROW).select(F.col("doc_id").alias("row"), "component_id")
    known = docs.select(F.col(ROW).alias("row"), "doc_id")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    members = written(groups.join(known, "row"), "near-members")
    least = members.groupBy("component_id").agg(F.min(order).alias("least"), F.count("*").alias("rows")).where("rows > 1")
    gone = members.join(least.select("component_id", "least"), "component_id").where(F.col("row") != F.col("least.row"))
    return _without(docs, gone, "gone").drop(ROW)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with tags in place of personal data and secrets."""
    clean = redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    return packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, size=2048, end_id=1)


STAGES = [("quality", _apart(quality)), ("exact_dedup", _apart(exact_dedup)), ("near_dedup", _apart(near_dedup)), ("pii", _apart(pii)), ("packing", packing)]

#: The quality stage's fit cannot be said in SQL; the tests hold each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
