"""Quality rules and the frequency of lines across a host's documents.

One pass over the texts gives each row's statistics and the hashes of its
normalised lines (lower-cased A-Z, words joined by one space). Lines are
counted by host and hash; a line in more than ``share`` percent of a host's distinct
documents, and in more than ``floor`` of them, is removed from all of them, and a document
that keeps less than ``least_kept`` percent of its words is depleted and rejected, as
are those that fail the base rules.

Counting is in two steps: rows first, with map-side sums, so a line that a
third of all rows hold leaves each task as one row; then distinct documents, for the
few lines with enough rows for their host's limit. Hosts are part of the key, so a host with a third
of all rows is dealt by its lines. A host's documents are counted from (host, document) pairs without texts.

A null text has no words and no lines and fails the base rules. Null hosts are one
host. Rows that repeat a doc_id are rated each and count as one document; a
row without an id counts as a document of its own. An empty table gives an
empty result. Only the named columns are read, so other names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.common import id_and_text, in_parts, written

#: Symbols that mark debris.
SYMBOLS = b"#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def line_hash(line: bytes) -> tuple[int, int]:
    """Hash of the normalised line and its number of words."""
    words = line.lower().split()
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63), len(words)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three that occur more than once."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words])
    _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    # Numbers of pairs and of words both stay below the text's length.
    _, at, counts = np.unique(pairs[:-1].astype(np.int64) * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[at] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k:k + len(again)] |= again
    return int(covered.sum())


def statistics(text: str) -> tuple[int, int, int, int, int]:
    raw = text.encode()
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.split()]
    return (len(words), len(text) - sum(map(text.count, SPACES)), len(raw) - len(raw.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


def text_statistics(docs: DataFrame, host_col: str) -> DataFrame:
    """row (a number of its own), doc_id, host, the statistics, and the
    distinct lines as parallel arrays hashes and line_words."""
    fields = [("row", pa.int64()), ("doc_id", pa.int64()), ("host", pa.string())] + [(s, pa.int64()) for s in STATISTICS]
    schema = pa.schema([*fields, ("hashes", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in in_parts(batches):
            keys, texts, hosts = (c.to_pylist() for c in batch.columns)
            rows = []
            for key, text, host in zip(keys, texts, hosts):
                lines: dict[int, int] = {}
                for h, n in map(line_hash, text.encode().split(b"\n")):
                    if n:
                        lines[h] = lines.get(h, 0) + n
                rows.append((row, key, host, *statistics(text), list(lines), list(lines.values())))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    sql = "row long, doc_id long, host string, " + ", ".join(f"{s} long" for s in STATISTICS) + ", hashes array<long>, line_words array<long>"
    # A null host gets a name that no host has.
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("")).alias("host")
    docs = id_and_text(docs.withColumn("__host", host), "doc_id", "text", "__host")
    return docs.select("doc_id", "text", "__host").mapInArrow(run, sql)


def frequent_lines(stats: DataFrame, floor: int, share: int) -> DataFrame:
    """row, hash and words of each line that its host repeats too often."""
    # A row without an id is a document by its row number.
    document = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", "row")).alias("document")
    sizes = stats.select("host", document).distinct().groupBy("host").agg(F.count("*").alias("size"))
    # Whole numbers: 100 * documents > limit.
    limits = sizes.select("host", F.greatest(F.lit(100 * floor), share * F.col("size")).alias("limit"))
    lines = stats.select("row", "host", document, F.explode(F.arrays_zip("hashes", "line_words")).alias("line"))
    lines = lines.select("row", "host", "document", F.col("line.hashes").alias("hash"), F.col("line.line_words").alias("words"))
    often = lines.groupBy("host", "hash").agg(F.count("*").alias("rows")).where(F.col("rows") > floor)
    busy = often.join(limits, "host").where(100 * F.col("rows") > F.col("limit")).select("host", "hash", "limit")
    hits = written(lines.join(busy, ["host", "hash"]), "busy-lines")
    distinct = hits.groupBy("host", "hash").agg(F.count_distinct("document").alias("documents"), F.first("limit").alias("most"))
    over = distinct.where(100 * F.col("documents") > F.col("most")).select("host", "hash")
    return hits.join(over, ["host", "hash"]).select("row", "hash", "words")


def rated(docs: DataFrame, floor: int = 5, share: int = 5, least_kept: int = 30, host_col: str = "source",
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's statistics and verdict, with the hashes of removed lines.

    ``share`` 0 makes ``floor`` the limit of every host."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("source"))
    stats = written(text_statistics(docs, "source"), "text-statistics")
    # A row's own lines only, so the list is bounded by the row's text.
    removed = frequent_lines(stats, floor, share).groupBy("row").agg(
        F.sum("words").alias("removed_words"), F.collect_list("hash").alias("removed"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = stats.drop("hashes", "line_words").join(removed, "row", "left").withColumn("base_failed", failed)
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    depleted = 100 * left < least_kept * F.col("n_words")
    return out.select("doc_id", *STATISTICS, "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"),
                      left.alias("words_left"), "removed")


def cleaned(docs: DataFrame, rating: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` that are kept, with the removed lines gone from their texts."""
    verdicts = rating.where("kept").select(F.col("doc_id").alias("__id"), "removed").dropDuplicates(["__id"])
    kept = docs.join(verdicts, F.col(id_col).eqNullSafe(F.col("__id"))).drop("__id")
    at, gone = kept.columns.index(text_col), kept.columns.index("removed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, removed in zip(batch.column(at).to_pylist(), batch.column(gone).to_pylist()):
                if text is not None and removed:
                    drop = set(removed)
                    text = b"\n".join(x for x in text.encode().split(b"\n") if line_hash(x)[0] not in drop).decode()
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns) if i != gone]
            yield pa.RecordBatch.from_arrays(columns, names=[n for n in batch.schema.names if n != "removed"])

    return kept.mapInArrow(run, kept.drop("removed").schema)
