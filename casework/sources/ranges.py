"""Reading files by byte ranges when a record may hold line breaks.

Spark hands out the lines of a file range by range; a line belongs to the range in
which it begins. A range alone cannot tell whether it begins inside a record.
The readers here therefore scan every range once without that knowledge and leave one row
for it (how it maps the state at its begin to the state at its end), compose those rows in
file order, and scan again with each range's true state. Records that cross a
border are put together from the fragments that the ranges on both sides leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casework.session import new_output_path, ship_package

#: Places of what begins in a range and ends beyond it: behind all others.
LAST = 1 << 62


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, block: every line (cut at line feeds alone), its file and where its range begins."""
    ship_package(spark)
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


#: What the names of one task's files differ in, where the number of rows a file is bounded.
_VOLUME = r"-c([0-9]+)(\.[a-z]+)*$"
#: An empty line ends a piece: a task takes up some lines at once.
PIECE_END = "\n\n"


def volumes(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`lines` for files that ``writers.write_volumes`` wrote: file is what the volumes make up
    together, block a volume's number, value a piece of some lines."""
    ship_package(spark)
    name = F.col("_metadata.file_path")
    raw = spark.read.option("lineSep", PIECE_END).text(path)
    return raw.select("value", F.regexp_replace(name, _VOLUME, "").alias("file"),
                      F.coalesce(F.regexp_extract(name, _VOLUME, 1).try_cast("long"), F.lit(0)).alias("block"))


def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str], bool]]:
    """((file, block), some of its lines, whether they are the first): a task's
    ranges one after the other, each in parts of an Arrow batch."""
    before = None
    for batch in batches:
        values, files, blocks = (c.to_pylist() for c in batch.columns)
        a = 0
        while a < len(values):
            key, b = (files[a], blocks[a]), a + 1
            while b < len(values) and blocks[b] == key[1] and files[b] == key[0]:
                b += 1
            yield key, values[a:b], key != before
            before, a = key, b


def texts_by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str, bool]]:
    """As :func:`by_range`, each part as one text; no line becomes an object of its own."""
    before = None
    for batch in batches:
        values, files, blocks = batch.columns
        n = len(values)
        if not n:
            continue
        changes = pc.or_(pc.not_equal(files.slice(1), files.slice(0, n - 1)), pc.not_equal(blocks.slice(1), blocks.slice(0, n - 1)))
        cuts = [0, *(np.flatnonzero(changes.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            key = (files[a].as_py(), blocks[a].as_py())
            part = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), values.slice(a, b - a))
            yield key, pc.binary_join(part, "\n")[0].as_py(), key != before
            before = key


def stored(df: DataFrame, name: str) -> DataFrame:
    """A small table (a row for each range) written and read back."""
    path = new_output_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined_fragments(fragments: DataFrame) -> DataFrame:
    """file, origin, text of what crosses borders. ``fragments``: file, origin (the range in which
    it begins), block, text. A group is one record."""
    parts = F.sort_array(F.collect_list(F.struct("block", "text")))
    return fragments.groupBy("file", "origin").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def numbered(rows: DataFrame, counts: DataFrame, start: int) -> DataFrame:
    """``rows`` (file, block, place, ...) with _at, their number in order of file, range and place.

    ``counts``: file, block, n and more, the rows of each range at places 0.. and at places LAST...
    One row for each range goes through prefix sums; the numbered rows do not move.
    """
    # A row for each range: Spark's driver itself holds as many.
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("n") + F.col("more")).over(before), F.lit(0))
    offsets = stored(counts.select(F.col("file").alias("_of"), F.col("block").alias("_ob"), F.col("n").alias("_on"), offset.alias("_oo")), "range-offsets")
    at = F.when(F.col("place") >= LAST, F.col("_on") + F.col("place") - LAST).otherwise(F.col("place"))
    placed = rows.join(F.broadcast(offsets), (F.col("file") == F.col("_of")) & (F.col("block") == F.col("_ob")))
    return placed.withColumn("_at", F.col("_oo") + at + F.lit(start)).drop("_of", "_ob", "_on", "_oo")
