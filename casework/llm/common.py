"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.session import new_output_path, ship_package

#: A word: a run of anything but space, tab, line feed, vertical tab, form
#: feed and carriage return. bytes.split() cuts UTF-8 text at the same places.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    Its rows are then computed once, however many plans read them, and a lost
    executor costs no recomputation of what is already in the folder.
    """
    return written_path(df, name)[0]


def written_path(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As :func:`written`, with the folder, so that it can be removed later."""
    path = new_output_path(df.sparkSession, re.sub(r"\W", "_", name))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete folders that :func:`written_path` made and that nothing reads any more."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def id_and_text(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator reads, renamed; a null text is empty."""
    ship_package(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       *[F.col(c) for c in more])


#: Rows of one 64-bit number that may be broadcast: 32 MB of them.
BROADCAST_ROWS = 4_000_000


def counted(ids: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``ids`` (one column of numbers), to be broadcast if there are at most
    ``most`` of them by count; else the join shuffles. Both give the same rows.
    ``ids`` should be cheap to read, such as a written table."""
    if [f.dataType.simpleString() for f in ids.schema.fields] != ["bigint"]:
        raise ValueError("only a single column of numbers has a known size")
    return F.broadcast(ids) if ids.count() <= most else ids


#: Rows of an Arrow batch that a task turns into Python objects at a time.
ROWS_AT_ONCE = 500


def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, without copying them, so that a
    worker holds the objects of those rows only. After the last one the worker, which
    goes on to other tasks, gives memory back."""
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(begin, ROWS_AT_ONCE)
    memory_given_back()


def memory_given_back() -> None:
    """Hand memory that this process no longer uses to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass


def groups_for(rows: int, per_group: int) -> int:
    """How many groups keep each one near ``per_group`` rows."""
    return max(1, -(-rows // per_group))
