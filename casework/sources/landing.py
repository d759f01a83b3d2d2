"""Landing: materialise a derived table once, as Parquet in the shared
scratch folder, and read it from there afterwards.

The key is a fingerprint of the inputs (path, size, modification time), so a
changed input lands a new table. Every landing writes to a path of its own and, when
all is written, publishes a small pointer file that names it. Readers follow
pointers only, so an interrupted landing is never read and simply done again,
and two jobs that land the same table do not meet. Nothing is renamed.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casework.session import scratch_dir


def file_system(spark: SparkSession, path: str):
    """The path and its file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    h = hashlib.sha1()
    for path in paths:
        p, fs = file_system(spark, path)
        st = fs.getFileStatus(p)
        size = fs.getContentSummary(p).getLength() if st.isDirectory() else st.getLen()
        h.update(f"{path}|{size}|{st.getModificationTime()}\n".encode())
    return h.hexdigest()[:16]


def _published(spark: SparkSession, folder: str) -> str | None:
    """The landed table that the first pointer names, if there is one."""
    p, fs = file_system(spark, f"{folder}/pointers")
    if not fs.exists(p):
        return None
    names = sorted(status.getPath().getName() for status in fs.listStatus(p))
    return f"{folder}/{names[0]}" if names else None


def land(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """Read the landed table, building it first when none is published. If
    two jobs publish one each, both are whole and every reader takes the
    same."""
    folder = f"{scratch_dir(spark)}/landed/{name}-{fingerprint(spark, inputs)}"
    path = _published(spark, folder)
    if path is None:
        version = uuid.uuid4().hex
        build().write.mode("errorifexists").parquet(f"{folder}/{version}")
        pointer, fs = file_system(spark, f"{folder}/pointers/{version}")
        fs.create(pointer, False).close()
        path = _published(spark, folder)
    return spark.read.parquet(path)
