"""Resumable collection (S8, K8, J4, J5) as incremental batch and as a
Structured Streaming job.

The original keeps a JSON progress file, rewritten every few records. Here the
progress is a log of Parquet batches in a shared folder, each split by a hash of the key
(``parte``), and a summary into which older batches are merged. A batch is written by
overwriting its own folder, so doing one again changes nothing, and a failure
leaves the batches before it. A rerun keeps the records of the current list (semi
join) and works only on the pending keys (anti join). The streaming face reads new
saved pages from a directory; each micro-batch is a batch by its id.

:func:`compact` merges in three steps: write a new summary, publish a manifest that names it
and the batches in it, remove what the manifest makes superfluous. Readers follow the
newest manifest and leave its merged batches out, so a failure between any two steps loses and doubles
nothing, and the next writer takes up the removal. Of the records of a key the newest wins: those of batches
come after the summary's, and among batches the last name's. One collector writes at a time; who
holds a table read before a compaction reads it anew.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casework.operators.joins import anti, semi
from casework.sources.landing import file_system

RECORD_SCHEMA = T.StructType([
    T.StructField("numero_processo", T.StringType()),
    T.StructField("juiz", T.StringType()),
    T.StructField("requerente", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("texto_decisao", T.StringType()),
])
STORED_SCHEMA = T.StructType([*RECORD_SCHEMA.fields, T.StructField("lote", T.StringType()), T.StructField("parte", T.IntegerType())])
#: Shares of the key space; a small batch reads the shares of its keys.
SHARES = 64
#: Batches beside the summary after which they are merged into it.
COMPACT_AFTER = 16


def _share(key: str = "numero_processo") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SHARES)).cast("int")


def _by_share(rows: DataFrame) -> DataFrame:
    """Each share in one task, so that it becomes one file; large ones are split by
    size where the plan adapts."""
    adaptive = rows.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true"
    return rows.hint("rebalance", "parte") if adaptive else rows.repartition("parte")


@dataclass(frozen=True)
class Progress:
    """What a progress folder holds: its summary, the batches merged into
    it (some may still lie there) and the batches to read besides."""

    summary: str | None
    merged: tuple[str, ...]
    batches: tuple[str, ...]


def _names(spark: SparkSession, folder: str) -> list[str]:
    p, fs = file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def progress_state(spark: SparkSession, path: str) -> Progress:
    """The newest manifest, and the batches that it does not name."""
    manifests = [n for n in _names(spark, f"{path}/manifesto") if n.endswith(".json")]
    known = {"resumo": None, "fundidos": []}
    if manifests:
        p, fs = file_system(spark, f"{path}/manifesto/{manifests[-1]}")
        stream = fs.open(p)
        try:
            known = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
    batches = [n.removeprefix("lote=") for n in _names(spark, path) if n.startswith("lote=")]
    return Progress(known["resumo"], tuple(known["fundidos"]), tuple(b for b in batches if b not in known["fundidos"]))


def _publish(spark: SparkSession, path: str, summary: str | None, merged: tuple[str, ...]) -> None:
    """The next manifest, written under another name first, so that it is whole when it is seen."""
    before = [n for n in _names(spark, f"{path}/manifesto") if n.endswith(".json")]
    number = int(before[-1].removesuffix(".json")) + 1 if before else 0
    draft, fs = file_system(spark, f"{path}/manifesto/{uuid.uuid4().hex}.tmp")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps({"resumo": summary, "fundidos": list(merged)}).encode()))
    out.close()
    if not fs.rename(draft, file_system(spark, f"{path}/manifesto/{number:012d}.json")[0]):
        raise RuntimeError(f"manifest {number} of {path} could not be published")


def _remove(spark: SparkSession, folder: str) -> None:
    p, fs = file_system(spark, folder)
    fs.delete(p, True)


def _tidied(spark: SparkSession, path: str) -> Progress:
    """Remove merged batches, other summaries and older manifests; the last step
    of a compaction, taken up by the next writer after a failure."""
    state = progress_state(spark, path)
    if state.merged:
        for batch in state.merged:
            _remove(spark, f"{path}/lote={batch}")
        _publish(spark, path, state.summary, ())
    for name in _names(spark, f"{path}/resumo"):
        if name != state.summary:
            _remove(spark, f"{path}/resumo/{name}")
    for name in _names(spark, f"{path}/manifesto")[:-1]:
        _remove(spark, f"{path}/manifesto/{name}")
    return Progress(state.summary, (), state.batches)


def _batches(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    if not names:
        return spark.createDataFrame([], STORED_SCHEMA)
    return spark.read.schema(STORED_SCHEMA).option("basePath", path).parquet(*[f"{path}/lote={n}" for n in names])


def _stored(spark: SparkSession, path: str, shares: list[int] | None = None) -> DataFrame:
    """One row for each stored key, with its batch and share; of the given shares, or all.

    Only the batches are aggregated. The summary has one row for each key already and is read as
    it lies, without the keys that the batches hold too. Only a path that does not exist
    is empty; any other failure to read is an error."""
    state = progress_state(spark, path)
    chosen = (lambda df: df) if shares is None else (lambda df: df.where(F.col("parte").isin(shares)))
    rest = [c for c in STORED_SCHEMA.fieldNames() if c not in ("numero_processo", "parte")]
    order = F.struct("lote", *[c for c in rest if c != "lote"])
    newest = chosen(_batches(spark, path, state.batches)).groupBy("parte", "numero_processo").agg(F.max_by(F.struct(*rest), order).alias("r"))
    newest = newest.select("numero_processo", *[f"r.{c}" for c in rest], "parte").select(*STORED_SCHEMA.fieldNames())
    if state.summary is None:
        return newest
    folder = f"{path}/resumo/{state.summary}"
    summary = chosen(spark.read.schema(STORED_SCHEMA).option("basePath", folder).parquet(folder))
    if not state.batches:
        return summary
    again = chosen(_batches(spark, path, state.batches)).select(F.col("parte").alias("_p"), F.col("numero_processo").alias("_k"))
    same = (F.col("parte") == F.col("_p")) & F.col("numero_processo").eqNullSafe(F.col("_k"))
    return summary.join(again, same, "left_anti").unionByName(newest)


def shares_of(keys: DataFrame, key: str = "numero_processo") -> list[int]:
    """The shares in which the keys lie, at most ``SHARES`` numbers."""
    return sorted(r[0] for r in keys.select(_share(key)).distinct().collect())


def read_progress(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """Processed records so far, one for each key (the newest). With ``keys`` (a column
    numero_processo) only the shares of those keys are read, which hold other keys too."""
    shares = None if keys is None else shares_of(keys)
    return _stored(spark, path, shares).select(*RECORD_SCHEMA.fieldNames())


def store_batch(records: DataFrame, path: str, batch: str) -> None:
    """Write one batch of records; writing it again replaces it."""
    spark = records.sparkSession
    if batch in progress_state(spark, path).merged:
        _tidied(spark, path)  # else the manifest would hide it
    rows = records.select(*RECORD_SCHEMA.fieldNames(), _share().alias("parte"))
    _by_share(rows).write.mode("overwrite").partitionBy("parte").parquet(f"{path}/lote={batch}")


def compact(spark: SparkSession, path: str, after: int = 0) -> bool:
    """Merge the batches into the summary if there are more than ``after`` of them.

    Afterwards the folder holds one file for each share (more where a share is large),
    however many batches there were."""
    if len(progress_state(spark, path).batches) <= after:
        return False
    state = _tidied(spark, path)
    name = uuid.uuid4().hex
    _by_share(_stored(spark, path)).write.partitionBy("parte").parquet(f"{path}/resumo/{name}")
    _publish(spark, path, name, state.batches)
    _tidied(spark, path)
    return True


def plan_run(listed: DataFrame, progress: DataFrame, key: str = "numero_processo") -> dict[str, DataFrame]:
    """Records of the listed keys already done, and the pending keys."""
    kept = semi(progress, listed, key)
    pending = anti(listed.select(key).distinct(), progress, key)
    return {"kept": kept, "pending": pending}


def run_counts(listed: DataFrame, progress: DataFrame, key: str = "numero_processo") -> DataFrame:
    """One row: list size, progress size, progress keys in the list, ignored
    progress keys, pending keys. Keys count once, however often they are stored."""
    keys = listed.select(key).distinct().withColumn("_listed", F.lit(True))
    prog = progress.select(key).distinct().withColumn("_done", F.lit(True))
    both = keys.join(prog, key, "full_outer")
    return both.agg(
        F.count_if(F.col("_listed")).alias("n_lista"),
        F.count_if(F.col("_done")).alias("n_cache"),
        F.count_if(F.col("_done") & F.col("_listed")).alias("n_cache_na_lista"),
        F.count_if(F.col("_done") & F.col("_listed").isNull()).alias("n_ignorados"),
        F.count_if(F.col("_listed") & F.col("_done").isNull()).alias("n_pendentes"))


def run_incremental(listed: DataFrame, pages: DataFrame, progress_path: str,
                    extract: Callable[[DataFrame], DataFrame], key: str = "numero_processo",
                    batches: int = 1, compact_after: int = COMPACT_AFTER) -> DataFrame:
    """Process the pending keys' pages in ``batches`` parts, each stored when
    done, and return the records of the whole list (previous and new)."""
    spark = listed.sparkSession
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex}"  # runs sort by time
    keys = listed.select(F.col(key).alias("numero_processo"))
    for i in range(batches):
        # What is pending follows from what is stored, batch by batch.
        pending = plan_run(listed, read_progress(spark, progress_path, keys), key)["pending"]
        part = pending.where(F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(batches)) == i)
        store_batch(extract(semi(pages, part, key)), progress_path, f"{run}-{i:06d}")
    compact(spark, progress_path, compact_after)
    return plan_run(listed, read_progress(spark, progress_path, keys), key)["kept"]


def start_page_stream(spark: SparkSession, pages_dir: str, pages_schema: T.StructType,
                      progress_path: str, checkpoint_path: str,
                      extract: Callable[[DataFrame], DataFrame], trigger_once: bool = True,
                      files_per_trigger: int = 1000, compact_after: int = COMPACT_AFTER):
    """Streaming face: new page files -> extracted records stored per
    micro-batch. Returns the ``StreamingQuery``."""
    stream = spark.readStream.schema(pages_schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pages_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        session, name = batch.sparkSession, f"stream-{batch_id:012d}"
        # Keys stored by other batches are done; the shares of this batch's
        # keys are all that is read of the progress.
        stored = _stored(session, progress_path, shares_of(batch)).where(F.col("lote") != name)
        keyed = batch.withColumn("parte", _share())
        fresh = keyed.join(stored.select("parte", "numero_processo"), ["parte", "numero_processo"], "left_anti")
        store_batch(extract(fresh.drop("parte")), progress_path, name)
        compact(session, progress_path, compact_after)

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_path)
    writer = writer.trigger(availableNow=True) if trigger_once else writer.trigger(processingTime="30 seconds")
    return writer.start()
