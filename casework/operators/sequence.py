"""Dense sequence numbers (0..N-1 or 1..N) following a total order, computed
without a single-partition window.

Plan: range-partition on the order keys (balanced by sampling, so a hot key
value does not produce one huge task as long as the keys are a total order),
sort inside each partition, tag each row with its partition id and local
index, materialise that once with ``checkpoint()`` so every later read sees
identical partitions, count rows per partition (a table with one row per
partition), turn the counts into prefix offsets and broadcast them back.
The broadcast side has exactly ``num_partitions`` rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casework.session import scratch_dir

_LOCAL_BITS = 33  # monotonically_increasing_id: partition id above bit 33


def _partitions_for(df: DataFrame, unpacked: int = 1) -> int:
    """Range partitions sized from the optimizer's size estimate (no job):
    about one advisory-size partition each, never fewer than the configured
    shuffle partitions; an unknown estimate falls back to that setting.

    Without statistics the optimizer takes a join for the product of its sides, so the
    estimate counts no more than all that the plan reads."""
    spark = df.sparkSession
    base = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    target = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
    target_bytes = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(target))
    try:
        plan = df._jdf.queryExecution().optimizedPlan()
        leaves = plan.collectLeaves()
        read = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
        est = min(int(str(plan.stats().sizeInBytes())), read) * unpacked
    except Exception:  # noqa: BLE001 - no estimate: keep the setting
        return base
    if est >= 1 << 62:
        return base
    return max(base, math.ceil(est / max(1, target_bytes)))


#: Bytes of a row in a shuffle for one in a Parquet file of numbers.
_UNPACKED = 6


def hash_partitions(df: DataFrame) -> int:
    """Partitions for a shuffle of ``df``, by the files it reads: adaptive execution merges
    small partitions but does not split large ones, which would spill."""
    return _partitions_for(df, _UNPACKED)


def with_sequence(df: DataFrame, order: list[Column], name: str = "seq", start: int = 0,
                  num_partitions: int | None = None, materialize: bool = False) -> DataFrame:
    """Add ``name`` = position of the row in ``order`` plus ``start``.

    ``order`` must be a total order (ties make the numbering arbitrary among
    the tied rows, as with ``row_number``). With ``materialize`` the input is
    checkpointed first, so an expensive input plan is computed once instead
    of once for the range-bound sampling and once for the shuffle.
    """
    scratch_dir(df.sparkSession)  # make sure a checkpoint dir exists
    n = num_partitions or _partitions_for(df)
    if materialize:
        df = df.checkpoint(eager=True)
        n = max(n, _partitions_for(df)) if num_partitions is None else n
    tagged = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_seq_mid", F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    part = F.shiftright(F.col("_seq_mid"), _LOCAL_BITS)
    local = F.col("_seq_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    tagged = tagged.withColumns({"_seq_part": part, "_seq_local": local})
    counts = tagged.groupBy("_seq_part").agg(F.count(F.lit(1)).alias("_seq_n"))
    # One row per partition: a bounded table, so a global window is fine here.
    prefix = Window.orderBy("_seq_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_seq_part", F.coalesce(F.sum("_seq_n").over(prefix), F.lit(0)).alias("_seq_off"))
    return (
        tagged.join(F.broadcast(offsets), "_seq_part")
        .withColumn(name, F.col("_seq_off") + F.col("_seq_local") + F.lit(start))
        .drop("_seq_mid", "_seq_part", "_seq_local", "_seq_off")
    )


