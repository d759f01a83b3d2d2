"""Range partitions follow what a plan reads, not the product of its join's sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from casework.operators import sequence as S


def test_a_join_asks_for_no_more_partitions_than_it_reads(spark):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    try:
        left, right = spark.range(20_000), spark.range(0, 20_000, 2)
        joined = left.join(right.hint("shuffle_merge"), "id")
        # 8 bytes a value: 240,000 bytes are read.
        assert S._partitions_for(joined) <= 60
        rows = S.with_sequence(joined, [F.col("id")], "n", start=1)
        assert rows.where("n <> id / 2 + 1").isEmpty()
        assert rows.count() == 10_000
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
