from __future__ import annotations

from pyspark.sql import functions as F

from casework.sources.writers import write_filtered


def test_counts_come_from_the_write(spark, tmp_path):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, F.lit("x")).alias("texto")).repartition(7)
    reads = spark.sparkContext.accumulator(0)

    def once(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    counts = write_filtered(rows.mapInArrow(once, rows.schema), F.col("id") < 100, str(tmp_path / "kept"), F.col("texto").isNotNull())
    assert counts == {"n_total": 1000, "n_mantidos": 100, "n_marcados": 34}
    assert reads.value == 1000  # every row once
    kept = spark.read.parquet(str(tmp_path / "kept"))
    assert kept.count() == 100 and kept.where("texto is not null").count() == 34


def test_empty_tables_and_null_conditions(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "a")], "id long, texto string")
    assert write_filtered(rows.limit(0), F.col("id") > 0, str(tmp_path / "a"), F.lit(True)) == {"n_total": 0, "n_mantidos": 0, "n_marcados": 0}
    # A null condition keeps no row.
    assert write_filtered(rows, F.col("texto") == "a", str(tmp_path / "b"), F.col("texto") == "b") == {"n_total": 2, "n_mantidos": 1, "n_marcados": 0}
