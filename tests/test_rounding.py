from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from casework.functions.rounding import round_binary
from casework.operators.features import velocity


def _rounded(spark, pairs, places=4):
    frame = spark.createDataFrame(pairs, "n long, d long")
    return [(r.n, r.d, r.v) for r in frame.select("n", "d", round_binary(F.col("n") / F.col("d"), places).alias("v")).collect()]


def test_values_by_hand(spark):
    want = {(3, 20000): 0.0001, (1, 32): 0.0312, (3, 32): 0.0938, (1, 20000): 0.0001, (0, 7): 0.0, (7, 1): 7.0, (1, 3): 0.3333, (2, 3): 0.6667,
            (5, 32): 0.1562, (100_001, 100_000): 1.0, (99_999, 100_000): 1.0, (1, 1_000_000_000): 0.0}
    assert {(n, d): v for n, d, v in _rounded(spark, list(want))} == want


def test_random_ratios_are_those_of_python(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(1, 10 ** rng.randrange(1, 7)), rng.randrange(1, 10 ** rng.randrange(1, 6))) for _ in range(60_000)]
    pairs += [(rng.randrange(1, 200_000), d) for d in (32, 160, 800, 4000, 20000, 64, 320) for _ in range(6_000)]
    wrong = [(n, d, v) for n, d, v in _rounded(spark, pairs) if v != round(n / d, 4)]
    assert not wrong
    for places in (0, 1, 2, 3):
        assert not [x for x in _rounded(spark, pairs[:5000] + pairs[-5000:], places) if x[2] != round(x[0] / x[1], places)]


def test_velocity(spark):
    rows = spark.createDataFrame([(3, 20000), (1, 32), (5, 0), (5, -1), (5, None), (None, 3)], "n int, d int")
    got = [r.v for r in rows.select(velocity(F.col("n"), F.col("d")).alias("v")).collect()]
    assert got == [0.0001, 0.0312, 0.0, 0.0, 0.0, None]
    with pytest.raises(ValueError):
        round_binary(F.lit(1.0), 5)
