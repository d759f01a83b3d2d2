"""Flagship slice: outcome counts of the selected cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casework.operators import decisions as D
from casework.plans import datasets as DS


def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.decision_type_rollup(DS.union(spark, sf_dir))
