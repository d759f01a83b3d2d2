"""Join helpers: lookup with last-wins dedupe, semi/anti membership. Whether
a side is broadcast is left to adaptive execution, which knows its bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def dedupe_last(df: DataFrame, key: str, value_cols: list[str], position: Column | str) -> DataFrame:
    """One row per ``key`` holding the values of the row with the greatest
    ``position`` ("last duplicate wins", like filling a dict in file order).
    A partial aggregate (``max_by``), so hot keys are combined map-side."""
    pos = F.col(position) if isinstance(position, str) else position
    packed = F.struct(*[F.col(c) for c in value_cols])
    return (df.groupBy(key)
            .agg(F.max_by(packed, pos).alias("_last"))
            .select(key, *[F.col("_last")[c].alias(c) for c in value_cols]))


def lookup_left(df: DataFrame, lookup: DataFrame, key: str, value_cols: list[str],
                position: Column | str) -> DataFrame:
    """Left lookup: each row of ``df`` gets the values of ``lookup`` for its
    key (last duplicate in ``position`` order wins), null when absent."""
    return df.join(dedupe_last(lookup, key, value_cols, position), key, "left")


def semi(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys`` (hash semi join)."""
    return df.join(keys.select(key), key, "left_semi")


def anti(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``keys``."""
    return df.join(keys.select(key), key, "left_anti")
