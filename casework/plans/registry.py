"""Registry of named queries: Spark builder + DuckDB oracle SQL.

``QUERIES[name] = (builder(spark, sf_dir) -> DataFrame, sql | None)``. Output
columns are scalars with identical names on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict[str, tuple[Builder, str | None]]:
    # Importing the modules registers their queries.
    from casework.plans import (  # noqa: F401
        q_decisions, q_edges, q_features, q_joins, q_pages, q_quality, q_roundtrip, q_scalars, q_search, q_time)

    return QUERIES
