"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least one near it."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the least one."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionAll(least.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node and component (its least node) of every node in ``links`` (a, b).

    Minima are summed before the shuffle and joined back, so a node with very many
    neighbours is never gathered in one place. Rounds grow with the logarithm of
    the number of nodes.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = written(edges, "links")
    before = _state(edges)
    for _ in range(most_rounds):
        edges = written(_small_star(_large_star(edges)).distinct(), "stars")
        after = _state(edges)
        if after == before:
            nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
