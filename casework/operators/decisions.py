"""Outcome of each case from its movement history (F1, F2, F6, F8, A2,
A14-A19, O6, O7).

Per-hit work uses higher-order functions on the movement list (no explode,
no shuffle). "First decision per case" is one partial aggregate
(``min_by``) keyed by case number, so a case number that appears in a huge
number of hits is combined map-side before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework import constants as K
from casework.functions import arrays as A
from casework.operators.sequence import with_sequence


def decisions_per_case(cases: DataFrame) -> DataFrame:
    """Decision names per first-instance hit, in movement order;
    hits without any decision are dropped."""
    names = A.decision_names("movimentos", "grau")
    return (cases.select("hit_pos", "numero_processo", names.alias("decisoes"))
            .filter(F.size("decisoes") > 0))


def first_decision(cases: DataFrame) -> DataFrame:
    """The first decision of each case number (hit order, then
    movement order) -- chosen *before* any filter on its type (N1)."""
    first = F.get(A.decision_names("movimentos", "grau"), 0)
    per_hit = cases.select("numero_processo", "hit_pos", first.alias("tipo_decisao")) \
        .filter(F.col("tipo_decisao").isNotNull())
    picked = F.min_by(F.struct("tipo_decisao", "hit_pos"), F.col("hit_pos"))
    return (per_hit.groupBy("numero_processo").agg(picked.alias("d"))
            .select("numero_processo", F.col("d.tipo_decisao").alias("tipo_decisao"),
                    F.col("d.hit_pos").alias("hit_pos")))


def type_order(col: str = "tipo_decisao"):
    """1-based position of an outcome type in the fixed order, null if absent."""
    pos = F.array_position(F.array(*[F.lit(t) for t in K.OUTCOME_TYPES]), F.col(col))
    return F.when(pos > 0, pos.cast("int"))


def decisions_union(first: DataFrame) -> DataFrame:
    """Keep the four outcome types (exact match), tagged with the
    order in which the four frames are concatenated."""
    return (first.withColumn("type_order", type_order())
            .filter(F.col("type_order").isNotNull()))


def favourable(col: str = "tipo_decisao"):
    """F8: binary target from the decision name."""
    return F.col(col).contains(F.lit(K.FAVOURABLE_MARKER))


def decision_type_top(cases: DataFrame, n: int = K.TOP_DECISION_TYPES) -> DataFrame:
    """A2: most common decision names over all first-instance decisions."""
    names = A.decision_names("movimentos", "grau")
    return (cases.select(F.explode(names).alias("tipo_decisao"))
            .groupBy("tipo_decisao").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("tipo_decisao")).limit(n))


def decision_type_rollup(union: DataFrame, total_label: str = "Total") -> DataFrame:
    """Rows per outcome type plus the grand total."""
    return (union.rollup("tipo_decisao").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("tipo_decisao").alias("g"))
        .select(F.when(F.col("g") == 1, F.lit(total_label)).otherwise(F.col("tipo_decisao"))
                .alias("tipo_decisao"), "n"))


def decision_coverage(cases: DataFrame) -> DataFrame:
    """Hits with at least one decision vs all hits."""
    has = F.size(A.decision_names("movimentos", "grau")) > 0
    return cases.agg(F.count_if(has).alias("com_decisao"), F.count(F.lit(1)).alias("total"))


def text_estimate(union: DataFrame, share: float = K.PUBLIC_TEXT_SHARE) -> DataFrame:
    """Expected number of cases with public text = floor(n * share)."""
    n = F.count(F.lit(1))
    return union.agg(n.alias("n_decisoes"),
                     F.floor(n * F.lit(share)).cast("long").alias("estimativa_com_texto"))


def distinct_cases(union: DataFrame) -> DataFrame:
    """Distinct case numbers in order of first appearance in the
    type-ordered table, numbered 1..N (distributed numbering)."""
    firsts = union.groupBy("numero_processo").agg(
        F.min(F.struct("type_order", "hit_pos")).alias("k"))
    ordered = with_sequence(firsts, [F.col("k")], "ordem", start=1)
    return ordered.select(F.col("numero_processo").alias("numeroProcesso"), "ordem")


def block_sample(union: DataFrame, target: int, block: int = K.BLOCK_SIZE,
                 skip: int = K.BLOCK_SKIP, by: str = "tipo_decisao",
                 order: str = "hit_pos") -> DataFrame:
    """Per class, take ``block`` rows, skip ``skip``, until ``target``
    rows are reached (whole blocks). Only the first ``ceil(target/block)``
    strides of each class can be selected.

    A class is a hot group (a few classes hold all rows), so its positions are
    not computed in one task: they are the range-partitioned global sequence
    minus each class's first sequence number (a per-class aggregate)."""
    stride = block + skip
    limit = math.ceil(target / block) * stride
    seq = with_sequence(union.select("numero_processo", by, order), [F.col(by), F.col(order)], "_seq")
    starts = seq.groupBy(by).agg(F.min("_seq").alias("_start"))
    ranked = (seq.join(starts, by).withColumn("p", F.col("_seq") - F.col("_start"))
              .filter(F.col("p") < limit))
    return ranked.filter((F.col("p") % stride) < block).select("numero_processo", by, order, F.col("p").cast("int").alias("p"))
