"""Quality by a sparse ensemble of rules over text statistics.

Statistics of the whole text are column expressions. Trees fitted on labelled
rows give rules: each path from the root is a conjunction of thresholds. A
logistic regression with an L1 penalty keeps the rules that matter, and what
it keeps is compiled back into one column expression, so scoring is a narrow,
generated projection over any number of documents.

The fit uses at most ``max_rows`` labelled rows, those with the smallest hash of their id.
A null or empty text has statistics (zeros) and a score. Rows that repeat are
scored each. Labels that are null, neither 0 nor 1, or without a document are
not used; with labels of one kind alone, or none, the score is their mean (0.5). An
empty table gives an empty result. Only the id and the text are read, so names
cannot clash.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.llm.common import id_and_text, written

#: Labelled rows that a fit may use.
MAX_ROWS = 20_000

Condition = tuple[str, str, float]  # statistic, "<=" or ">", threshold


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the statistics in place of the text."""
    others = [c for c in docs.columns if c != "text"]
    cut = docs.select(*others, "text", F.length("text").alias("chars"),
                      F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"),
                      F.array_remove(F.split("text", "\n"), "").alias("lines"))
    without = lambda pattern: F.col("chars") - F.length(F.regexp_replace("text", pattern, ""))
    counted = cut.select(
        *others, "chars", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct"),
        F.size("lines").alias("n_lines"), F.size(F.array_distinct("lines")).alias("n_distinct_lines"),
        without(r"\p{Lu}+").alias("upper"), without(r"\p{Nd}+").alias("digits"), without(r"[#*$%&|<>]+").alias("symbols"),
        without("[!?]+").alias("marks"), without("[.,;:]+").alias("stops"), without(r"[\x20\x09-\x0D]+").alias("spaces"),
        F.coalesce(F.array_max(F.transform("words", F.length)), F.lit(0)).alias("longest"))
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return counted.select(
        *others, F.log1p(F.col("n_words")).alias("words_log"), per("n_distinct", "n_words").alias("distinct_share"),
        (F.col("n_distinct") / F.greatest(F.sqrt("n_words"), F.lit(1))).alias("distinct_by_root"),
        per("n_distinct_lines", "n_lines").alias("distinct_line_share"), per("n_words", "n_lines").alias("words_a_line"),
        per("upper", "chars").alias("upper_share"), per("digits", "chars").alias("digit_share"),
        per("symbols", "n_words").alias("symbols_a_word"), per("marks", "n_words").alias("marks_a_word"),
        per("stops", "n_words").alias("stops_a_word"), ((F.col("chars") - F.col("spaces")) / F.greatest("n_words", F.lit(1))).alias("word_length"),
        F.col("longest").cast("double").alias("longest_word"))


STATISTICS = ("words_log", "distinct_share", "distinct_by_root", "distinct_line_share", "words_a_line", "upper_share", "digit_share",
              "symbols_a_word", "marks_a_word", "stops_a_word", "word_length", "longest_word")


def holds(rule: tuple[Condition, ...]) -> Column:
    """A rule as a column expression."""
    return functools.reduce(operator.and_, [F.col(s) <= t if sign == "<=" else F.col(s) > t for s, sign, t in rule])


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted rules; the score is the logistic of their sum."""

    rules: tuple[tuple[tuple[Condition, ...], float], ...]
    intercept: float

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def tree_paths(description: str, names: tuple[str, ...]) -> list[tuple[Condition, ...]]:
    """Every path below the root of each tree, from the model's description."""
    found, path = [], []
    for line in description.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if m:
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, (names[int(m[2])], m[3], float(m[4])))]
            found.append(simplest(c for _, c in path))
    return sorted(set(found))


def simplest(conditions) -> tuple[Condition, ...]:
    """One bound per statistic and side, the tightest."""
    bounds: dict[tuple[str, str], float] = {}
    for s, sign, t in conditions:
        known = bounds.setdefault((s, sign), t)
        bounds[s, sign] = min(known, t) if sign == "<=" else max(known, t)
    return tuple(sorted((s, sign, t) for (s, sign), t in bounds.items()))


def fit_rules(rows: DataFrame, trees: int = 24, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleEnsemble:
    """``rows``: the statistics and ``label``, a bounded number of them."""
    n, positive = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or positive in (0, n):
        share = positive / n if n else 0.5
        return RuleEnsemble((), math.log((share + 1e-3) / (1 - share + 1e-3)))
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows).select("features", F.col("label").cast("double"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="0.5", subsamplingRate=0.7, seed=seed)
    rules = tree_paths(forest.fit(vectors).toDebugString, STATISTICS)
    if not rules:
        return RuleEnsemble((), math.log((positive + 1) / (n - positive + 1)))
    marks = [holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)]
    # Rows that meet the same rules count as one with their number as weight.
    marked = rows.select(F.col("label").cast("double").alias("label"), F.array(*marks).alias("met"))
    grouped = written(marked.groupBy("label", "met").agg(F.count("*").cast("double").alias("weight")).coalesce(1).sortWithinPartitions("label", "met"), "rule-patterns")
    inputs = grouped.select("label", "weight", *[F.col("met")[i].alias(f"r{i}") for i in range(len(rules))])
    inputs = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(inputs)
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, weightCol="weight", standardization=False, maxIter=60)
    model = lasso.fit(inputs)
    kept = tuple((r, float(w)) for r, w in zip(rules, model.coefficients) if abs(w) > 1e-6)
    return RuleEnsemble(kept, float(model.intercept))


def held_out(id_col: str) -> Column:
    """Rows that training never sees."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Statistics and label of at most ``max_rows`` labelled rows."""
    label = F.col("quality").cast("int").alias("label")
    usable = labels.select(F.col("doc_id").cast("long").alias("label_id"), label).where("label in (0, 1) and label_id is not null")
    usable = usable.where(~held_out("label_id")).groupBy("label_id").agg(F.max("label").alias("label"))
    chosen = usable.orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    # ``max_rows`` bounds what is broadcast.
    rows = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["label_id"]).select("doc_id", "text", "label")
    return written(text_statistics(rows), "labelled-statistics")


def fitted(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> RuleEnsemble:
    rows = training_rows(docs, labels, max_rows)
    # Repeated documents of a label do not push the sample beyond its bound.
    rows = rows.orderBy(F.xxhash64("doc_id"), *STATISTICS).limit(max_rows).coalesce(1)
    return fit_rules(written(rows, "training-sample"))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_ROWS,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    docs = id_and_text(docs, id_col, text_col)
    model = fitted(docs, labels, max_rows)
    rows = text_statistics(docs).select("doc_id", held_out("doc_id").alias("held_out"), model.score().alias("score"))
    return rows.select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_ROWS,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that reach the threshold, as they are."""
    model = fitted(id_and_text(docs, id_col, text_col), labels, max_rows)
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    rows = docs.select(row.alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # A condition would be moved below the projection, which puts the
    # statistics' expressions in place of their names, once for each rule. A
    # column that must not be evaluated twice holds it above.
    rows = text_statistics(rows).select("row", model.score().alias("score"), F.monotonically_increasing_id().alias("at"))
    return rows.where((F.col("score") >= threshold) & (F.col("at") >= 0)).select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
