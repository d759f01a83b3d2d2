from __future__ import annotations

import math
import zlib

import pytest
from pyspark.sql import functions as F

from casework.llm import rule_ensemble as R
from tests.conftest import SF_CHECK


def test_paths_of_a_description():
    text = """RandomForestClassificationModel: uid=x
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 0 <= 0.25)
      Predict: 0.0
     Else (feature 0 > 0.25)
      Predict: 1.0
    Else (feature 0 > 0.5)
     Predict: 1.0
"""
    a = "words_log"
    assert R.tree_paths(text, (a,)) == sorted([((a, "<=", 0.5),), ((a, "<=", 0.25),), ((a, "<=", 0.5), (a, ">", 0.25)), ((a, ">", 0.5),)])


def test_compiled_rules_match_plain_python(spark):
    model = R.RuleEnsemble(((((("words_log"), "<=", 2.0), ("upper_share", ">", 0.1)), 1.5), ((("words_log", ">", 2.0),), -0.75)), 0.25)
    rows = [(x / 4, u / 10) for x in range(16) for u in range(4)]
    frame = spark.createDataFrame(rows, "words_log double, upper_share double")
    for r in frame.select("*", model.score().alias("score")).collect():
        z = 0.25 + 1.5 * (r.words_log <= 2 and r.upper_share > 0.1) - 0.75 * (r.words_log > 2)
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF_CHECK}/{t}.parquet") for t in ("documents", "labels"))
    out = R.scored(docs, labels)
    rows = out.join(labels, "doc_id").collect()
    assert out.count() == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert r.predicted == (r.score >= 0.3)
    test = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in test) / len(test) > 0.93
    good = [r.score for r in test if r.quality == 1]
    bad = [r.score for r in test if r.quality == 0]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.93


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1, 2.0), (2, "", 1, 2.0), (2, "", 1, 2.0), (None, "a b", 1, 2.0), (3, "x" * 100_000, 0, 1.0)],
                                 "doc_id long, text string, label int, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [round(r.score, 6) for r in R.scored(docs, none).collect()] == [0.5] * 5
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 1), (None, 0), (77, 0), (3, 5)], "doc_id long, quality int")
    assert all(r.score > 0.9 for r in R.scored(docs, labels).collect())
    assert R.scored(docs.limit(0), labels).count() == 0
    many = docs.withColumn("doc_id", F.lit(8).cast("long"))
    assert R.scored(many, labels).count() == 5
