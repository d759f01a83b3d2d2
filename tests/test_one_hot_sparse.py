"""Sparse one-hot vectors against the wide columns, and the plan that numbers the values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from casework.operators import features as FT


def test_vectors_are_the_wide_columns(spark):
    values = ["Dano Moral", "acordo", None, "dano moral", "Dano Moral", "Ação", "x", "acordo", "ACAO", ""]
    df = spark.createDataFrame(list(enumerate(values)), "pos long, assunto string")
    wide = df.select("pos", *[c.alias(n) for n, c in FT.one_hot_columns(
        "assunto", [v for v in FT.vocabulary(df, "assunto", "pos") if v[0] is not None], []).items()])
    index = FT.vocabulary_index(df, "assunto", "pos")
    got = {r.pos: r.vetor for r in FT.one_hot_sparse(df, "assunto", index).collect()}
    assert [r.name for r in index.orderBy("index").collect()] == wide.columns[1:]
    for r in wide.na.fill(0).collect():
        assert list(got[r.pos].toArray()) == list(r)[1:], r
    assert len(got) == len(values) and all(v.size == len(wide.columns) - 1 for v in got.values())


def test_many_values_stay_sparse(spark):
    df = spark.range(60_000).select(F.col("id").alias("pos"), F.concat(F.lit("v"), (F.col("id") % 50_000).cast("string")).alias("assunto"))
    index = FT.vocabulary_index(df, "assunto", "pos")
    rows = FT.one_hot_sparse(df, "assunto", index).where("pos >= 49999").orderBy("pos").limit(2).collect()
    assert [(r.vetor.size, list(r.vetor.indices)) for r in rows] == [(50_000, [49_999]), (50_000, [0])]


def test_no_values(spark):
    df = spark.createDataFrame([(1, None)], "pos long, assunto string")
    with pytest.raises(ValueError):
        FT.one_hot_sparse(df, "assunto", FT.vocabulary_index(df, "assunto", "pos"))
