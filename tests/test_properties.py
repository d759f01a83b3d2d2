"""Properties of the pipeline outputs on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from casework import constants as K
from casework.operators import analytics as AN
from casework.operators import decisions as D
from casework.operators.joins import anti, semi
from casework.operators.sequence import with_sequence
from casework.plans import datasets as DS
from tests.conftest import SF_SMALL


def test_sequence_is_dense_and_ordered(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("k"))
    out = with_sequence(df, [F.col("k").desc()], "seq", start=1, num_partitions=5)
    rows = out.orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(1, 5001))
    ks = [r.k for r in rows]
    assert ks == sorted(ks, reverse=True)


def test_ml_ids_are_one_to_n_and_one_hot_sums_to_one(spark):
    ml = DS.ml_dataset(spark, SF_SMALL)
    n = ml.count()
    ids = ml.agg(F.min("id"), F.max("id"), F.countDistinct("id")).first()
    assert tuple(ids) == (1, n, n)
    hot = [c for c in ml.columns if c.startswith("eh_") and c not in ("eh_segunda", "eh_sexta", "eh_horario_almoco")]
    assert hot
    assert ml.filter(sum(F.col(c) for c in hot) != 1).count() == 0


def test_semi_plus_anti_partition_hits(spark):
    cases = DS.cases(spark, SF_SMALL)
    sel = DS.union(spark, SF_SMALL)
    a, s = anti(cases, sel, "numero_processo"), semi(cases, sel, "numero_processo")
    assert a.count() + s.count() == cases.count()


def test_monthly_series_has_no_gaps(spark):
    from casework.plans.q_time import _local_filing, member_hits

    hits = member_hits(spark, SF_SMALL)
    series = AN.monthly_series(hits, _local_filing()).collect()
    months = [r.mes[len(K.MONTH_LABEL_PREFIX):] for r in series]
    y, m = map(int, months[0].split("-"))
    for label in months[1:]:
        m += 1
        if m == 13:
            y, m = y + 1, 1
        assert label == f"{y:04d}-{m:02d}"
    first = hits.select(F.trunc(_local_filing().cast("date"), "MM").alias("mm")).agg(F.min("mm")).first()[0]
    in_first = hits.filter(F.trunc(_local_filing().cast("date"), "MM") == F.lit(first)).count()
    assert sum(r.n for r in series) == hits.count() - in_first


def test_block_sample_sizes(spark):
    union = DS.union(spark, SF_SMALL)
    sample = D.block_sample(union, 40)
    per_class = {r.tipo_decisao: r.n for r in union.groupBy("tipo_decisao").agg(F.count("*").alias("n")).collect()}
    got = {r.tipo_decisao: r.n for r in sample.groupBy("tipo_decisao").agg(F.count("*").alias("n")).collect()}
    for cls, total in per_class.items():
        # two blocks of 20 at positions 0-19 and 80-99
        expected = min(total, 20) + max(0, min(total, 100) - 80)
        assert got.get(cls, 0) == expected


def test_first_decision_invariant_under_repartition(spark):
    cases = DS.cases(spark, SF_SMALL)
    a = D.first_decision(cases).orderBy("numero_processo").collect()
    b = D.first_decision(cases.repartition(13, "hit_pos")).orderBy("numero_processo").collect()
    assert a == b


def test_block_sample_sequence_path_matches_window(spark):
    from pyspark.sql import Window

    union = DS.union(spark, SF_SMALL)
    got = D.block_sample(union, 2000)  # stride limit 8000: above the group-limit threshold
    w = Window.partitionBy("tipo_decisao").orderBy("hit_pos")
    want = (union.withColumn("p", (F.row_number().over(w) - 1).cast("int"))
            .filter((F.col("p") < 8000) & (F.col("p") % 80 < 20))
            .select("numero_processo", "tipo_decisao", "hit_pos", "p"))
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_hot_keys_are_combined_and_exact(spark):
    """One case number holds a third of all hits; one first name a third of people."""
    from casework.operators import names as NM
    from casework.sources.fixtures import DICTIONARY_SCHEMA

    n = 30000
    rows = [(i, "HOT" if i % 3 == 0 else f"{i:020d}", "G1",
             [(0, "Expedição", None), (1, "Procedência" if i % 2 else "Improcedência", None)])
            for i in range(n)]
    cases = spark.createDataFrame(
        rows, "hit_pos long, numero_processo string, grau string, "
              "movimentos array<struct<codigo:bigint,nome:string,dataHora:string>>").repartition(16)
    first = D.first_decision(cases)
    hot = first.filter(F.col("numero_processo") == "HOT").first()
    assert (hot.hit_pos, hot.tipo_decisao) == (0, "Improcedência")
    assert first.count() == 1 + n - n // 3
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan  # combined before the shuffle

    people = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("Maria Souza"))
                                   .otherwise(F.concat(F.lit("Nome"), F.col("id").cast("string"), F.lit(" X")))
                                   .alias("nome"))
    dic = spark.createDataFrame([("Maria", "F", 1)], DICTIONARY_SCHEMA)
    out = NM.lookup_attribute(people, {"nome": "sexo"}, dic)
    got = {r.sexo: r.n for r in out.groupBy("sexo").agg(F.count("*").alias("n")).collect()}
    assert got == {"F": n // 3, "Indefinido": n - n // 3}
