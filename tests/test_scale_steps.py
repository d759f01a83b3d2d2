"""Steps that are sized or read by what the input holds."""

from __future__ import annotations

import pyarrow as pa

from casework.operators import pages as PG
from casework.operators import sequence as S
from casework.plans import datasets as DS
from casework.sources.adapter import build_hits
from casework.sources.json_ranges import Walk, closed_and_opened
from casework.sources.ranges import texts_by_range
from tests.conftest import SF_SMALL


def test_line_items_are_dealt_over_partitions_by_their_bytes(spark):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        t = DS.tables(spark, SF_SMALL)
        n = S.hash_partitions(t.lineitem)
        assert n > int(spark.conf.get("spark.sql.shuffle.partitions"))
        plan = build_hits(t, False)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(l_orderkey" in plan
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)


def test_a_common_tag_is_read_once():
    page = '<div id="juizPrimeiraDivTable"><span>Ana Reis</span></div>'
    PG.page_values(page)
    hits = PG._read_ident.cache_info().hits
    assert PG.page_values(page)[1] == "Ana Reis"
    assert PG._read_ident.cache_info().hits > hits


def test_parts_of_ranges_are_texts():
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "", "b", "c"]), pa.array(["x", "x", "x", "y"]), pa.array([0, 0, 9, 9], pa.int64())], names=["value", "file", "block"])
    empty = batch.slice(0, 0)
    assert list(texts_by_range(iter([batch, empty, batch.slice(3)]))) == [(("x", 0), "a\n", True), (("x", 9), "b", True), (("y", 9), "c", True), (("y", 9), "c", False)]


def test_only_strings_before_open_containers_are_looked_at(monkeypatch):
    from casework.sources import json_ranges as J

    seen, true = [], J._is_key
    monkeypatch.setattr(J, "_is_key", lambda token: seen.append(token) or true(token))
    element = '{"_source": {"a": [{"b": "}"}, "c"], "d": "e"}}'
    assert closed_and_opened(iter(['{"hits": {"total": 1, "hits": [' + element])) == (0, ["{?", "{1", "[1"], "0")
    assert len(seen) < 5
    del seen[:]
    assert Walk(["{0", "{1", "[1"], "1", -1, 0).feed(element + ", " + element) == [(0, element)] * 2
    assert len(seen) < 3
