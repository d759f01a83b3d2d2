"""Positions of hits across files, ranges and pages, and the plan that gives them."""

from __future__ import annotations

import json
import random

import pytest

from casework.sources import readers as R


def response(numbers, page=None):
    doc = {"hits": {"total": {"value": len(numbers)}, "hits": [{"_source": {"numeroProcesso": str(n)}, "sort": [n]} for n in numbers]}}
    return doc if page is None else doc | {"pagina": page}


@pytest.fixture()
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "20000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("paged", [False, True])
def test_positions_follow_pages_files_and_places(spark, tmp_path, small_ranges, paged):
    r, n, docs = random.Random(6), 0, []
    for name in ("b.json", "a.json", "c.json"):
        lines = []
        for k in range(60):
            numbers = list(range(n, n + r.randrange(40)))
            n += len(numbers)
            page = r.choice((1, 2, 30, None)) if paged else None
            docs.append((page or 0, name, k, numbers))
            lines.append(json.dumps(response(numbers, page)))
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    want = [str(x) for *_, numbers in sorted(docs) for x in numbers]
    hits = R.read_search_responses(spark, str(tmp_path))
    assert hits.rdd.getNumPartitions() > 5
    assert [(i.hit_pos, i.numeroProcesso) for i in sorted(hits.collect(), key=lambda i: i.hit_pos)] == list(enumerate(want))


def test_hits_do_not_move(spark, tmp_path):
    for paged in (False, True):
        folder = tmp_path / str(paged)
        folder.mkdir()
        (folder / "a.json").write_text("\n".join(json.dumps(response([i], i if paged else None)) for i in range(5)))
        plan = R.read_search_responses(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
        assert "RDDScan" not in plan and not any(f"Exchange {kind}" in plan for kind in ("hash", "range", "Single", "Round"))


def test_no_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text("")
    assert R.read_search_responses(spark, str(tmp_path)).count() == 0
    (tmp_path / "b.json").write_text(json.dumps(response([])))
    assert R.read_search_responses(spark, str(tmp_path)).count() == 0
    (tmp_path / "c.json").write_text("{not json")
    with pytest.raises(Exception):
        R.read_search_responses(spark, str(tmp_path)).count()
