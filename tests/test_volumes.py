"""What round trips leave on disk: compressed, and still read by more tasks than there are files."""

from __future__ import annotations

import gzip
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from casework.plans import datasets as DS
from casework.plans.q_roundtrip import json_pretty_hits
from casework.session import scratch_dir
from casework.sources import json_ranges as J
from casework.sources import readers as R
from casework.sources import writers as W
from casework.sources.ranges import volumes
from tests.conftest import SF_SMALL
from tests.test_json_ranges import response


def test_volumes_hold_the_texts_cut_at_line_breaks(spark, tmp_path):
    texts = ["a" * 50 + "\nb\nc\n" + "é\U0001f600" * 20, "", "x\n\n\ny", "z"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    W.write_volumes(df, "text", str(tmp_path / "v"), piece=4, pieces=1)
    files = sorted((tmp_path / "v").glob("part-*.gz"))
    assert len(files) > 2
    got = [line for f in files for line in gzip.decompress(f.read_bytes()).decode().split("\n") if line]
    assert got == [line for t in texts for line in t.split("\n") if line]
    rows = volumes(spark, str(tmp_path / "v")).select("file", "block").distinct().collect()
    assert len({r.file for r in rows}) == 1 and sorted(r.block for r in rows) == list(range(len(files)))


@pytest.mark.parametrize("paged", [False, True])
def test_responses_cross_volumes(spark, tmp_path, paged):
    r, n, docs = random.Random(3), 0, []
    for i in range(12):
        k = r.randrange(6)
        docs.append(response(r, list(range(n, n + k)), r.choice((0, 1, "2", None)) if paged else None))
        n += k
    texts = [json.dumps(d, indent=r.choice((0, 1)), ensure_ascii=False) for d in docs]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartitionByRange(3, "i").sortWithinPartitions("i")
    W.write_volumes(df, "text", str(tmp_path / "v"), piece=30, pieces=3)
    ranges = volumes(spark, str(tmp_path / "v")).select("file", "block").distinct().collect()
    assert len({x.file for x in ranges}) == 3 and len(ranges) > 30
    page = lambda d: {1: 1, "2": 2}.get(d.get("pagina"), 0)
    want = [h for d in sorted(docs, key=page) for h in d["hits"]["hits"]]
    got = sorted(R.read_search_responses(spark, str(tmp_path / "v"), multi_line=True, in_volumes=True).collect(), key=lambda h: h.hit_pos)
    assert [(h.hit_pos, h.numeroProcesso, h.grau, h.sort) for h in got] == [
        (i, h["_source"]["numeroProcesso"], h["_source"]["grau"], h["sort"]) for i, h in enumerate(want)]


def test_pretty_responses_are_compressed_on_disk(spark):
    folder = Path(scratch_dir(spark).removeprefix("file:"))
    before = set(folder.glob("responses-pretty-*"))
    assert json_pretty_hits(spark, SF_SMALL).count() == DS.hits(spark, SF_SMALL).count()
    (new,) = set(folder.glob("responses-pretty-*")) - before
    files = sorted(new.glob("part-*"))
    text = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert b'\n  "hits" : {' in text and sum(f.stat().st_size for f in files) * 5 < len(text)


def test_hits_move_to_their_pages_before_they_are_listed(spark):
    plan = W.response_pages(DS.hits(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.rindex("ObjectHashAggregate")


def test_pages_of_few_hits(spark):
    hits = DS.hits(spark, SF_SMALL)
    pages = W.response_pages(hits, 7).select("pagina", F.posexplode("hits.hits").alias("i", "hit"), F.col("hits.total.value").alias("n"))
    got = {(r.pagina * 7 + r.i, r.no, r.n) for r in pages.select("pagina", "i", "n", F.col("hit._source.numeroProcesso").alias("no")).collect()}
    rows, total = hits.select("hit_pos", "numeroProcesso").collect(), hits.count()
    assert got == {(r.hit_pos, r.numeroProcesso, min(7, total - r.hit_pos // 7 * 7)) for r in rows}


def test_whole_containers_are_passed_over_at_once(monkeypatch):
    calls, over = [], J._OVER
    monkeypatch.setattr(J, "_OVER", type("Counted", (), {"match": staticmethod(lambda *a: calls.append(1) or over.match(*a))}))
    element = '{"_source": {"a": [{"b": "}"}, "c"], "d": "e"}}'
    assert J.closed_and_opened(iter(['{"hits": {"total": 1, "hits": [' + ", ".join([element] * 100)])) == (0, ["{?", "{1", "[1"], "0")
    assert len(calls) < 6
    deep = '{"a": ' * 9 + '"hits"' + "}" * 9
    assert J.closed_and_opened(iter(["[" + deep + ", {"])) == (0, ["[?", "{1"], "1")


def test_selected_hits_are_compressed_in_files_of_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "HITS_A_FILE", 100)
    hits = DS.hits(spark, SF_SMALL).coalesce(2)
    W.write_hits(hits, str(tmp_path / "s"))
    files = sorted((tmp_path / "s" / "hits").glob("part-*"))
    lines = [gzip.decompress(f.read_bytes()).decode().splitlines() for f in files]
    assert max(map(len, lines)) <= 100 and sum(map(len, lines)) == hits.count()
    assert sum(f.stat().st_size for f in files) * 5 < sum(len(x.encode()) + 1 for file in lines for x in file)
    assert [json.loads(x) for f in (tmp_path / "s" / "total").glob("part-*") for x in f.read_text().splitlines()] == [{"value": hits.count()}]
    fields = ["hit_pos", *R.SOURCE_FIELDS, "sort"]
    back = R.read_hits_jsonl(spark, str(tmp_path / "s" / "hits"))
    assert sorted(map(repr, back.select(*fields).collect())) == sorted(map(repr, hits.select(*fields).collect()))
