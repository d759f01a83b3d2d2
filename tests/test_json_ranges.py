"""Pretty-printed responses read by byte ranges against json.loads, with borders everywhere."""

from __future__ import annotations

import json
import random

import pandas as pd
import pytest

from casework.sources import json_ranges as J
from casework.sources import readers as R


def response(r, numbers, page=None):
    word = lambda: r.choice(("hits", "a b", '}{"', "]\\", "line\nbreak", "é", "", "hits\"", "\t"))
    hit = lambda n: r.choice(({}, {"hits": {"hits": [{"no": word()}]}})) | {"_source": {"numeroProcesso": str(n), "grau": word(), "hits": [[], {}, word()]}, "sort": [n]}
    doc = {"took": 3, "x": {"hits": [{"not": word()}]}, "hits": {"total": {"value": len(numbers)}, "hits": [hit(n) for n in numbers], "max": None}, "after": [word(), {}]}
    return doc if page is None else doc | {"pagina": page}


def texts(seed, page=False):
    r, n = random.Random(seed), 0
    for _ in range(3):
        docs = []
        for _ in range(r.choice((1, 1, 3))):
            k = r.randrange(6)
            docs.append(response(r, list(range(n, n + k)), r.choice((0, 1, "2", 30, None, "odd", True, 1.5)) if page else None))
            n += k
        ascii_, indent = r.random() < 0.5, r.choice((0, 1, "\t"))
        end = r.choice(("\n", "\r\n"))
        dump = lambda d: json.dumps(d, indent=indent, ensure_ascii=ascii_).replace("\n", end)  # noqa: E731,B023
        if r.random() < 0.3:
            yield docs, dump(docs)
        else:
            yield docs, ("\ufeff" if r.random() < 0.2 else "") + end.join(map(dump, docs)) + r.choice(("", end))


def by_hand(text, r, most):
    """The two scans over a text cut at lines, as the jobs put them together."""
    lines = text.split("\n")
    parts, begin, at = [], 0, 0
    while at < len(lines):
        k = r.randint(1, most)
        parts.append((begin, lines[at:at + k]))
        begin += sum(len(x.encode()) + 1 for x in lines[at:at + k])
        at += k
    first = [("f", b, c, "".join(o), last) for b, p in parts for c, o, last in [J.closed_and_opened(iter(["\n".join(p)]))]]
    states = J._composed(pd.DataFrame(first, columns=["file", "block", "closes", "opened", "last"]))
    found, fragments, rest, docs = [], {}, [], 0
    for (block, part), s in zip(parts, states.itertuples(index=False)):
        walk = J.Walk(J._frames(s.stack), s.last, s.origin, block)
        half = len(part) // 2
        whole = [x for p in (part[:half], part[half:]) if p for x in walk.feed("\n".join(p))]
        walk.end()
        found += [(block, 0, i, docs + d, x) for i, (d, x) in enumerate(whole)]
        for origin, d, x in walk.fragments:
            known = fragments.setdefault(origin, [docs + d, []])
            known[1].append(x)
        docs += walk.doc
        rest.append(walk.rest())
    found += [(b, 1, 0, d, "\n".join(x)) for b, (d, x) in fragments.items()]
    return [(d, json.loads(x)) for *_, d, x in sorted(found, key=lambda f: f[:3])], J.documents("\n".join(rest))


def test_every_border():
    for seed in range(150):
        r = random.Random(seed)
        for docs, text in texts(seed):
            want = [(i, h) for i, d in enumerate(docs, 1) for h in d["hits"]["hits"]]
            for most in (1, 2, 9, 10_000):
                hits, rest = by_hand(text, r, most)
                assert hits == want
                assert [d | {"hits": None} for d in rest] == [d | {"hits": None} for d in docs]


def test_keys_that_are_spelled_apart():
    text = '{\n"h\\u0069ts"\n:\n{"hits"\n:\n[\n{"a"\n:1}\n,\n{}\n]\n}\n}'
    for most in (1, 2, 3, 100):
        assert by_hand(text, random.Random(1), most)[0] == [(1, {"a": 1}), (1, {})]


@pytest.mark.parametrize("text", ['{"hits": {"hits": [\n{"a": 1}\n', '{"hits": {"hits": [\n1]}}', '{"hits": {"hits": [\n[{}]]}}', '{"hits": {"hits": [\n{}\n{}]}}',
                                  '{"hits": {"hits": [\n{}}}]', '{"hits": {"hits": [\n{"a": "open\n"}]}}', '[1]', '{"hits": {"hits": [{}]},\n"hits": {"hits": [{}]}}', '}\n{'])
def test_what_is_not_a_response_is_an_error(text):
    for most in (1, 2, 100):
        with pytest.raises(ValueError):
            by_hand(text, random.Random(1), most)


@pytest.fixture()
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "120")
    spark.conf.set("spark.sql.files.openCostInBytes", "120")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("paged", [False, True])
def test_files_share_tasks_and_keep_their_order(spark, tmp_path, small_ranges, paged):
    want = []
    for f, (docs, text) in enumerate(texts(11 if paged else 5, paged)):
        (tmp_path / f"{f}.json").write_bytes(text.encode())
        for k, d in enumerate(docs):
            page = {1: 1, "2": 2, 30: 30}.get(d.get("pagina"), 0) if d.get("pagina") is not True else 0
            want += [(page, f, k, i, h["_source"]["numeroProcesso"], h["_source"]["grau"], h["sort"]) for i, h in enumerate(d["hits"]["hits"])]
    hits = R.read_search_responses(spark, str(tmp_path), multi_line=True)
    assert J.lines(spark, str(tmp_path)).rdd.getNumPartitions() > 10
    got = sorted(hits.collect(), key=lambda h: h.hit_pos)
    assert [(h.hit_pos, h.numeroProcesso, h.grau, h.sort) for h in got] == [(i, *w[4:]) for i, w in enumerate(sorted(want))]


def test_no_hits_and_no_files_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text("")
    assert R.read_search_responses(spark, str(tmp_path), multi_line=True).count() == 0
    (tmp_path / "b.json").write_text('{\n"hits": {\n"hits": [\n]\n}\n}\n{"took": 1}')
    assert R.read_search_responses(spark, str(tmp_path), multi_line=True).count() == 0


def test_an_element_that_does_not_parse_is_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"hits": {"hits": [\n{"_source": {"grau": G1}}\n]}}')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        R.read_search_responses(spark, str(tmp_path), multi_line=True).collect()
