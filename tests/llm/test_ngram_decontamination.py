from __future__ import annotations

import hashlib
import random
import re

import pytest

from casework.llm import ngram_decontamination as N
from tests.conftest import SF_CHECK

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, row string, n_words int, `a.b` string, items int"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def expected(docs, items, size):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def inputs():
    r = random.Random(11)
    some = lambda n, k=40: " ".join(f"{r.choice(('W', 'w', 'é', 'Ü'))}{r.randrange(k)}" for _ in range(n))
    items = [(i, some(30)) for i in range(20)] + [(20, "Two words"), (21, "one"), (22, ""), (23, None), (24, "!!"), (None, some(12)), (3, "again " + some(12))]
    items += [items[0]] * 3
    docs = [(i, f"{some(20)}! {items[i % 19][1][3:90].upper()}\n{some(9)}") for i in range(60)]
    docs += [(70, None), (71, ""), (72, "?! ."), (73, "two\x00WORDS"), (74, "two, x words"), (75, "zÉ one-ONE"), (76, items[0][1]), (None, "one"), (76, items[0][1]),
             (77, ("x9 " * 30_000) + items[1][1] + " y" * 30_000), (78, "w" * 200_000 + " two words")]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(k, t, "r", 1, "dot", 5) for k, t in docs], SCHEMA).repartition(4),
            spark.createDataFrame(items, "item_id long, text string").repartition(3))


@pytest.mark.parametrize("most", [1_000_000, 90])
@pytest.mark.parametrize("size", [4, 10])
def test_marked_words_match_a_plain_search(spark, size, most):
    docs, items = inputs()
    got = N.contaminated(*frames(spark, docs, items), size=size, most_windows=most).drop("spans").collect()
    assert sorted(map(tuple, got), key=str) == expected(docs, items, size)


def test_long_items_are_read_in_overlapping_parts(spark, monkeypatch):
    monkeypatch.setattr(N, "PART_WORDS", 7)
    docs, items = inputs()
    got = N.contaminated(*frames(spark, docs, items), size=5).drop("spans").collect()
    assert sorted(map(tuple, got), key=str) == expected(docs, items, 5)


def test_a_long_text_is_hashed_in_pieces(monkeypatch):
    import numpy as np

    norm = np.frombuffer(N.normalised(" ".join(f"w{i} éß{i}" for i in range(500)) + " " + "q" * 300), dtype=np.uint8)
    bounds = N._bounds(norm)
    whole = N.word_hashes(norm, *bounds)
    monkeypatch.setattr(N, "PIECE", 64)
    assert (N.word_hashes(norm, *bounds) == whole).all() and len(set(whole.tolist())) == 1001


def test_equal_hashes_are_verified(spark, monkeypatch):
    """With all words hashed alike, only the words themselves decide."""
    monkeypatch.setattr(N, "word_hashes", lambda norm, begins, ends: (begins * 0 + 5).astype("uint64"))
    block = N.WindowSet([(1, b"a b c d"), (2, b"c d e f")], 3)
    table, shift = block.filter()
    assert [(n, [r[:2] for r in runs], items) for n, runs, items in N._scanned(["x C d E y", "A b C d", "q r s"], block, table, shift)] == [
        (5, [(1, 3)], [2]), (4, [(0, 3)], [1]), (3, [], [])]


def test_documents_or_spans_are_removed(spark):
    docs = [(1, "keep é THIS one two Three four! and that one two three four"), (2, "clean text"), (3, None), (4, "one two three four")]
    items = [(1, "one two three four")]
    for most in (1_000_000, 1):
        d, b = frames(spark, docs, items + ([(2, "clean of it all")] if most == 1 else []))
        out = N.decontaminated(d, b, size=4, most_windows=most)
        assert out.schema == d.schema and sorted(r.doc_id for r in out.collect()) == [2, 3]
        out = N.decontaminated(d, b, remove="spans", size=4, most_windows=most)
        assert out.schema == d.schema
        assert {r.doc_id: r.text for r in out.collect()} == {1: "keep é THIS ! and that ", 2: "clean text", 3: None, 4: ""}
    with pytest.raises(ValueError):
        N.decontaminated(d, b, remove="words")


def test_empty_tables(spark):
    docs, items = inputs()
    assert N.contaminated(*frames(spark, [], items)).count() == 0
    none = N.contaminated(*frames(spark, docs, [])).collect()
    assert len(none) == len(docs) and not any(r.contaminated or r.n_hit for r in none)


def test_planted_passages_are_found(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    items = spark.read.parquet(f"{SF_CHECK}/benchmark.parquet")
    assert N.contaminated(docs, items).where("contaminated").count() > 0
