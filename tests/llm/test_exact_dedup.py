from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np

from casework.llm.cqf_dedup import CountingQuotientFilter, exact_groups, repeated_prints


def test_filters_merge_without_loss():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 1 << 64, 5000, dtype=np.uint64) for _ in range(2))
    a[:700] = a[700:1400]
    b[:300] = a[:300]
    both = np.concatenate([a, b])
    for bits in (1, 7, 40):
        f, g = (CountingQuotientFilter.of(x, np.ones(len(x), dtype=np.int64), bits) for x in (a, b))
        merged = f.merged(g)
        values, counts = np.unique(both, return_counts=True)
        assert (merged.fingerprints() == values).all() and (merged.counts == counts).all()
        again = CountingQuotientFilter.unpacked(merged.packed())
        assert (again.fingerprints() == values).all() and (again.counts == counts).all()
        parts = list(merged.slices(1))
        assert sum(len(p.remainders) for _, p in parts) == len(values)


def expected(rows):
    groups = defaultdict(list)
    norm = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for key, text in rows:
        groups[norm(text)].append(key)
    out = []
    for text, keys in groups.items():
        keep = max((k for k in keys if k is not None), default=None)
        out += [(k, keep, len(keys), k == keep, hashlib.sha256(text.encode()).hexdigest()) for k in keys]
    return sorted(out, key=str)


def test_groups(spark):
    rows = [(1, "Abc"), (2, "aBC"), (3, "abc "), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "x" * 200_000), (9, "X" * 200_000),
            (9, "X" * 200_000), (None, "null id"), (None, "abc"), (None, "one"), (None, "one"), (10, "one more")]
    rows += [(100 + i, "hot text") for i in range(500)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, print long, rows string").repartition(7)
    for per_slice in (3, 100_000):
        assert sorted(map(tuple, exact_groups(frame, per_slice=per_slice).collect()), key=str) == expected(rows)
    assert exact_groups(frame.limit(0)).count() == 0


def test_repeated_prints_over_slices(spark):
    prints = [5, 5, -5, 9, -(1 << 63), -(1 << 63), (1 << 63) - 1] + list(range(100, 200))
    frame = spark.createDataFrame([(p,) for p in prints], "print long").repartition(5)
    for per_slice in (1, 10, 1000):
        assert sorted(map(tuple, repeated_prints(frame, len(prints), per_slice).collect())) == [(-(1 << 63), 2), (5, 2)]


def test_merge_does_not_sort_anew(monkeypatch):
    rng = np.random.default_rng(5)
    draws = [rng.integers(0, 3000, n, dtype=np.uint64) * np.uint64(1 << 50) for n in (2000, 1500, 1, 0)]
    filters = [CountingQuotientFilter.of(x, np.ones(len(x), dtype=np.int64), 9) for x in draws]
    wanted = {(i, j): np.unique(np.concatenate([draws[i], draws[j]]), return_counts=True) for i in range(4) for j in range(4)}

    def sorts(*args, **kwargs):
        raise AssertionError("the merge sorts")

    for name in ("unique", "sort", "argsort", "lexsort"):
        monkeypatch.setattr(np, name, sorts)
    for (i, j), (values, counts) in wanted.items():
        merged = filters[i].merged(filters[j])
        assert (merged.fingerprints() == values).all() and (merged.counts == counts).all()
        assert len(merged.remainders) == len(values) and (np.diff(merged.ends, prepend=0) > 0).all() and len(merged.ends) == len(merged.quotients)
