from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from casework.llm.shallot_clustering import Centroids, clustered, reassigned, squared

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, distance string"


def expected(rows, k, rounds, dims, seed):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: sha(r[0]))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(centroids)), key=lambda j: (dist(v, centroids[j]), j))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v), []).append(v)
        centroids = [[sum(c) // len(c) for c in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    last = [(i, nearest(v), v) for i, v in kept]
    sums = {}
    for _, j, v in last:
        sums[j] = sums.get(j, 0) + dist(v, centroids[j])
    text = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    return sorted(((i, j, dist(v, centroids[j]), sums[j], sum(sums.values()), text(centroids[j])) for i, j, v in last), key=str)


def got(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, clustered(frame, **options).collect()), key=str)


def test_matches_plain_k_means(spark):
    r = random.Random(5)
    spots = [[r.uniform(-2, 2) for _ in range(4)] for _ in range(6)]
    rows = [(i, [float(np.float32(x + r.gauss(0, 0.4))) for x in spots[i % 6]]) for i in range(300)]
    rows += [(900, None), (901, [0.1] * 3), (902, [0.1, None, 0.2, 0.3]), (903, [0.1, math.nan, 0.2, 0.3]), (904, [math.inf, 0.0, 0.0, 0.0]), (905, [])]
    rows += [rows[0]] * 40 + [(None, rows[3][1])]
    for k, rounds in ((1, 2), (2, 3), (8, 10), (30, 4)):
        assert got(spark, rows, k=k, rounds=rounds, dims=4, seed=3) == expected(rows, k, rounds, 4, 3)


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    corners = [[float(a), float(b)] for a in (-1, 0, 1) for b in (-1, 0, 1)]
    rows = [(i, corners[i % 9]) for i in range(60)]
    for k in (2, 5, 8):
        assert got(spark, rows, k=k, rounds=3, dims=2, seed=1) == expected(rows, k, 3, 2, 1)
    same = [(7, [1.0, 2.0])] * 30
    assert {r[1] for r in got(spark, same, k=4, rounds=3, dims=2)} == {0}


def test_few_or_no_vectors(spark):
    assert got(spark, [], k=3, rounds=2, dims=2) == []
    assert got(spark, [(1, [1.0])], k=3, rounds=2, dims=2) == []
    two = [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    assert got(spark, two, k=3, rounds=2, dims=2, seed=3) == expected(two, 3, 2, 2, 3)


def test_a_component_too_large_for_exact_sums_is_an_error(spark):
    with pytest.raises(Exception, match="beyond 131072"):
        got(spark, [(1, [2e5, 0.0])], k=1, rounds=1, dims=2)


def test_bounds_save_distances_and_stay_bounds():
    r = np.random.default_rng(3)
    spots = r.integers(-20_000, 20_000, (20, 16))
    vectors = spots[r.integers(0, 20, 4000)] + r.integers(-900, 900, (4000, 16))
    c = Centroids(vectors[:20])
    state = (np.full(4000, -1), np.zeros(4000, dtype=int), np.zeros(4000), np.zeros(4000))
    counts = []
    for _ in range(8):
        *state, measured = reassigned(vectors, *state, c)
        near, _, upper, lower = state
        every = np.array([squared(vectors, p[None]) for p in c.points])
        assert (every.argmin(0) == near).all()
        assert (np.sqrt(every.min(0)) <= upper).all() and (np.sqrt(np.sort(every, 0)[1]) >= lower).all()
        counts.append(measured)
        points = np.array([vectors[near == j].sum(0) // max(1, (near == j).sum()) for j in range(20)])
        c = Centroids(points, c.points)
    assert counts[0] < 20 * 4000 and counts[-1] < 4000
