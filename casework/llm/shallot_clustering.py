"""Exact k-means with the Shallot search.

Vectors become integers once; every distance that decides is a sum of squares
in 64-bit integers, so ties are ties on any machine. Each vector carries its
nearest and second-nearest centroid with an upper bound on its distance to the
first and a lower bound on its distance to all others. Moved centroids widen the
bounds. A vector whose upper bound stays below the lower bound, or below half
the way from its centroid to the next one, keeps its centroid without any distance.
The others measure their own centroid, then the remembered second, and scan
from the closer of the two: the other centroids in order of their distance
from it, until that exceeds the vector's distance to it plus that to the second-nearest found
so far. The ball shrinks whenever a closer second turns up. Bounds are floats
rounded outwards; they only ever rule out centroids, never decide.

A round reads the vectors with their bounds and writes them again, narrow and
without a shuffle. Behind its vectors each task writes what its changed vectors
add to and take from the centroids' sums; those few rows are summed by Spark,
and the driver holds the centroids alone. The round before is then deleted.

Kept are vectors of exactly ``dims`` components, none null and none infinite or NaN; a null
vector is not kept. A null vec_id counts as empty text where the first centroids are
chosen. Rows that repeat a vec_id are vectors of their own; of equal hashes the
one whose stored bytes sort first comes first. With fewer than ``k`` kept vectors there are as many
centroids; an empty table gives an empty result. A component beyond 131,072
either way stops the job: squared distances could exceed 64 bits. Only the named
columns are read, so other names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.common import removed, written_path
from casework.session import ship_package

#: Scaled components stay below this, so that 64-bit sums of squares are exact.
LARGEST = 1 << 27
#: Factors that round a bound outwards, far beyond the error of a few float operations.
UP, DOWN = 1 + 1e-9, 1 - 1e-9

STATE = "vec_id long, vector binary, near int, second int, upper double, lower double, cluster int, moved long, total array<long>"


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


class Centroids:
    """A round's centroids and the geometry that the search uses: neighbours of
    each one in order of distance, those distances rounded down, half the way
    to the nearest one, and how far each has moved."""

    def __init__(self, points: np.ndarray, before: np.ndarray | None = None):
        self.points = points.astype(np.int64)
        k = len(points)
        squares = np.array([squared(self.points, p[None]) for p in self.points]).reshape(k, k)
        np.fill_diagonal(squares, -1)
        self.order = np.argsort(squares, axis=1, kind="stable")[:, 1:]
        self.gaps = np.sqrt(np.take_along_axis(squares, self.order, 1)) * DOWN
        self.half = self.gaps[:, 0] / 2 if k > 1 else np.full(k, np.inf)
        self.shift = np.zeros(k) if before is None else np.sqrt(squared(self.points, before.astype(np.int64))) * UP
        most = np.argsort(-self.shift, kind="stable")[:2]
        # How far any other centroid can have come closer.
        self.rival = np.full(k, self.shift[most[0]])
        self.rival[most[0]] = self.shift[most[1]] if k > 1 else 0.0


def reassigned(vectors: np.ndarray, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray,
               c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """nearest, second-nearest, upper and lower bound for the new centroids,
    and how many distances it took. ``near`` is -1 for a vector seen first."""
    k, fresh = len(c.points), near < 0
    near = np.where(fresh, 0, near)
    second = np.where(fresh, min(1, k - 1), second)
    upper = np.where(fresh, np.inf, (upper + c.shift[near]) * UP)
    lower = np.where(fresh, 0.0, (lower - c.rival[near]) - np.abs(lower) * 1e-9)
    if k == 1:
        return near, second, np.where(fresh, np.inf, upper), np.full(len(near), np.inf), 0
    # Certain: nearer to its centroid than any other can be.
    certain = np.maximum(lower, c.half[near])
    at = np.flatnonzero(~(upper < certain))
    one = squared(vectors[at], c.points[near[at]])
    measured = len(at)
    upper[at] = np.sqrt(one) * UP
    open_ = ~(upper[at] < certain[at])
    at, one = at[open_], one[open_]
    if not len(at):
        return near, second, upper, lower, measured
    v, first, other = vectors[at], near[at], second[at]
    two = squared(v, c.points[other])
    measured += len(at)
    # Start from the closer of the two remembered centroids.
    swap = (two < one) | (two == one) & (other < first)
    best, rest = np.where(swap, two, one), np.where(swap, one, two)
    first, other = np.where(swap, other, first), np.where(swap, first, other)
    start, known, reach = first.copy(), other.copy(), np.sqrt(best) * UP
    active = np.arange(len(at))
    for t in range(k - 1):
        inside = c.gaps[start[active], t] <= reach[active] + np.sqrt(rest[active]) * UP
        active = active[inside]
        if not len(active):
            break
        candidate = c.order[start[active], t]
        new = candidate != known[active]
        i, j = active[new], candidate[new]
        d = squared(v[i], c.points[j])
        measured += len(i)
        wins = (d < best[i]) | (d == best[i]) & (j < first[i])
        w = i[wins]
        rest[w], other[w] = best[w], first[w]
        best[w], first[w] = d[wins], j[wins]
        closer = ~wins & (d < rest[i])
        rest[i[closer]], other[i[closer]] = d[closer], j[closer]
    near[at], second[at] = first, other
    upper[at], lower[at] = np.sqrt(best) * UP, np.sqrt(rest) * DOWN
    return near, second, upper, lower, measured


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of float64 values as 64-bit integers."""
    out = np.floor(values * 1024.0)
    if len(out) and np.abs(out).max() > LARGEST:
        raise ValueError("a component is beyond 131072: squared distances could exceed 64 bits")
    return out.astype(np.int64)


def integer_vectors(table: DataFrame, dims: int, id_col: str, vector_col: str) -> DataFrame:
    """The kept vectors as integers, in the state that they have before the first round."""
    ship_package(table.sparkSession)
    x = F.col("vector")
    usable = (F.size(x) == dims) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    kept = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            rows = scaled(flat).astype("<i4").reshape(-1, dims)
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(np.full(n, -1), pa.int32()),
                 pa.array(np.zeros(n), pa.int32()), pa.array(np.zeros(n)), pa.array(np.zeros(n)),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))],
                names=["vec_id", "vector", "near", "second", "upper", "lower", "cluster", "moved", "total"])

    return kept.mapInArrow(run, STATE)


def _unpacked(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, ...]:
    vectors = np.frombuffer(b"".join(batch.column("vector").to_pylist()), dtype="<i4").reshape(-1, dims).astype(np.int64)
    return (vectors, *[batch.column(c).to_numpy(zero_copy_only=False) for c in ("near", "second", "upper", "lower")])


def round_of(state: DataFrame, c: Centroids) -> DataFrame:
    """The vectors with their new nearest centroids and bounds; behind them, for
    each centroid whose members changed in the task, the change of its count and sums."""
    k, dims = c.points.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for batch in batches:
            vectors, old, second, upper, lower = _unpacked(batch, dims)
            near, second, upper, lower, _ = reassigned(vectors, old, second, upper, lower, c)
            changed = near != old
            for sign, where in ((1, near), (-1, old)):
                for j in np.unique(where[changed]).tolist():
                    if j >= 0:
                        members = changed & (where == j)
                        counts[j] += sign * int(members.sum())
                        totals[j] += sign * vectors[members].sum(0)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vector"), pa.array(near, pa.int32()), pa.array(second, pa.int32()), pa.array(upper),
                 pa.array(lower), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], names=batch.schema.names)
        full = np.flatnonzero(counts | totals.any(1))
        n = len(full)
        if n:
            empty = [pa.nulls(n, t) for t in (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [*empty, pa.array(full, pa.int32()), pa.array(counts[full]), pa.array(totals[full].tolist(), pa.list_(pa.int64()))],
                names=["vec_id", "vector", "near", "second", "upper", "lower", "cluster", "moved", "total"])

    return state.where("cluster is null").mapInArrow(run, STATE)


def assigned(state: DataFrame, c: Centroids) -> DataFrame:
    """vec_id, cluster and exact squared distance of every vector."""
    dims = c.points.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, *bounds = _unpacked(batch, dims)
            near = reassigned(vectors, *bounds, c)[0]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(near, pa.int32()), pa.array(squared(vectors, c.points[near]))],
                                             names=["vec_id", "cluster", "distance"])

    return state.where("cluster is null").mapInArrow(run, "vec_id long, cluster int, distance long")


def first_centroids(state: DataFrame, k: int, dims: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of seed and id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("key")
    rows = state.select(key, "vector").orderBy("key", "vector").limit(k).collect()
    return np.array([np.frombuffer(bytes(r.vector), dtype="<i4") for r in rows], dtype=np.int64).reshape(-1, dims)


def changes(state: DataFrame) -> dict[int, tuple[int, dict[int, int]]]:
    """By centroid: the change of its count and of each component's sum (k x dims numbers)."""
    rows = state.where("cluster is not null").select("cluster", F.posexplode(F.concat(F.array("moved"), F.col("total"))).alias("at", "value"))
    sums = rows.groupBy("cluster", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    out: dict[int, dict[int, int]] = {}
    for r in sums:
        out.setdefault(r.cluster, {})[r["at"]] = int(r.value)
    return {j: (v[0], {i - 1: x for i, x in v.items() if i}) for j, v in out.items()}


def clustered(table: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3,
              id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    spark = table.sparkSession
    state, path = written_path(integer_vectors(table, dims, id_col, vector_col), "vectors")
    points = first_centroids(state, k, dims, seed)
    if not len(points):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = Centroids(points)
    counts, totals = [0] * len(points), [[0] * dims for _ in points]
    for _ in range(rounds):
        state, done = written_path(round_of(state, centroids), "vectors")
        removed(spark, path)
        path = done
        for j, (moved, sums) in changes(state).items():
            counts[j] += moved
            for i, value in sums.items():
                totals[j][i] += value
        points = np.array([[t // n for t in total] if n else old for n, total, old in zip(counts, totals, centroids.points.tolist())], dtype=np.int64)
        still = (points == centroids.points).all()
        centroids = Centroids(points, centroids.points)
        if still:  # nothing moved, so no later round changes anything
            break
    result, _ = written_path(assigned(state, centroids), "clusters")
    removed(spark, path)
    inertia = {r.cluster: int(r.value) for r in result.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("value")).collect()}
    sha = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in centroids.points.tolist()]
    facts = spark.createDataFrame([(j, v, sum(inertia.values()), sha[j]) for j, v in inertia.items()],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # At most k rows.
    return result.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
