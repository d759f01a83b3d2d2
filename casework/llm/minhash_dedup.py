"""Near-duplicate groups by minima of many universal hashes.

1. Every text becomes the set of its distinct five-word shingles and a
   signature: the least value of each of ``BANDS * ROWS`` universal hashes.
   Texts with the same words share one representative from here on.
2. Equal bands of ``ROWS`` minima put representatives in a bucket. 32 bands of
   4 miss a pair at similarity 0.75 once in 190,000 (0.684 ** 32).
3. In a bucket each member is held against the bucket's least member (its
   centre) only. Signatures drop the pairs far below the threshold, full
   shingle sets decide the rest, and alternating large-star and small-star
   steps join the links to components.
4. Centres whose members lie in more than one component are left. Of such a
   centre, the members outside its largest component are compared with all its
   members, blocks of ``BLOCK`` against blocks, on full sets inside the
   tasks; only links come out. Pairs within one component need no comparison:
   they cannot change the result. A second run of the components ends it.

No step gathers a bucket in one task or emits its pairs. Centres' counts and
minima are summed before the shuffle, and joins with a hot centre can be split.

A null text is empty; without words a row has no shingles and is linked with nothing.
Rows that repeat a doc_id are one node. A row without an id links as any other
text and gets its group's least id; if no row of the group has one, it stays
with a null component. An empty table gives an empty result. Only the id and the text
are read, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.common import counted, id_and_text, in_parts, written
from casework.llm.star_components import components

WIDTH = 5
BANDS, ROWS = 32, 4
#: Similarity in percent that makes a link.
PERCENT = 75
#: Members in a block that is compared with another.
BLOCK = 256
#: The estimate from ``BANDS * ROWS`` minima strays by 0.038 (one sigma); pairs
#: estimated this far below the threshold are dropped.
SLACK = 4.75 * 0.0383

_U64 = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U64(31))
    x = x * _U64(0x9E3779B97F4A7C15)
    return x ^ (x >> _U64(29))


_STEPS = [_U64(int(m) | 1) for m in np.random.default_rng(11).integers(1 << 62, 1 << 63, WIDTH)]


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words."""
    if not words:
        return np.empty(0, dtype=_U64)
    if len(words) < width:
        whole = xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))
        return np.array([whole], dtype=_U64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=_U64, count=len(words))
    n = len(w) - width + 1
    total = np.zeros(n, dtype=_U64)
    for k in range(width):
        total += w[k:k + n] * _STEPS[k]
    return np.unique(_mixed(total))


def words_of(text: bytes) -> list[bytes]:
    # On bytes, lower() changes A-Z alone and split() cuts at \x20\x09-\x0D.
    return text.lower().split()


_RNG = np.random.default_rng(29)
_A = (_RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)[:, None]


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each universal hash a * x + b (mod 2**32)."""
    x = (hashes >> _U64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for begin in range(0, len(x), 2048):
        np.minimum(least, (_A * x[None, begin:begin + 2048] + _B).min(axis=1), out=least)
    return least


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, words_key (equal for equal words), n_shingles and signature."""
    schema = pa.schema([("doc_id", pa.int64()), ("words_key", pa.binary()), ("n_shingles", pa.int64()), ("signature", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            keys, counts, minima = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = words_of(text)
                hashes = shingles(words)
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                counts.append(len(hashes))
                minima.append(signature(hashes).view(np.int32) if words else np.empty(0, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(minima, pa.list_(pa.int32()))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, words_key binary, n_shingles long, signature array<int>")


def centres(representatives: DataFrame) -> DataFrame:
    """Distinct (centre, member) over all buckets with two members or more;
    a centre is a member of its own."""
    number = F.sequence(F.lit(0), F.lit(BANDS - 1))
    keys = F.transform(number, lambda i: F.xxhash64(i, F.slice("signature", i * ROWS + 1, ROWS)))
    rows = representatives.select(F.col("doc_id").alias("member"), F.explode(keys).alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("member").alias("centre"), F.max("member").alias("last"))
    shared = shared.where("centre <> last").select("bucket", "centre")
    return rows.join(shared, "bucket").select("centre", "member").distinct()


def likely(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs (centre, member) whose signatures come near the threshold."""
    sides = [signatures.select(F.col("doc_id").alias(side), F.col("signature").alias(f"{side}_signature")) for side in ("member", "centre")]
    both = pairs.where("centre <> member").join(sides[0], "member").join(sides[1], "centre")
    least = PERCENT / 100 - SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.asarray(batch.column(i).flatten()).reshape(-1, BANDS * ROWS) for i in (2, 3))
            near = pa.array((one == two).mean(axis=1) >= least)
            yield batch.select(["centre", "member"]).filter(near)

    return both.select("centre", "member", "centre_signature", "member_signature").mapInArrow(run, "centre long, member long")


def linked(inter: int, one: int, two: int) -> bool:
    return 100 * inter >= PERCENT * (one + two - inter)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b): the pairs whose full shingle sets reach the threshold."""
    sides = [texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"{side}_text")) for side in ("member", "centre")]
    both = pairs.join(sides[0], "member").join(sides[1], "centre").select("centre", "member", "centre_text", "member_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in in_parts(batches):
            keep = []
            for one, two in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist()):
                if one != last:
                    last, held = one, shingles(words_of(one))
                other = shingles(words_of(two))
                keep.append(linked(np.intersect1d(held, other, assume_unique=True).size, held.size, other.size))
            found = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([found.column(0), found.column(1)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def block_links(sets: list[np.ndarray], components_: np.ndarray) -> list[tuple[int, int]]:
    """Distinct pairs of components that some pair of ``sets`` links."""
    n = len(sets)
    sizes = np.array([s.size for s in sets], dtype=np.int64)
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(n), sizes)
    common = times[column] > 1
    rows, column = rows[common], (np.cumsum(times > 1) - 1)[column[common]]
    inter = np.zeros((n, n), dtype=np.float32)
    step = 4096
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [begin, begin + step])
        marks = np.zeros((n, step), dtype=np.float32)
        marks[rows[a:b], column[a:b] - begin] = 1
        inter += marks @ marks.T
    union = sizes[:, None] + sizes[None, :] - inter
    at = np.argwhere((100 * inter >= PERCENT * union) & (components_[:, None] < components_[None, :]))
    return sorted({(int(components_[i]), int(components_[j])) for i, j in at})


def remaining_links(members: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between components, from ``members`` (centre, member,
    component) of centres with more than one component."""
    counts = members.groupBy("centre", "component").count()
    largest = counts.groupBy("centre").agg(F.max_by("component", F.struct("count", "component")).alias("main"),
                                           F.max("count").alias("inside"), F.sum("count").alias("all"))
    mixed = largest.where("inside < all").select("centre", "main", F.ceil(F.col("inside") / block).cast("int").alias("main_blocks"),
                                                 F.ceil((F.col("all") - F.col("inside")) / block).cast("int").alias("blocks"))
    rows = members.join(mixed, "centre")
    outside = F.col("component") != F.col("main")
    own = F.pmod(F.xxhash64("member"), F.when(outside, F.col("blocks")).otherwise(F.col("main_blocks"))).cast("int")
    rows = rows.withColumn("outside", outside).withColumn("own", own)
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # Blocks outside meet each other and all blocks of the main component.
    place = lambda i, j, main: F.struct(i.alias("i"), j.alias("j"), F.lit(main).alias("main"))
    meets = F.when(F.col("outside"), F.concat(
        F.transform(numbers("blocks"), lambda j: place(F.least(j, F.col("own")), F.greatest(j, F.col("own")), False)),
        F.transform(numbers("main_blocks"), lambda k: place(F.col("own"), k, True)),
    )).otherwise(F.transform(numbers("blocks"), lambda i: place(i, F.col("own"), True)))
    placed = rows.select("centre", "member", "component", F.explode(meets).alias("meet"))
    placed = placed.join(texts.select(F.col("doc_id").alias("member"), "text"), "member")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(words_of(t.encode())) for t in group["text"]]
        return pd.DataFrame(block_links(sets, group["component"].to_numpy()), columns=["a", "b"], dtype="int64")

    return placed.select("centre", "meet", "component", "text").groupBy("centre", "meet").applyInPandas(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    docs = id_and_text(docs, id_col, text_col)
    sketch = written(sketches(docs), "sketches")
    usable = sketch.where("n_shingles > 0 and doc_id is not null")
    # One representative for texts with the same words: their least id.
    first = usable.groupBy("words_key").agg(F.min("doc_id").alias("doc_id"))
    signatures = usable.select("words_key", "doc_id", "signature").join(first, ["words_key", "doc_id"]).select("doc_id", "signature")
    members = written(centres(signatures), "centres")
    # A number for each text that shares a bucket, so only their rows move.
    candidates = written(members.select(F.col("member").alias("doc_id")).distinct(), "candidates")
    candidates = counted(candidates)
    signatures = usable.select("doc_id", "signature").join(candidates, "doc_id")
    texts = written(docs.join(candidates, "doc_id").distinct(), "candidate-texts")
    pairs = likely(members, signatures)
    links = written(confirmed(pairs, texts), "star-links")
    stars = written(components(links), "star-components")

    labels = members.join(stars.withColumnRenamed("node", "member"), "member", "left")
    labels = labels.select("centre", "member", F.coalesce("component", "member").alias("component"))
    more = written(remaining_links(labels, texts, block), "remaining-links")
    final = stars
    if more.take(1):
        final = written(components(stars.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more)), "components")

    copies = first.withColumnRenamed("doc_id", "first")
    rows = sketch.select("doc_id", "words_key", "n_shingles").join(copies, "words_key", "left")
    rows = rows.join(final.select(F.col("node").alias("first"), "component"), "first", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "first")).otherwise(F.col("doc_id"))
    rows = rows.select("doc_id", "n_shingles", component.alias("component_id"))
    return rows.select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
