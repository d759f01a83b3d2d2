"""Benchmark decontamination by word n-grams.

The windows of ``size`` consecutive words of every benchmark item (an item with fewer
words is one window) go into a hash set that is broadcast; a pass over the
documents hashes every token window, looks it up, and verifies each hit on the words
themselves. Words inside verified windows are marked; documents with marked words,
or the marked spans alone, can be removed.

The set is built in blocks of at most ``BLOCK_WINDOWS`` windows and about
``BLOCK_BYTES`` bytes of text, counted beforehand, so what is broadcast does not
grow with the benchmark: with one block the job is one narrow pass over the
documents; with more, every block is held against all documents and only
the rows with hits are gathered, by row. Nothing else is shuffled, so a passage
that a third of the documents hold makes no hot key.

Words are runs of digits, letters and everything beyond ASCII, with A-Z lower-cased.
A null text has no words: no hits as a document, no windows as an item. Long texts are
hashed in pieces, never cut. Items that repeat an id count once; a null item_id
counts as an item and stands as empty text in the list. Rows that repeat a doc_id are documents of
their own. Empty tables give no hits or no rows. ``contaminated`` reads the id and the
text alone; ``decontaminated`` keeps all other columns untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casework.llm.common import in_parts, written
from casework.session import ship_package

#: One broadcast block of the window set: about 16 MB of text and 30 MB of numbers.
BLOCK_WINDOWS = 1_000_000
BLOCK_BYTES = 16 << 20
#: Words of one part of a long item.
PART_WORDS = 50_000
#: Bytes of text that are hashed at a time.
PIECE = 1 << 20

#: A-Z become a-z; what is no word character becomes a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_IS_WORD = np.frombuffer(NORMAL, dtype=np.uint8) != 32

_BASE, _STEP = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
RUNS = "array<struct<first:long,last:long,start:long,end:long>>"


def normalised(text: str | None) -> bytes:
    """The words of a text, one space apart."""
    return b" ".join((text or "").encode().translate(NORMAL).split())


def _bounds(norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of normalised bytes begins and ends."""
    if not len(norm):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    spaces = np.flatnonzero(norm == 32)
    return np.append(0, spaces + 1), np.append(spaces, len(norm))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _BASE, dtype=np.uint64)) if n else np.zeros(0, dtype=np.uint64)


def word_hashes(norm: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, a piece of the text at a time."""
    out = np.empty(len(begins), dtype=np.uint64)
    a = 0
    while a < len(begins):
        b = max(a + 1, int(np.searchsorted(ends, begins[a] + PIECE, side="right")))
        low = begins[a]
        sizes = ends[a:b] - begins[a:b]
        within = np.arange(ends[b - 1] - low + 1) - np.repeat(begins[a:b] - low, sizes + 1)
        raw = np.append(norm[low:ends[b - 1]], 32).astype(np.uint64)
        raw[raw == 32] = 0  # the space behind each word
        out[a:b] = np.add.reduceat(raw * _powers(int(sizes.max()) + 1)[within], begins[a:b] - low)
        a = b
    # Mixed, so that sums of neighbours spread over all 64 bits.
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    return out ^ (out >> np.uint64(29))


def window_hashes(words: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each size, the hashes of all windows of so many words, by first word."""
    total, factor = np.zeros(len(words), dtype=np.uint64), 1
    for n in range(1, max(sizes, default=0) + 1):
        if len(words) < n:
            return
        total = total[:len(words) - n + 1] + words[n - 1:] * np.uint64(factor)
        factor = factor * _STEP % (1 << 64)
        if n in sizes:
            mixed = (total ^ (total >> np.uint64(33))) * np.uint64(2 * n + 1)
            yield n, mixed ^ (mixed >> np.uint64(32))


class WindowSet:
    """The windows of some item parts: sorted hashes, and where each window's
    words lie in the parts' text."""

    def __init__(self, parts: list[tuple[int | None, bytes]], size: int):
        self.text = b" ".join(norm for _, norm in parts)
        hashes, begins, ends, items, at = [], [], [], [], 0
        self.sizes: set[int] = set()
        for item, norm in parts:
            arr = np.frombuffer(norm, dtype=np.uint8)
            b, e = _bounds(arr)
            n = min(size, len(b))
            for _, h in window_hashes(word_hashes(arr, b, e), [n] if n else []):
                hashes.append(h)
                begins.append(b[:len(h)] + at)
                ends.append(e[n - 1:] + at)
                items += [item] * len(h)
                self.sizes.add(n)
            at += len(norm) + 1
        joined = lambda xs, kind: np.concatenate(xs).astype(kind) if xs else np.zeros(0, dtype=kind)
        order = np.argsort(joined(hashes, np.uint64), kind="stable")
        self.hashes = joined(hashes, np.uint64)[order]
        self.begins, self.ends = joined(begins, np.int64)[order], joined(ends, np.int64)[order]
        self.items = [items[i] for i in order.tolist()]

    def filter(self) -> tuple[np.ndarray, np.uint64]:
        """A table of the hashes' leading bits, 16 places or more for each one."""
        bits = min(24, max(10, (16 * len(self.hashes)).bit_length()))
        shift = np.uint64(64 - bits)
        table = np.zeros(1 << bits, dtype=bool)
        table[self.hashes >> shift] = True
        return table, shift

    def found(self, hashes: np.ndarray, table: np.ndarray, shift: np.uint64) -> Iterator[tuple[int, int, int]]:
        """place, and the range of entries with the hash found there."""
        likely = np.flatnonzero(table[hashes >> shift])
        low = np.searchsorted(self.hashes, hashes[likely], side="left")
        high = np.searchsorted(self.hashes, hashes[likely], side="right")
        hit = high > low
        return zip(likely[hit].tolist(), low[hit].tolist(), high[hit].tolist())


def _code_points(text: str, words: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points where runs of words (first, last) begin and end in the text."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    word = _IS_WORD[raw]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    before = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    return [(int(before[begins[a]]), int(before[ends[b]])) for a, b in words]


def _scanned(texts: list[str | None], block: WindowSet, table: np.ndarray, shift: np.uint64) -> list[tuple[int, list[tuple], list]]:
    """Of each text: number of words, runs of marked words, items found."""
    norms = [normalised(t) for t in texts]
    full = [i for i, n in enumerate(norms) if n]
    buffer = b" ".join(norms[i] for i in full)
    arr = np.frombuffer(buffer, dtype=np.uint8)
    begins, ends = _bounds(arr)
    # The first word of each text, and the one behind its last.
    firsts = np.searchsorted(begins, np.cumsum([0] + [len(norms[i]) + 1 for i in full]))
    of = np.repeat(np.arange(len(full)), np.diff(firsts))
    marked = np.zeros(len(begins) + 1, dtype=np.int32)
    verified: dict[tuple[int, bytes], frozenset] = {}
    items: dict[int, set[tuple[int, bytes]]] = {}
    for n, hashes in window_hashes(word_hashes(arr, begins, ends), sorted(block.sizes)):
        for place, low, high in block.found(hashes, table, shift):
            if of[place] != of[place + n - 1]:
                continue
            words = buffer[begins[place]:ends[place + n - 1]]
            key = low, words
            if key not in verified:
                verified[key] = frozenset(block.items[e] for e in range(low, high) if block.text[block.begins[e]:block.ends[e]] == words)
            if verified[key]:
                marked[place] += 1
                marked[place + n] -= 1
                items.setdefault(int(of[place]), set()).add(key)
    out: list[tuple[int, list[tuple], list]] = [(0, [], [])] * len(texts)
    covered = np.cumsum(marked[:-1]) > 0
    for k, i in enumerate(full):
        a, b = int(firsts[k]), int(firsts[k + 1])
        runs = []
        if k in items:
            edge = np.diff(covered[a:b].astype(np.int8), prepend=0, append=0)
            words = list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))
            runs = [(*w, *c) for w, c in zip(words, _code_points(texts[i], words))]
        out[i] = (b - a, runs, sorted(frozenset().union(*[verified[key] for key in items.get(k, ())]), key=str))
    return out


def scanned(docs: DataFrame, block: WindowSet) -> DataFrame:
    """``docs`` (any columns, and the column text) with n_words, runs of marked words and items in place of the text."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(block)
    kept = [f for f in docs.schema.fields if f.name != "text"]
    at = docs.columns.index("text")
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "end")]))
    names = ("first", "last", "start", "end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        table, shift = block.filter()
        for batch in in_parts(batches):
            texts, found, part, size = batch.column(at).to_pylist(), [], [], 0
            for text in texts:
                part.append(text)
                size += len(text or "")
                if size >= PIECE:
                    found += _scanned(part, block, table, shift)
                    part, size = [], 0
            found += _scanned(part, block, table, shift)
            yield pa.RecordBatch.from_arrays(
                [*[c for i, c in enumerate(batch.columns) if i != at], pa.array([f[0] for f in found], pa.int64()),
                 pa.array([[dict(zip(names, r)) for r in f[1]] for f in found], run_type), pa.array([f[2] for f in found], pa.list_(pa.int64()))],
                names=[*[f.name for f in kept], "n_words", "runs", "items"])

    found = T.StructType.fromDDL(f"n_words long, runs {RUNS}, items array<long>")
    return docs.mapInArrow(run, T.StructType([*kept, *found.fields]))


def window_blocks(bench: DataFrame, size: int, id_col: str, text_col: str,
                  most_windows: int = BLOCK_WINDOWS, most_bytes: int = BLOCK_BYTES) -> Iterator[WindowSet]:
    """The items' windows in blocks of bounded size; items are read in parts
    that overlap by ``size`` - 1 words."""
    ship_package(bench.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            rows = []
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = normalised(text).split()
                for a in range(0, max(1, len(words) - size + 1) if words else 0, PART_WORDS):
                    part = words[a:a + PART_WORDS + size - 1]
                    rows.append((key, b" ".join(part), max(1, len(part) - size + 1)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (pa.int64(), pa.binary(), pa.int64()))],
                                             names=["item", "words", "windows"])

    items = bench.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    parts = written(items.mapInArrow(run, "item long, words binary, windows long").distinct(), "benchmark-parts")
    total = parts.agg(F.sum("windows").alias("windows"), F.sum(F.length("words")).alias("bytes")).first()
    blocks = max(1, -(-(total.windows or 0) // most_windows), -(-(total.bytes or 0) // most_bytes))
    share = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))
    for i in range(blocks):
        yield WindowSet([(r.item, bytes(r.words)) for r in parts.where(share == i).select("item", "words").collect()], size)


def _merged(docs: DataFrame, found: list[DataFrame]) -> DataFrame:
    """The rows of ``docs`` (with row) and what all blocks found in them."""
    hits = reduce(DataFrame.unionAll, [f.select("row", "runs", "items").where(F.size("items") > 0) for f in found])
    # A row meets each block once: the lists are bounded by its text and the blocks.
    hits = hits.groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = []
            for runs in batch.column(1).to_pylist():
                out: list[dict] = []
                for r in sorted(runs, key=lambda r: (r["first"], r["last"])):
                    if out and r["first"] <= out[-1]["last"] + 1:
                        if r["last"] > out[-1]["last"]:
                            out[-1] |= {"last": r["last"], "end": r["end"]}
                    else:
                        out.append(dict(r))
                merged.append(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(merged, batch.schema.field(1).type), batch.column(2)], names=batch.schema.names)

    hits = written(hits.mapInArrow(run, hits.schema), "hits").withColumnRenamed("row", "hit_row")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    rows = docs.join(hits, F.col("row") == F.col("hit_row"), "left")
    return rows.select(*docs.columns, empty("runs", RUNS), empty("items", "array<long>"))


def marked(docs: DataFrame, bench: DataFrame, size: int = 10, item_col: str = "item_id", item_text_col: str = "text",
           most_windows: int = BLOCK_WINDOWS, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs``, whose last column is text, with n_words, runs and items in place of it."""
    blocks = window_blocks(bench, size, item_col, item_text_col, most_windows, most_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return scanned(docs, first)
    others = [c for c in docs.columns if c != "text"]
    rows = written(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = [written(scanned(rows.select("row", "text"), first), "found")]
    words = found[0].select(F.col("row").alias("word_row"), "n_words")
    for block in (b for some in ([second], blocks) for b in some):
        found.append(written(scanned(rows.select("row", "text"), block).where(F.size("items") > 0), "found"))
    counted = rows.drop("text").join(words, F.col("row") == F.col("word_row")).drop("word_row")
    return _merged(counted, found).select(*others, "n_words", "runs", "items")


def _marked_words(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)


def contaminated(docs: DataFrame, bench: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the
    marked spans (code points, end exclusive) of every row."""
    rows = marked(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), bench, size, **more)
    names = F.array_sort(F.transform("items", lambda i: F.coalesce(i.cast("string"), F.lit(""))))
    n_hit = _marked_words(F.col("runs"))
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"),
                       F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("spans"))


def decontaminated(docs: DataFrame, bench: DataFrame, remove: str = "documents", size: int = 10, text_col: str = "text", **more) -> DataFrame:
    """``docs`` without the documents that have marked words, or with the marked
    spans cut from their texts (``remove="spans"``)."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove documents or spans")
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = marked(packed, bench, size, **more)
    columns = {c: F.col(f"doc.c{i}") for i, c in enumerate(names)}
    if remove == "documents":
        rows = rows.where(F.size("runs") == 0)
    else:
        text, runs = columns[text_col], F.col("runs")
        begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(runs, lambda r: r["end"]))
        ends = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.length(text).cast("long")))
        between = F.zip_with(begins, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
        columns[text_col] = F.when(F.size(runs) == 0, text).otherwise(F.array_join(between, ""))
    return rows.select(*[c.alias(n) for n, c in columns.items()])
