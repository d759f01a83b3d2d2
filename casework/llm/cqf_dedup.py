"""Exact deduplication with counting quotient filters.

Each partition of documents writes its fingerprints into a counting quotient
filter: a fingerprint's upper bits (quotient) choose the run, its lower bits
(remainder) are kept sorted in the run, each with a count, so nothing is lost.
A filter is cut into slices by the leading bits; slices of the same range
meet in one task and merge by sorted remainders, adding counts. The number of
slices follows the number of documents, so a slice's size does not grow with
the data. Fingerprints counted more than once go on to a comparison of the
normalised texts byte by byte; the others are unique.

Texts are equal when identical after lower-casing A-Z. The row with the
largest doc_id stays. A null text is empty, and empty texts equal each other.
Repeated rows are members of their group each; rows that share the largest
doc_id all count as kept. A null doc_id is smaller than any other; a group with
null ids alone keeps its first row's null id. An empty table gives an
empty result. Only the id and the text are read, so names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.common import counted, groups_for, id_and_text, in_parts, written

#: Fingerprints in one slice of the merged filter, on average.
SLICE = 100_000


class CountingQuotientFilter:
    """Fingerprints of 64 bits as runs of sorted remainders with counts.

    ``quotients`` holds the occupied quotients in order, ``ends`` where each
    one's run ends, ``remainders`` and ``counts`` the runs' entries.
    """

    def __init__(self, quotient_bits: int, quotients: np.ndarray, ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotient_bits = quotient_bits
        self.quotients, self.ends, self.remainders, self.counts = quotients, ends, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray, quotient_bits: int) -> CountingQuotientFilter:
        values, at = np.unique(fingerprints.astype(np.uint64), return_inverse=True)
        totals = np.zeros(len(values), dtype=np.int64)
        np.add.at(totals, at, counts)
        return cls._packing(values, totals, quotient_bits)

    @classmethod
    def _packing(cls, values: np.ndarray, totals: np.ndarray, quotient_bits: int) -> CountingQuotientFilter:
        """From sorted distinct fingerprints: runs end where the quotient changes."""
        below = np.uint64(64 - quotient_bits)
        upper = values >> below
        ends = np.append(np.flatnonzero(upper[1:] != upper[:-1]) + 1, len(values))[:len(values)].astype(np.int64)
        return cls(quotient_bits, upper[ends - 1], ends, values & ((np.uint64(1) << below) - np.uint64(1)), totals)

    def fingerprints(self) -> np.ndarray:
        runs = np.diff(self.ends, prepend=0)
        return np.repeat(self.quotients, runs) << np.uint64(64 - self.quotient_bits) | self.remainders

    def merged(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both filters' entries; equal remainders of a run add their counts."""
        if not len(self.remainders) or not len(other.remainders):
            return self if len(self.remainders) else other
        # Both runs of a quotient are sorted by remainder, so each entry of the
        # other filter has its place here by search; nothing is sorted anew.
        mine, theirs = self.fingerprints(), other.fingerprints()
        at = np.searchsorted(mine, theirs)
        equal = mine[np.minimum(at, len(mine) - 1)] == theirs
        counts = self.counts.copy()
        counts[at[equal]] += other.counts[equal]
        values = np.insert(mine, at[~equal], theirs[~equal])
        return self._packing(values, np.insert(counts, at[~equal], other.counts[~equal]), self.quotient_bits)

    def slices(self, slice_bits: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """Parts with the same leading bits of the quotient."""
        prints = self.fingerprints()
        lead = prints >> np.uint64(64 - slice_bits) if slice_bits else np.zeros(len(prints), dtype=np.uint64)
        keys, begins = np.unique(lead, return_index=True)
        for key, a, b in zip(keys.tolist(), begins, np.append(begins[1:], len(prints))):
            yield key, self.of(prints[a:b], self.counts[a:b], self.quotient_bits)

    def packed(self) -> bytes:
        sizes = np.array([self.quotient_bits, len(self.quotients), len(self.remainders)], dtype="<i8")
        parts = (sizes, self.quotients.astype("<u8"), self.ends.astype("<i8"), self.remainders.astype("<u8"), self.counts.astype("<i8"))
        return b"".join(p.tobytes() for p in parts)

    @classmethod
    def unpacked(cls, raw: bytes) -> CountingQuotientFilter:
        bits, q, n = np.frombuffer(raw, dtype="<i8", count=3).tolist()
        at, parts = 24, []
        for kind, size in (("<u8", q), ("<i8", q), ("<u8", n), ("<i8", n)):
            parts.append(np.frombuffer(raw, dtype=kind, count=size, offset=at))
            at += 8 * size
        return cls(bits, *parts)


def _normalised(texts: pa.Array) -> list[bytes]:
    # bytes.lower() changes A-Z and nothing else.
    return [t.lower() for t in texts.cast(pa.binary()).to_pylist()]


def _print(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "big", signed=True)


def text_digests(docs: DataFrame) -> DataFrame:
    """doc_id, print (64 bits) and text_sha256 of the normalised text, and row if ``docs`` has it."""
    more = [c for c in ("row",) if c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            shas = [hashlib.sha256(t).digest() for t in _normalised(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(_print, shas), pa.int64()), pa.array([s.hex() for s in shas], pa.string()), *batch.columns[2:]],
                names=["doc_id", "print", "text_sha256", *more])

    return docs.select("doc_id", "text", *more).mapInArrow(run, "doc_id long, print long, text_sha256 string" + ", row long" * len(more))


def batch_texts(docs: DataFrame) -> DataFrame:
    """print, text_sha256, text, keep_id, rows: equal texts of an Arrow batch in one row, so
    that a text which makes a third of all rows leaves each task a few times."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[bytes, list] = {}
            for key, text in zip(batch.column(0).to_pylist(), _normalised(batch.column(1))):
                group = groups.setdefault(text, [key, 0])
                group[0] = key if group[0] is None else group[0] if key is None else max(group[0], key)
                group[1] += 1
            shas = [hashlib.sha256(t).digest() for t in groups]
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(_print, shas), pa.int64()), pa.array([s.hex() for s in shas], pa.string()),
                 pa.array(list(groups), pa.binary()).cast(pa.string()),
                 pa.array([k for k, _ in groups.values()], pa.int64()), pa.array([n for _, n in groups.values()], pa.int64())],
                names=["print", "text_sha256", "text", "keep_id", "rows"])

    return docs.select("doc_id", "text").mapInArrow(run, "print long, text_sha256 string, text string, keep_id long, rows long")


def repeated_prints(digests: DataFrame, rows: int, per_slice: int = SLICE) -> DataFrame:
    """print and n of the fingerprints counted more than once."""
    slice_bits = (groups_for(rows, per_slice) - 1).bit_length()
    quotient_bits = max(slice_bits, min(40, rows.bit_length()), 1)

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            one = CountingQuotientFilter.of(prints, np.ones(len(prints), dtype=np.int64), quotient_bits)
            held = one if held is None else held.merged(one)
            if len(held.remainders) > 8 * per_slice:  # the filter of this part is full: start another
                yield from emit(held)
                held = None
        if held is not None:
            yield from emit(held)

    def emit(held: CountingQuotientFilter) -> Iterator[pa.RecordBatch]:
        parts = list(held.slices(slice_bits))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int64()), pa.array([f.packed() for _, f in parts], pa.binary())],
                                         names=["slice", "filter"])

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        # Pairwise, like merge sort: every entry is handled log(parts) times.
        parts = [CountingQuotientFilter.unpacked(raw) for raw in group["filter"]]
        while len(parts) > 1:
            parts = [a.merged(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2:]
        more = parts[0].counts > 1
        return pd.DataFrame({"print": parts[0].fingerprints()[more].view(np.int64), "n": parts[0].counts[more]})

    slices = digests.select("print").mapInArrow(filters, "slice long, filter binary")
    return slices.groupBy("slice").applyInPandas(merge, "print long, n long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_slice: int = SLICE,
                 row_col: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row, and row if ``row_col`` numbers the rows."""
    more = [] if row_col is None else ["row"]
    if row_col is not None:
        docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(row_col).alias("row"))
        id_col, text_col = "doc_id", "text"
    docs = id_and_text(docs, id_col, text_col, *more)
    digests = written(text_digests(docs), "digests")
    repeated = repeated_prints(digests, digests.count(), per_slice)

    # Grouping on the text itself compares bytes. Only texts with a repeated
    # fingerprint move, as long as those are few enough to broadcast by count.
    repeated = counted(written(repeated.select("print"), "repeated-prints"))
    texts = batch_texts(docs).join(repeated, "print", "left_semi")
    verified = texts.groupBy("print", "text_sha256", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("rows").alias("rows"))
    # Different texts under one digest would need more than the digest to
    # tell their rows apart: stop rather than call them equal.
    groups = verified.groupBy("print", "text_sha256").agg(
        F.max("keep_id").alias("group_keep"), F.sum("rows").alias("rows"), F.count("*").alias("texts"))
    size = F.when(F.col("texts") == 1, F.col("rows")).otherwise(F.raise_error(F.lit("different texts share a SHA-256")))
    groups = groups.select("print", "text_sha256", "group_keep", size.cast("long").alias("rows"))

    rows = digests.join(groups, ["print", "text_sha256"], "left")
    keep = F.when(F.col("rows").isNull(), F.col("doc_id")).otherwise(F.col("group_keep"))
    return rows.select("doc_id", keep.alias("keep_id"), F.coalesce("rows", F.lit(1)).cast("long").alias("group_size"),
                       F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", *more)
