"""Token-id matrices packed best fit decreasing.

Documents become token ids with an end id. A document longer than a row of the
matrix is cut into full rows and a rest, losslessly. Rests wait in a buffer of
``block_tokens`` ids; when it is full, they go longest first into the row with
the least room that still holds them. A segment tree over the free capacities
finds that row in log(size) steps. Each row comes out with its ids, its cumulative
segment lengths and its positions, which start again at each segment.

The stage is narrow: no id is shuffled, a task holds one block at a time, and
a task that is lost is run again alone. ``sequence_id`` is the partition's number
and a count within it.

A null text is empty and has the end id alone. Repeated rows are packed each by
itself. An empty table gives an empty result. Ties among equal lengths go by
doc_id and start, null ids first. Only the id and the text are read, so names
cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.common import id_and_text, in_parts
from casework.llm.segments import blocks
from casework.llm.token_ids import opened, read_tokenizer

BLOCK_CHARS = 2_000_000
BLOCK_TOKENS = 4_000_000


class FreeSpace:
    """Rows by free capacity; a segment tree counts them over capacities."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._step(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The least capacity that holds ``length``, and a row with it."""
        node, count, leaves = length + self.leaves, self.count, self.leaves
        while not count[node]:
            while node & 1:  # a right child: nothing larger below its parent
                node >>= 1
            if not node:
                return None
            node += 1
            if node & (node - 1) == 0:  # past the last node of its level
                return None
        while node < leaves:
            node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - leaves
        row = self.rows[capacity].pop()
        self._step(capacity, -1)
        return capacity, row

    def _step(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Rows of indices into ``lengths``, which must not grow."""
    free, rows = FreeSpace(size), []
    for i, length in enumerate(lengths):
        found = free.take(length)
        if found is None:
            capacity, row = size, len(rows)
            rows.append([])
        else:
            capacity, row = found
        rows[row].append(i)
        if capacity > length:
            free.add(capacity - length, row)
    return rows


def packed_matrix(docs: DataFrame, tokenizer_file: str, pattern: str, size: int = 2048, end_id: int = 1, pad_id: int = 0,
                  block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per packed sequence: sequence_id; segments (doc_id, start,
    doc_tokens); cu_seqlens (0, then the end of each segment); ids and positions, ``size``
    little-endian unsigned 32-bit integers each, padded with ``pad_id`` and 0."""
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_file))
    segment = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64())])
    schema = pa.schema([("sequence_id", pa.int64()), ("segments", pa.list_(segment)), ("cu_seqlens", pa.list_(pa.int32())),
                        ("ids", pa.binary()), ("positions", pa.binary())])
    counting = np.arange(size, dtype="<u4").tobytes()
    end, pad = end_id.to_bytes(4, "little"), pad_id.to_bytes(4, "little")

    def emit(rows: list[list[tuple]], first: int) -> Iterator[pa.RecordBatch]:
        for begin in range(0, len(rows), 500):
            cols: list[list] = [[], [], [], [], []]
            for k, row in enumerate(rows[begin:begin + 500], first + begin):
                lengths = [len(part) // 4 for *_, part in row]
                gap = size - sum(lengths)
                cols[0].append(k)
                cols[1].append([{"doc_id": d, "start": s, "doc_tokens": n} for d, s, n, _ in row])
                cols[2].append([0, *np.cumsum(lengths).tolist()])
                cols[3].append(b"".join(part for *_, part in row) + pad * gap)
                cols[4].append(b"".join(counting[:4 * n] for n in lengths) + bytes(4 * gap))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = opened(shared.value, pattern)
        first, made = TaskContext.get().partitionId() << 33, 0
        rests: list[tuple] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            rests.sort(key=lambda p: (-len(p[3]), p[0] is not None, p[0] or 0, p[1]))
            rows = [[rests[i] for i in row] for row in best_fit_decreasing([len(p[3]) // 4 for p in rests], size)]
            yield from emit(rows, first + made)
            made += len(rows)
            rests.clear()

        for batch in in_parts(batches):
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for begin, stop in blocks(texts, BLOCK_CHARS):
                full = []
                for key, ids in zip(keys[begin:stop], tok.many(texts[begin:stop])):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, size):
                        part = ids[4 * start:4 * (start + size)]
                        (full.append([(key, start, n, part)]) if len(part) == 4 * size else rests.append((key, start, n, part)))
                    held += n % size
                yield from emit(full, first + made)
                made += len(full)
                if held >= block_tokens:
                    yield from flush()
                    held = 0
        yield from flush()

    sql = ("sequence_id long, segments array<struct<doc_id: long, start: long, doc_tokens: long>>, cu_seqlens array<int>, "
           "ids binary, positions binary")
    return id_and_text(docs, id_col, text_col).mapInArrow(run, sql)


def write_matrix(packed: DataFrame, path: str) -> None:
    """Rows as Parquet files of fixed-width binary ids, positions and segment ends."""
    packed.write.mode("errorifexists").parquet(path)


def segment_rows(packed: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each segment."""
    at = F.posexplode("segments").alias("k", "segment")
    rows = packed.select("sequence_id", "cu_seqlens", "ids", at)
    begin, end = F.col("cu_seqlens")[F.col("k")], F.col("cu_seqlens")[F.col("k") + 1]
    part = F.expr("substring(ids, 4 * cu_seqlens[k] + 1, 4 * (cu_seqlens[k + 1] - cu_seqlens[k]))")
    return rows.select("segment.doc_id", "segment.start", (end - begin).cast("long").alias("length"),
                       F.crc32(part).alias("ids_crc32"), "segment.doc_tokens", "sequence_id", begin.cast("long").alias("offset"))
