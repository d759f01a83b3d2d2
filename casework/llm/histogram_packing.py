"""Packing by the length histogram, shortest pack first.

Documents become token ids with an end id; a document longer than a sequence
is cut into full sequences and a rest. All pieces' lengths are counted; the
histogram (at most ``size`` rows, whatever the data) is packed on the driver:
lengths go longest first into the shortest pack that has room, whole counts at
a time, so a pattern of lengths stands for many equal packs. The patterns then
join back to the pieces by length and by rank among equal lengths.

A null text is empty and has the end id alone. Repeated rows are packed each by
itself. An empty table gives an empty result. Ties among equal lengths go by
doc_id and start. Only the id and the text are read, so names cannot clash. A null
id is carried along.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casework.llm.common import groups_for, id_and_text, in_parts, memory_given_back, written
from casework.llm.segments import blocks
from casework.llm.token_ids import opened, read_tokenizer

BLOCK_CHARS = 2_000_000
#: Pieces of one length that one task ranks.
RANK_GROUP = 1_000


def token_pieces(docs: DataFrame, tokenizer_file: str, pattern: str, size: int, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece (and its
    ids), and piece, a number of its own as long as the rows are not made anew."""
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_file))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece"]
    schema = pa.schema([(n, pa.int64()) for n in names] + [("ids", pa.binary())] * with_ids)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, piece = opened(shared.value, pattern), TaskContext.get().partitionId() << 40
        for batch in in_parts(batches):
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for begin, stop in blocks(texts, BLOCK_CHARS):
                rows = []
                for key, ids in zip(keys[begin:stop], tok.many(texts[begin:stop])):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, size):
                        part = ids[4 * start:4 * (start + size)]
                        rows.append((key, start, len(part) // 4, zlib.crc32(part), n, piece, part))
                        piece += 1
                cols = list(zip(*rows))[:len(schema)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
        tok.pieces.forget()  # the worker goes on to other tasks
        memory_given_back()

    sql = ", ".join(f"{n} long" for n in names) + ", ids binary" * with_ids
    return id_and_text(docs, id_col, text_col).mapInArrow(run, sql)


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths in a pack, longest first) and how many packs have each.

    ``open`` holds patterns by the length they hold so far; the shortest comes
    first. A pattern splits in two when fewer pieces remain than it has packs.
    """
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    held: list[int] = []
    done: list[tuple[list[int], int]] = []

    def put(pattern: tuple[int, ...], total: int, packs: int) -> None:
        if total == size:
            done.append((list(pattern), packs))
            return
        if not open_[total]:
            heapq.heappush(held, total)
        open_[total].append((pattern, packs))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left and held and held[0] + length <= size:
            total = held[0]
            pattern, packs = open_[total].pop()
            if not open_[total]:
                heapq.heappop(held)
            used = min(left, packs)
            if packs > used:
                put(pattern, total, packs - used)
            put((*pattern, length), total + length, used)
            left -= used
        if left:
            # Several of this length share a new pack where they fit.
            put((length,), length, left) if 2 * length > size else _stack(put, length, left, size)
    return done + [(list(p), n) for patterns in open_.values() for p, n in patterns]


def _stack(put, length: int, left: int, size: int) -> None:
    per = size // length
    full, rest = divmod(left, per)
    if full:
        put((length,) * per, per * length, full)
    if rest:
        put((length,) * rest, rest * length, 1)


def slots(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset) of each place."""
    used: dict[int, int] = defaultdict(int)
    out, first = [], 0
    for lengths, packs in patterns:
        offset = 0
        for length in lengths:
            out.append((length, used[length], packs, first, offset))
            used[length] += packs
            offset += length
        first += packs
    return out


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """``pieces`` (doc_id, start, length, piece, ...) with sequence_id and offset.

    ``pieces`` must give the same rows each time it is read (a written table).
    """
    spark = pieces.sparkSession
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    places = slots(pack_histogram(counts, size))
    schema = "length long, first long, packs long, sequence long, offset long"
    places = spark.createDataFrame(places, schema).repartition(1) if places else spark.createDataFrame([], schema)

    # Rank among equal lengths in two levels: within groups of bounded size,
    # then by the sizes of the groups before. A length has as many groups as
    # its count asks for, so a hot length is dealt over many tasks.
    shares = spark.createDataFrame([(n, groups_for(k, RANK_GROUP)) for n, k in counts.items()], "length long, shares long")
    share = F.pmod(F.xxhash64("piece"), F.col("shares")).alias("share")
    keyed = pieces.join(F.broadcast(shares), "length").select(*pieces.columns, share)  # a row for each length
    sizes = keyed.groupBy("length", "share").count()
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "share", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "share").orderBy("doc_id", "start", "piece")
    ranked = keyed.withColumn("nth", F.row_number().over(within) - 1).join(sizes, ["length", "share"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth")).drop("before", "nth", "share")
    # At most ``size`` lengths with a bounded number of places each: the size
    # of the table follows from ``size``, not from the data.
    at = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("packs"))
    joined = ranked.join(F.broadcast(places), "length").where(at)
    return joined.select(*[c for c in pieces.columns if c != "piece"], (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")


def packed_documents(docs: DataFrame, tokenizer_file: str, pattern: str, size: int = 2048, end_id: int = 1,
                     id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    pieces = written(token_pieces(docs, tokenizer_file, pattern, size, end_id, id_col, text_col, with_ids), "pieces")
    return pack(pieces, size)


def sequences(packed: DataFrame, size: int, pad_id: int) -> DataFrame:
    """sequence_id and its ids (array of ``size``), from pieces with ids: at
    most ``size`` pieces meet in a row."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.concat_ws("", F.transform(parts, lambda p: F.hex(p["ids"])))
    padded = F.rpad(joined, 8 * size, F.hex(F.lit(pad_id.to_bytes(4, "little"))))
    return packed.groupBy("sequence_id").agg(F.unhex(padded).alias("ids"))
