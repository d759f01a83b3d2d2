from __future__ import annotations

import random
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from casework.llm.histogram_packing import pack_histogram, packed_documents, sequences, slots, token_pieces
from casework.llm.matrix_packing import FreeSpace, best_fit_decreasing, packed_matrix, segment_rows
from casework.llm.token_ids import opened, read_tokenizer
from tests.llm.test_byte_bpe import ODD

FILE = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(FILE)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_match_the_library(library):
    tok = opened(read_tokenizer(FILE), PATTERN)
    rng = random.Random(3)
    alphabet = list(" \n\t'.,abcXYZ019éüß中  ") + ["the", "ing", " of", "'s", "\U0001f600", "<|endoftext|>"]
    end = "<|endoftext|>"
    texts = ODD + [end, end + end, f"x {end} y", f"{end}the\n", f"a{end}b {end}", "<|endoftext|", f"é {end}\U0001f600", f" {end} {end} "] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(1000)]
    for text, ids in zip(texts, tok.many(texts)):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library(text), repr(text[:40])


def test_an_added_token_has_its_own_id(library):
    assert library("x <|endoftext|> y") == [87, 220, 50256, 331]
    (ids,) = opened(read_tokenizer(FILE), PATTERN).many(["x <|endoftext|> y"])
    assert list(struct.unpack("<4I", ids)) == [87, 220, 50256, 331]


def test_equal_rows_are_ranked_in_many_tasks(spark, library):
    """Rows that repeat id and text share a length, a start and all ids."""
    frame = spark.range(3000).selectExpr("cast(null as long) as doc_id", "'same words' as text").repartition(4)
    pieces = token_pieces(frame, FILE, PATTERN, 2048, 1)
    assert pieces.select("piece").distinct().count() == 3000
    rows = packed_documents(frame, FILE, PATTERN).collect()
    assert "piece" not in rows[0] and check(rows, [(None, "same words", 3000)], library, 2048) < 1.3


def test_every_entry_matches_the_library(library):
    tok = opened(read_tokenizer(FILE), PATTERN)
    entries = [e for e in (b.decode("utf-8", "ignore") for b in tok.fast._mergeable_ranks) if e]
    for text, ids in zip(entries, tok.many(entries)):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library(text), repr(text)


def test_histogram_packs_hold_every_piece():
    rng = random.Random(1)
    for size in (1, 7, 64, 2048):
        counts = Counter(rng.randint(1, size) for _ in range(5000))
        patterns = pack_histogram(counts, size)
        assert all(sum(p) <= size for p, _ in patterns)
        got = Counter()
        for p, n in patterns:
            for length in p:
                got[length] += n
        assert got == counts
        packs = sum(n for _, n in patterns)
        assert packs * size <= 1.03 * sum(k * v for k, v in counts.items()) + 2 * size
    assert pack_histogram({}, 8) == [] and slots([]) == []
    assert pack_histogram({3: 7}, 8) == [([3, 3], 3), ([3], 1)]


def test_segment_tree_finds_the_least_capacity():
    rng, size = random.Random(2), 50
    tree, held = FreeSpace(size), []
    for step in range(4000):
        if rng.random() < 0.5:
            c = rng.randint(1, size)
            tree.add(c, step)
            held.append(c)
        else:
            want = rng.randint(1, size)
            least = min((c for c in held if c >= want), default=None)
            got = tree.take(want)
            assert (got[0] if got else None) == least
            if got:
                held.remove(got[0])


def test_best_fit_matches_a_plain_search():
    rng = random.Random(4)
    lengths = sorted((rng.randint(1, 100) for _ in range(500)), reverse=True)
    room: list[int] = []
    for n in lengths:
        fit = min((r for r in room if r >= n), default=None)
        room.append(100 - n) if fit is None else room.__setitem__(room.index(fit), fit - n)
    rows = best_fit_decreasing(lengths, 100)
    assert len(rows) == len(room)
    assert sorted(i for r in rows for i in r) == list(range(500))


def docs(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["the", "inner", "quay", "zz9"]) for _ in range(rng.choice([0, 3, 40, 900]))), i, "x") for i in range(120)]
    rows += [(190, "one <|endoftext|> two", 1, "x"), (191, "<|endoftext|>" * 200, 1, "x"), (200, None, 1, "x"), (201, "", 1, "x"), (202, "same", 1, "x"), (202, "same", 1, "x"), (None, "no id", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, length int, start string")


def check(rows, texts, library, size):
    by_doc = defaultdict(list)
    by_row = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_row[r.sequence_id].append(r)
    seen = 0
    for row in by_row.values():
        at = 0
        for r in sorted(row, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    for key, text, times in texts:
        ids = library(text) + [1]
        pieces = sorted(by_doc[key], key=lambda r: r.start)
        assert len(pieces) == times * -(-len(ids) // size)
        for r in pieces:
            part = ids[r.start:r.start + r.length]
            assert r.doc_tokens == len(ids) and len(part) == r.length
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            seen += r.length
        assert sum(r.length for r in pieces) == times * len(ids)
    assert seen == sum(r.length for r in rows)
    return len(by_row) * size / seen


def expected(frame):
    rows = Counter((r.doc_id, r.text) for r in frame.collect())
    return [(k, t, n) for (k, t), n in rows.items()]


def test_histogram_packing_on_documents(spark, library):
    frame = docs(spark)
    packed = packed_documents(frame, FILE, PATTERN, size=128, with_ids=True)
    rows = packed.collect()
    assert check(rows, expected(frame), library, 128) < 1.03
    full = sequences(packed, 128, 0).collect()
    assert all(len(r.ids) == 512 for r in full) and len(full) == len({r.sequence_id for r in rows})
    whole = {r.sequence_id: bytes(r.ids) for r in full}
    for r in rows:
        assert whole[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)] == bytes(r.ids)
    assert packed_documents(frame.limit(0), FILE, PATTERN).count() == 0


def test_matrix_packing_on_documents(spark, library):
    frame = docs(spark).coalesce(2)
    packed = packed_matrix(frame, FILE, PATTERN, size=128, block_tokens=5000)
    rows = segment_rows(packed).collect()
    assert check(rows, expected(frame), library, 128) < 1.1
    for r in packed.collect():
        positions = struct.unpack("<128I", r.positions)
        assert len(r.ids) == 512 and r.cu_seqlens[0] == 0
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b] == tuple(range(b - a))
    assert packed_matrix(frame.limit(0), FILE, PATTERN).count() == 0
