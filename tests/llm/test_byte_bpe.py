from __future__ import annotations

import base64
import hashlib
import random
import struct
import unicodedata

import public_tokenizers
import pytest
import regex
import tiktoken

from casework.llm.byte_bpe import ByteBPE, decode_documents, encode_documents, read_ranks, sentencepiece_model

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    tokens = read_ranks(RANKS)
    return ByteBPE(tokens, sentencepiece_model(tokens), public_tokenizers.PATTERN)


def ids(coded):
    return list(struct.unpack(f"<{len(coded) // 4}I", coded))


ODD = ["", " ", "  ", "a", "a ", " a", "a  b", "a \n b", "x\n\n  y", "\t a", "it's we'll I'D", "12 3a", "  b", " 　c ", "\x1c a \x1f",
       "<|endoftext|> b", "café 中文 \U0001f600!", "a  b", "." * 5000, "q" * 20000, " ".join(["ab"] * 3000),
       "\U000323b0\U000323b1x \U00011de0՘ z", "̀́a", "\r\n \r\n", "a\x0b b\x85 c"]


def test_odd_texts_match(bpe, tik):
    for text, coded in zip(ODD, bpe.encode_many(ODD)):
        assert ids(coded) == tik.encode_ordinary(text), repr(text[:30])
        assert bpe.decode(coded) == text.encode()


def test_random_texts_match(bpe, tik):
    rng = random.Random(5)
    alphabet = list(" \n\t'.,abcdeXYZ0123456789éèüß中  ") + ["the", "ing", " of", "'s", "\U0001f600", "  "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    for text, coded in zip(texts, bpe.encode_many(texts)):
        assert ids(coded) == tik.encode_ordinary(text), repr(text)


def test_vocabulary_entries_encode_alike(bpe, tik):
    entries = [t.decode() for t in bpe.tokens[:20000:7] if t.decode("utf-8", "ignore").encode() == t]
    for text, coded in zip(entries, bpe.encode_many(entries)):
        assert ids(coded) == tik.encode_ordinary(text), repr(text)


def test_letters_that_differ_between_the_libraries_are_unassigned_here():
    kinds = {k: regex.compile(rf"\p{{{k}}}") for k in "LN"}
    ranks = {bytes([i]): i for i in range(256)}
    for k, here in kinds.items():
        there = tiktoken.Encoding("k", pat_str=rf"\p{{{k}}}", mergeable_ranks=ranks, special_tokens={})
        for cp in (c for a, b in ((0, 0xD800), (0xE000, 0x40000)) for c in range(a, b)):
            ch = chr(cp)
            if unicodedata.category(ch) != "Cn":
                assert bool(here.match(ch)) == bool(there.encode_ordinary(ch)), hex(cp)


def test_query_rows(spark, tik):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(ODD)] + [(99, None, "x", 1), (99, None, "x", 1), (None, "a b", "x", 1)],
                                 "doc_id long, text string, ids string, n_tokens int")
    out = encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    rows = out.collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        text = "a b" if r.doc_id is None else "" if r.doc_id == 99 else ODD[r.doc_id]
        want = tik.encode_ordinary(text)
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = {r.doc_id: r.text for r in decode_documents(out, RANKS).collect()}
    assert back[7] == ODD[7] and back[99] == ""
    assert encode_documents(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
