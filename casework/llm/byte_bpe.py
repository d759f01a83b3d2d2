"""Byte-level BPE encoding and decoding with a sentencepiece model that is
written directly from a rank file.

Each vocabulary entry becomes a piece over 256 printable stand-ins for bytes,
scored by its negative rank, so sentencepiece merges the pair of lowest rank
first; the normaliser is the identity. Text is cut into pre-tokens by the
pattern, each pre-token is encoded by itself, and decoding joins the bytes
that the ids stand for.

Nulls and empty texts give no ids. Texts of any length are encoded whole.
Repeated rows give repeated results; an empty table gives an empty result.
Columns other than the id and the text are not read, so names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from casework.llm.common import id_and_text, in_parts
from casework.llm.segments import PieceEncoder, blocks

#: Characters encoded in one call.
BLOCK_CHARS = 2_000_000


def read_ranks(path: str) -> list[bytes]:
    """The token bytes in rank order."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it prints, else one
    from 256 upwards, in order."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model: piece 0 is the unknown piece that
    the format asks for, piece r + 1 is the token of rank r."""
    letters = byte_letters()
    piece = lambda text, score, kind: _bytes(1, _bytes(1, text) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))
    pieces = [piece(b"<unk>", 0.0, 2)]
    pieces += [piece("".join(letters[b] for b in t).encode(), -float(rank), 1) for rank, t in enumerate(tokens)]
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, 0) + b"".join(_number(i, -1) for i in (41, 42, 43))
    normaliser = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, normaliser)


class PreTokens:
    """Cuts text by the pattern as the rank files' library does.

    The two libraries hold different Unicode versions. Code points that Python's own
    tables do not know are classed by the library itself and stand in as a
    common letter, digit or symbol while the text is cut.
    """

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).finditer
        self.findall = regex.compile(pattern).findall
        self.young = regex.compile(r"[\p{L}\p{N}]")
        self.stands: dict[str, str] = {}
        self.kinds = None

    def _stand(self, ch: str) -> str:
        if unicodedata.category(ch) != "Cn":
            return ch
        if self.kinds is None:
            import tiktoken

            ranks = {bytes([i]): i for i in range(256)}
            self.kinds = [(tiktoken.Encoding("kind", pat_str=rf"\p{{{k}}}", mergeable_ranks=ranks, special_tokens={}), stand)
                          for k, stand in (("L", "a"), ("N", "1"))]
        return next((stand for kind, stand in self.kinds if kind.encode_ordinary(ch)), "!")

    def __call__(self, text: str) -> list[str]:
        if not text.isascii():
            for ch in set(text):
                if ch not in self.stands:
                    self.stands[ch] = self._stand(ch)
            odd = {ord(ch): self.stands[ch] for ch in set(text) if self.stands[ch] != ch}
            if odd:
                return [text[m.start():m.end()] for m in self.find(text.translate(odd))]
        return self.findall(text)


class ByteBPE:
    """Encoder and decoder over one vocabulary, for one Python worker."""

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str):
        import sentencepiece

        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = PreTokens(pattern)
        self.letters = {i: ch for i, ch in enumerate(byte_letters())}
        self.pieces = PieceEncoder(self._encode, np.array([len(t) for t in tokens] or [0]))

    def _encode(self, text: str) -> list[int]:
        words = [w.encode() for w in self.cut(text)]
        ids = [self.rank.get(w) for w in words]
        unknown = [w for w, i in zip(words, ids) if i is None]
        spelt = iter(self.sp.encode([w.decode("latin-1").translate(self.letters) for w in unknown], num_threads=1)) if unknown else iter(())
        out: list[int] = []
        for i in ids:
            if i is None:
                out += [x - 1 for x in next(spelt)]
            else:
                out.append(i)
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        return self.pieces.many(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_ENCODERS: dict[int, ByteBPE] = {}


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row and, with
    ``with_ids``, the ids as an array. One narrow stage; the vocabulary is the only
    thing broadcast, and its size is fixed by the rank file."""
    tokens = read_ranks(rank_file)
    shared = docs.sparkSession.sparkContext.broadcast((tokens, sentencepiece_model(tokens)))
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64()),
              pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    fields += [pa.field("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash((rank_file, pattern))
        if key not in _ENCODERS:
            _ENCODERS[key] = ByteBPE(*shared.value, pattern)
        bpe = _ENCODERS[key]
        for batch in in_parts(batches):
            ids_in, texts = batch.column(0), batch.column(1).to_pylist()
            for begin, end in blocks(texts, BLOCK_CHARS):
                coded = bpe.encode_many(texts[begin:end])
                columns = [ids_in.slice(begin, end - begin),
                           pa.array([len(c) // 4 for c in coded], pa.int64()),
                           pa.array([hashlib.sha256(c).hexdigest() for c in coded]),
                           pa.array([hashlib.sha256(bpe.decode(c)).hexdigest() for c in coded])]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(c, dtype="<i4") for c in coded], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    sql = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return id_and_text(docs, id_col, text_col).mapInArrow(run, sql)


def decode_documents(encoded: DataFrame, rank_file: str) -> DataFrame:
    """doc_id, text of the ids of :func:`encode_documents` (null ids: empty)."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(rank_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"".join(shared.value[i] for i in ids or ()).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
