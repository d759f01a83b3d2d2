"""Token ids of whole texts by a byte-level BPE tokenizer file."""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np

from casework.llm.byte_bpe import byte_letters
from casework.llm.segments import PieceEncoder


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


class TokenIds:
    """Ids as the tokenizers library gives them for a byte-level BPE file,
    without special tokens of its own. A text that holds the string of an added
    token goes to the library as a whole, which gives the token's id for it.

    The merges of unknown words run in tiktoken over the same vocabulary, which is four
    times as fast (a byte-level BPE file's ids are its merge ranks; the tests
    hold all entries against the tokenizers library). A text with code points
    that Unicode assigned lately goes to the tokenizers library as a whole,
    since the two may class them differently.
    """

    def __init__(self, source: str, pattern: str):
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        model = json.loads(source)["model"]
        back = {ord(ch): b for b, ch in enumerate(byte_letters())}
        self.added = special = {t["content"] for t in json.loads(source).get("added_tokens", [])}
        ranks = {bytes(back[ord(c)] for c in token): i for token, i in model["vocab"].items() if token not in special}
        widths = np.ones(max(model["vocab"].values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            widths[i] = len(token)
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.source, self.whole = source, None
        self.pieces = PieceEncoder(self.fast.encode_ordinary, widths)
        self.young: dict[str, bool] = {}

    def _young(self, text: str) -> bool:
        if text.isascii():
            return False
        letters = set(text)
        for ch in letters - self.young.keys():
            self.young[ch] = unicodedata.category(ch) == "Cn"
        return any(map(self.young.__getitem__, letters))

    def _by_library(self, text: str) -> bytes:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_str(self.source)
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def many(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        young = [self._young(t) or any(a in t for a in self.added) for t in texts]
        ids = self.pieces.many(["" if y else t for t, y in zip(texts, young)])
        return [self._by_library(t) if y else i for t, i, y in zip(texts, ids, young)]


_OPEN: dict[int, TokenIds] = {}


def opened(source: str, pattern: str) -> TokenIds:
    """One per Python worker and file."""
    key = hash((source, pattern))
    if key not in _OPEN:
        _OPEN[key] = TokenIds(source, pattern)
    return _OPEN[key]
