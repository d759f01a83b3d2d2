"""Cutting text where no pre-token can span, and remembering encoded pieces.

In the byte-level BPE pattern only white space and the optional space before a
word join two characters of different classes, so a space that is followed by
anything but white space always starts a pre-token. Text cut before those
spaces can be encoded piece by piece; most pieces are words seen before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import regex

#: Spaces that do not start a pre-token: those before more white space.
_INNER = [" " + ch for ch in "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
          "\u2028\u2029\u202f\u205f\u3000"]
_CUT = regex.compile(r" (?=\S)")
#: Longer pieces are encoded each time rather than remembered.
LONGEST_KEPT = 48
#: Pieces remembered in each of the two generations.
REMEMBERED = 150_000


def cut(text: str) -> list[str]:
    """Pieces of ``text``: the first with a space put before it, the others
    without the space that they start with (so the two kinds never clash)."""
    plain = text[-1:] != " " and not any(map(text.__contains__, _INNER))
    pieces = text.split(" ") if plain else _CUT.split(text)
    pieces[0] = " " + pieces[0]
    return pieces


class PieceEncoder:
    """Encodes texts through ``encode(text) -> ids``.

    ``widths[id]`` is the byte length of an id; it tells where a piece's ids
    end when many pieces are encoded in one call.
    """

    def __init__(self, encode: Callable[[str], list[int]], widths: np.ndarray):
        self.encode = encode
        self.widths = widths
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return self.many([text])[0]

    def many(self, texts: Iterable[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cuts = [cut(t) for t in texts]
        unknown = set().union(*cuts)
        unknown.difference_update(self.new)
        found = {p: self.old[p] for p in unknown if p in self.old}
        unknown.difference_update(found)
        found |= self._encode(unknown)
        self.new |= found
        out = [b"".join(map(self.new.__getitem__, c)) for c in cuts]
        for p in found:
            if len(p) > LONGEST_KEPT:
                del self.new[p]
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        return out

    def forget(self) -> None:
        """Free what is remembered; the next texts are learned anew."""
        self.new, self.old = {}, {}

    def _encode(self, pieces: set[str]) -> dict[str, bytes]:
        out = {p: _packed(self.encode(p[1:])) for p in pieces if p[0] == " "}
        spaced = [p for p in pieces if p[0] != " "]
        if not spaced:
            return out
        ids = np.asarray(self.encode(" " + " ".join(spaced)), dtype="<u4")
        ends = np.cumsum([len(p.encode()) + 1 for p in spaced])
        at = np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1
        raw, begin = ids.tobytes(), 0
        for p, end in zip(spaced, (at * 4).tolist()):
            out[p] = raw[begin:end]
            begin = end
        return out


def _packed(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def blocks(items: list[str], size: int) -> Iterable[tuple[int, int]]:
    """Ranges of ``items`` with about ``size`` characters each."""
    begin, held = 0, 0
    for i, x in enumerate(items):
        held += len(x)
        if held >= size:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(items):
        yield begin, len(items)
