"""Splitting texts into pre-tokens, with the work done once per distinct piece.

A text is cut at single spaces that stand between two characters that are not white space.  No match of the
byte-level pattern crosses such a space (a match holds a space only at its start, or as part of a run of white
space), so each piece, with its leading space, can be matched on its own, and equal pieces share one result.
"""

from __future__ import annotations

import gc
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np

#: The public byte-level split pattern (fixed value, as published with the rank files).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that the pattern's white-space class matches (fixed values).
_WHITE = frozenset(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
                             0x205F, 0x3000]))
_MARKS = frozenset(",.;:!?")


class Pieces:
    """Maps every piece of a block of texts to a small integer; ``add`` gets the literal strings of new pieces.

    The table is dropped when it exceeds ``limit`` pieces or ``limit_chars`` characters, so memory is bounded
    whatever the corpus holds; ``reset`` then clears the caller's side.
    """

    def __init__(self, add: Callable[[list[str]], None], reset: Callable[[], None],
                 limit: int = 250_000, limit_chars: int = 16_000_000):
        self.add, self.reset, self.limit, self.limit_chars = add, reset, limit, limit_chars
        self.ids: dict = {}
        self.unsafe: set[int] = set()
        self.chars = 0

    def _enter(self, new: set) -> None:
        literal = []
        n = len(self.ids)
        for k in new:
            if k.__class__ is str:  # a later piece: its space belongs to it
                if not k or k[0] in _WHITE or k[-1] in _WHITE:
                    self.unsafe.add(n)
                literal.append(" " + k)
            elif len(k) == 1:  # the first piece of a text
                if k[0] and k[0][-1] in _WHITE:
                    self.unsafe.add(n)
                literal.append(k[0])
            else:  # joined pieces, taken literally
                literal.append(k[1])
            self.ids[k] = n
            n += 1
        self.chars += sum(map(len, literal))
        self.add(literal)

    @staticmethod
    def _joined(parts: list) -> list:
        """Join what stands on either side of an unsafe space."""
        parts = [parts[0][0], *parts[1:]]
        groups = [[parts[0]]]
        for a, b in zip(parts, parts[1:]):
            if a and b and a[-1] not in _WHITE and b[0] not in _WHITE:
                groups.append([b])
            else:
                groups[-1].append(b)
        out: list = [("raw", " ".join(groups[0]))]
        out += [g[0] if len(g) == 1 else ("raw", " " + " ".join(g)) for g in groups[1:]]
        return out

    def map(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(piece number of each piece, number of pieces of each text)."""
        gc.disable()  # millions of short strings without cycles; scanning them again and again is most of the cost
        try:
            return self._map(texts)
        finally:
            gc.enable()

    def _map(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.ids) > self.limit or self.chars > self.limit_chars:
            self.ids, self.unsafe, self.chars = {}, set(), 0
            self.reset()
        docs = []
        for t in texts:
            p: list = t.split(" ")
            p[0] = (p[0],)
            docs.append(p)
        at, counts = self._numbers(docs)
        if self.unsafe:
            odd = np.zeros(len(self.ids), bool)
            odd[list(self.unsafe)] = True
            doc_of = np.repeat(np.arange(len(docs)), counts)
            for d in np.unique(doc_of[odd[at]]):
                docs[d] = self._joined(docs[d])
            at, counts = self._numbers(docs)
        return at, counts

    def _numbers(self, docs: list[list]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.fromiter(map(len, docs), np.int64, len(docs))
        flat = list(chain.from_iterable(docs))
        at = np.fromiter(map(self.ids.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            missed = [flat[i] for i in missing.tolist()]
            self._enter(set(missed))
            at[missing] = np.fromiter(map(self.ids.__getitem__, missed), np.int64, len(missed))
        return at, counts


def words_of(pieces: list[str], pattern) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct pre-tokens (UTF-8) of the pieces, the pre-token number of each match, matches per piece.

    A space and letters, or that and one plain punctuation mark, need no matching: they are one or two pre-tokens.
    """
    found: list = []
    for p in pieces:
        w = p[1:]
        if w.isalpha() and p[0] == " ":
            found.append((p,))
        elif p[-1:] in _MARKS and p[0] == " " and w[:-1].isalpha():
            found.append((p[:-1], p[-1]))
        else:
            found.append(pattern.findall(p))
    counts = np.fromiter(map(len, found), np.int64, len(found))
    flat = list(chain.from_iterable(found))
    numbers = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    seq = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
    return [w.encode("utf-8", "surrogatepass") for w in numbers], seq, counts


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Flat positions start .. start+len-1 of each range, one after another."""
    total = int(lens.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total) + np.repeat(starts - (ends - lens), lens)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each group of ``counts`` consecutive values."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


class PairTable:
    """Vectorised lookup of (left, right) -> value by open addressing; -1 where there is none."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        bits = max(10, int(np.ceil(np.log2(max(len(value), 1) * 4))))
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)
        keys = (left.astype(np.int64) << 32) | right
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):  # one new key per free slot and round, the others move on
            s = slot[todo]
            free = self.keys[s] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(s, return_index=True)[1]] = True
            put = todo[free & first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], value[put]
            todo = todo[~(free & first)]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out
