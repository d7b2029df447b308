"""Token counts by rank-synchronous array merging.

Method.  The distinct pre-tokens of a block are held as one ragged numpy array of symbols.  In each round every
sequence finds the lowest rank among its adjacent pairs and all sequences apply theirs at the same time; the arrays
are compacted, sequences without a pair leave, and the symbols that survive are counted.  A document's count is the
sum over its pre-tokens.  Nothing is shuffled; a task's memory is bounded by its block and its piece table.

Defined results: NULL text is empty and has 0 tokens; strings of special tokens inside a text count as one token each,
as the library does by default; repeated rows each give a row; other columns are not read.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks, text_or_empty
from .pretokens import PATTERN, PairTable, Pieces, sums, words_of

MAX_FILE = 32 << 20
BLOCK = 8 << 20
WORDS = 100_000  # pre-tokens merged together


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Counter:
    def __init__(self, content: bytes):
        spec = json.loads(content)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without normalizer and prefix space is needed")
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, out = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64).reshape(-1, 3).T
        made = np.full(max(vocab.values()) + 1, -1, np.int64)
        made[out] = np.arange(len(out))
        #: A pair never ranks below a merge that made one of its parts, so equal pairs may merge together.
        self.rising = len(np.unique(out)) == len(out) and bool(
            ((made[left] < np.arange(len(out))) & (made[right] < np.arange(len(out)))).all())
        self.pairs, self.out = PairTable(left, right, np.arange(len(out))), out
        symbols = byte_symbols()
        self.byte_id = np.array([vocab[symbols[b]] for b in range(256)], np.int64)
        self.pattern = regex.compile(PATTERN)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.strings = special
        self.counts = np.empty(0, np.int64)
        self.pieces = Pieces(self._add, self._reset)

    def merged(self, words: list[bytes]) -> np.ndarray:
        """Number of symbols that survive in each word."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        result = lens.copy()
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lens)
        none = len(self.out)

        def ranks(s, w):
            r = np.full(len(s), none, np.int64)
            inside = np.flatnonzero(w[1:] == w[:-1])
            got = self.pairs.get(s[inside], s[inside + 1])
            r[inside] = np.where(got < 0, none, got)
            return r

        rank = ranks(sym, word)
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(first, len(word)))
            best = np.minimum.reduceat(rank, first)
            done = best == none
            if done.any():  # these sequences are final
                result[word[first[done]]] = size[done]
                stay = np.repeat(~done, size)
                sym, word, rank, best, size = sym[stay], word[stay], rank[stay], best[~done], size[~done]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            if self.rising:
                chained = np.append(False, np.diff(at) == 1)
                if chained.any():  # overlapping equal pairs: from the left, every other one
                    start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - start) % 2 == 0]
            else:
                at = at[np.unique(word[at], return_index=True)[1]]
            sym[at] = self.out[rank[at]]
            stale = np.zeros(len(sym), bool)
            stale[at] = True
            stale[at[at > 0] - 1] = True
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word, rank, stale = sym[keep], word[keep], rank[keep], np.flatnonzero(stale[keep])
            right = np.minimum(stale + 1, len(sym) - 1)
            inside = (word[right] == word[stale]) & (right > stale)
            got = self.pairs.get(sym[stale], sym[right])
            rank[stale] = np.where(inside & (got >= 0), got, none)
        return result

    def _reset(self) -> None:
        self.counts = np.empty(0, np.int64)

    def _add(self, pieces: list[str]) -> None:
        words, seq, n = words_of(pieces, self.pattern)
        parts = [self.merged(words[i:i + WORDS]) for i in range(0, len(words), WORDS)]
        per_word = np.concatenate(parts) if parts else np.empty(0, np.int64)
        self.counts = np.concatenate((self.counts, sums(per_word[seq], n)))

    def count(self, texts: list[str]) -> np.ndarray:
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if self.special and any(s in t for s in self.strings):
                cut = self.special.split(t)
                extra[i] = len(cut) - 1
                parts += cut
                owner += [i] * len(cut)
            else:
                parts.append(t)
                owner.append(i)
        at, n = self.pieces.map(parts)
        return extra + np.bincount(owner, weights=sums(self.counts[at], n), minlength=len(texts)).astype(np.int64)


_COUNTERS: dict[int, Counter] = {}


def counter(content: bytes) -> Counter:
    key = hash(content)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(content)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per document; ``limit`` only sets the flag, every token is counted."""
    content = Path(tokenizer_file).read_bytes()
    if len(content) > MAX_FILE:
        raise ValueError(f"{tokenizer_file}: {len(content)} bytes; a tokenizer file may have {MAX_FILE}")

    def run(batches):
        c = counter(content)
        for batch in batches:
            for start, stop, texts in text_blocks(batch, 1, BLOCK):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, stop - start), batch.column(2).slice(start, stop - start),
                    pa.array(c.count(texts), pa.int64())], ["id", "n_bytes", "n_tokens"])

    text = text_or_empty(text_col)
    df = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
