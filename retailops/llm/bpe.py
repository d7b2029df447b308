"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Method.  The distinct pre-tokens of a block of documents form the corpus of a replay: an inverted index holds, for
each rank, the positions whose token pair merges into it.  Ranks are taken in order; one step applies a merge at all
its positions at once and looks up only the pairs of the touched neighbours, which enter the index under their own
ranks.  Merges never cross pre-tokens, so replaying block by block gives the same ids as one replay of everything,
while a task's memory stays bounded by its block and a lost executor costs one task.

Spark reads, splits and schedules the documents; each task runs the replay over Arrow batches.  Nothing is shuffled.
The rank file is a parameter; its content is bounded by the vocabulary (checked) and travels with the function.

Defined results: NULL text is an empty text; an empty text has no ids and decodes to no bytes; repeated rows each give
a row; an empty table gives an empty table; columns other than the id and the text are not read, so their names cannot
clash.
"""

from __future__ import annotations

import base64
import heapq
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks, text_or_empty
from .pretokens import PATTERN, PairTable, Pieces, ragged, sums, words_of

MAX_RANK_FILE = 32 << 20
BLOCK = 5 << 20


def read_ranks(path: str) -> bytes:
    """Content of a rank file, refused beyond ``MAX_RANK_FILE`` because it is sent to every task."""
    data = Path(path).read_bytes()
    if len(data) > MAX_RANK_FILE:
        raise ValueError(f"{path}: {len(data)} bytes; a rank file may have {MAX_RANK_FILE}")
    return data


class Codec:
    """Ranks, the pair table derived from them, the replay and the decoder."""

    def __init__(self, content: bytes, pattern: str = PATTERN):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in content.splitlines() if x)}
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for t, r in ranks.items():
            tokens[r] = t
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        splits = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t))
                  if t[:i] in ranks and t[i:] in ranks]
        left, right, merged = np.array(splits, np.int64).reshape(-1, 3).T
        self.pairs = PairTable(left, right, merged)
        self.starts, self.lens, self.flat = [], [], []
        self.n_flat = 0
        self.pieces = Pieces(self._add, self._reset)

    # -- replay --------------------------------------------------------------------------------------------------
    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each word)."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        if not n:
            return np.empty(0, np.int32), lens
        tok = np.append(self.byte_id[data], -1).astype(np.int64)
        word = np.repeat(np.arange(len(words)), lens)
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)  # n stands for "no neighbour"
        last = np.flatnonzero(np.append(word[1:] != word[:-1], True))
        nxt[last], nxt[n] = n, n
        prv[0], prv[last[:-1] + 1], prv[n] = n, n, n
        alive, chosen = np.ones(n + 1, bool), np.zeros(n + 1, bool)
        chosen[n] = True
        rank = np.full(n + 1, -1, np.int64)
        inner = np.flatnonzero(nxt[:n] < n)
        rank[inner] = self.pairs.get(tok[inner], tok[nxt[inner]])
        index: dict[int, list[np.ndarray]] = {}  # rank -> positions of its pairs
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            at = at[rank[at] >= 0]
            if not len(at):
                return
            r = rank[at]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for key, part in zip(r[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts)):
                if key in index:
                    index[key].append(part)
                else:
                    index[key] = [part]
                    heapq.heappush(heap, key)

        enter(inner)
        early: list[np.ndarray] = []  # words in which a merge made a pair of a lower rank
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                at = np.sort(at)
                at = at[np.append(True, at[1:] != at[:-1])]
                chained = np.append(False, nxt[at[:-1]] == at[1:])
                if chained.any():  # overlapping pairs: from the left, every other one
                    start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - start) % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            tok[at], alive[gone], rank[gone] = r, False, -1
            nxt[at] = after
            prv[after] = at
            prv[n] = n
            chosen[at] = True
            before = prv[at]
            touched = np.concatenate((at, before[~chosen[before]]))
            chosen[at] = False
            right = nxt[touched]
            rank[touched] = np.where(right < n, self.pairs.get(tok[touched], tok[right]), -1)
            lower = touched[(rank[touched] >= 0) & (rank[touched] < r)]
            if len(lower):
                early.append(word[lower])
            enter(touched)
        keep = np.flatnonzero(alive[:n])
        ids, counts = tok[keep].astype(np.int32), np.bincount(word[keep], minlength=len(words))
        if early:
            ids, counts = self._redo(words, ids, counts, np.unique(np.concatenate(early)))
        return ids, counts

    def _redo(self, words, ids, counts, which):
        """Words whose merges do not rise in rank are encoded one merge at a time, leftmost lowest rank first."""
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for w in which.tolist():
            seq = [words[w][i:i + 1] for i in range(len(words[w]))]
            while len(seq) > 1:
                best = min(range(len(seq) - 1), key=lambda i: self.ranks.get(seq[i] + seq[i + 1], 1 << 60))
                if seq[best] + seq[best + 1] not in self.ranks:
                    break
                seq[best:best + 2] = [seq[best] + seq[best + 1]]
            parts[w] = np.array([self.ranks[s] for s in seq], np.int32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    # -- blocks --------------------------------------------------------------------------------------------------
    def _reset(self) -> None:
        self.starts, self.lens, self.flat, self.n_flat = [], [], [], 0

    def _add(self, pieces: list[str]) -> None:
        words, seq, counts = words_of(pieces, self.pattern)
        ids, n = self.replay(words)
        starts = np.cumsum(n) - n
        flat = ids[ragged(starts[seq], n[seq])]
        lens = sums(n[seq], counts)
        self.starts.append(np.cumsum(lens) - lens + self.n_flat)
        self.lens.append(lens)
        self.flat.append(flat)
        self.n_flat += len(flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        at, counts = self.pieces.map(texts)
        self.starts, self.lens, self.flat = ([np.concatenate(x)] for x in (self.starts, self.lens, self.flat))
        starts, lens = self.starts[0][at], self.lens[0][at]
        return self.flat[0][ragged(starts, lens)], sums(lens, counts)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all sequences one after another, number of bytes of each sequence)."""
        lens = self.token_len[ids]
        return self.token_bytes[ragged(self.token_at[ids], lens)], sums(lens, counts)


_CODECS: dict[tuple[int, str], Codec] = {}


def codec(content: bytes, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    key = (hash(content), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(content, pattern)
    return _CODECS[key]


def _offsets(counts: np.ndarray, kind) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(counts))), kind)


def encode(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text",
           pattern: str = PATTERN, decoded: bool = False) -> DataFrame:
    """(id, ``token_ids`` array<int>) per document; with ``decoded`` also the ids decoded again, as ``decoded``."""
    content = read_ranks(rank_file)

    def run(batches):
        c = codec(content, pattern)
        for batch in batches:
            for start, stop, texts in text_blocks(batch, 1, BLOCK):
                ids, n = c.encode(texts)
                cols = [batch.column(0).slice(start, stop - start),
                        pa.ListArray.from_arrays(_offsets(n, pa.int32()), pa.array(ids, pa.int32()))]
                if decoded:
                    data, size = c.decode(ids, n)
                    cols.append(pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(
                        np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.py_buffer(data)]))
                yield pa.RecordBatch.from_arrays(cols, ["id", "token_ids", "decoded"][:len(cols)])

    df = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    schema = f"id {df.schema['id'].dataType.simpleString()}, token_ids array<int>" + ", decoded binary" * decoded
    return df.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, rank_file: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(id, ``decoded`` binary) per row of token ids; NULL ids decode to no bytes."""
    content = read_ranks(rank_file)

    def run(batches):
        c = codec(content, PATTERN)
        for batch in batches:
            lists = batch.column(1)
            n = np.diff(lists.offsets.to_numpy())
            data, size = c.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(
                pa.binary(), len(size), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int32)),
                                         pa.py_buffer(data)])], ["id", "decoded"])

    df = tokens.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, decoded binary") \
        .withColumnRenamed("id", id_col)


def digest(docs: DataFrame, rank_file: str) -> DataFrame:
    """Round trip of every document: token count, digest of the ids, digest of the bytes they decode to."""
    both = encode(docs, rank_file, decoded=True)
    return both.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
