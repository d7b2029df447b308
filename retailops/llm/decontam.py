"""Benchmark decontamination by q-gram filtering and banded alignment.

Method.  Texts and benchmark items are folded (lower case, runs of ASCII characters that are not letters or digits become
one space) and taken as UTF-8 bytes.  An item of m bytes may be found with up to k = ``rate`` * m edits.  By the q-gram
lemma a place with at most k edits shares at least m - q + 1 - k * q of the item's q-grams with it, on diagonals at most k
apart.  Shared q-grams are counted in overlapping bands of diagonals (each band overlaps the next by half, so k + 1
neighbouring diagonals lie in one band); bands under the bound are dropped, and the others are verified by a banded
alignment of the whole item.  k is lowered where the bound would not be positive; items shorter than q must occur exactly.
A document may also hold only a part of an item, as when a line of it is gone: stretches of ``STRETCH`` bytes of each longer
item, one every ``STEP`` bytes, are looked for by the same bound and alignment, and an item is found if the stretches found in
the document cover at least ``PART`` of its bytes.  Items of at most ``STRETCH`` bytes have no stretches.

Scale.  Documents stay where they are: each task scans its texts in blocks against the items.  The benchmark travels in
blocks of at most ``ITEM_BYTES``; a larger benchmark takes one pass of the same scan per block.  Nothing is shuffled.

Defined results: NULL text is empty; items that fold to nothing are never found; equal items are all reported; a NULL item_id
is reported as -1; repeated rows each give a row; an empty table or benchmark gives no findings; extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_blocks
from .pretokens import ragged

Q, RATE = 12, 0.06
STRETCH, STEP, PART = 48, 12, 0.5
ITEM_BYTES = 4 << 20
BITS = 22
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def fold(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split())


def grams(data: bytes) -> np.ndarray:
    """A 64-bit hash of every q-gram."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    head = np.ndarray((n,), "<u8", data, 0, (1,))
    tail = np.ndarray((n,), "<u4", data, 8, (1,))
    h = head * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += tail
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def aligned(item: np.ndarray, window: np.ndarray, most: int) -> bool:
    """Whether some stretch of the window is at most ``most`` edits from the whole item."""
    m = len(item)
    width = len(window) - m + 2 * most + 1  # diagonals: start of the item from ``most`` before the window
    if width <= 0:
        return False
    text = np.concatenate((np.zeros(most, np.uint8), window, np.zeros(most + 1, np.uint8)))
    steps = np.arange(width)
    cost = np.zeros(width, np.int64)
    for i in range(m):
        new = cost + (text[i:i + width] != item[i])
        new[:-1] = np.minimum(new[:-1], cost[1:] + 1)  # the item's byte is missing in the text
        new = np.minimum.accumulate(new - steps) + steps  # the text has extra bytes
        if new.min() > most:
            return False
        cost = new
    return True


class Items:
    """Items to be found whole and, with ``part``, by stretches that cover this share of their bytes."""

    def __init__(self, rows: list[tuple[int, str | bytes]], rate: float = RATE, part: float | None = None):
        folded = [(i, f) for i, t in rows if (f := t if isinstance(t, bytes) else fold(t or ""))]
        self.part, self.places = part, []
        if part is not None:
            for n, (_, f) in enumerate(folded):
                if len(f) > STRETCH:
                    last = len(f) - STRETCH
                    self.places += [(n, p) for p in sorted({*range(0, last, STEP), last})]
            self.sizes = [(i, len(f)) for i, f in folded]
            self.stretches = Items([(j, folded[n][1][p:p + STRETCH]) for j, (n, p) in enumerate(self.places)], rate)
        self.short = [(i, f) for i, f in folded if len(f) < Q]
        self.long = [(i, f) for i, f in folded if len(f) >= Q]
        m = np.array([len(f) for _, f in self.long], np.int64)
        self.most = np.minimum((m * rate).astype(np.int64), (m - Q) // Q)
        self.bound = m - Q + 1 - self.most * Q
        per = [grams(f) for _, f in self.long]
        h = np.concatenate(per) if per else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(per)), [len(x) for x in per]) if per else np.empty(0, np.int64)
        place = np.concatenate([np.arange(len(x)) for x in per]) if per else np.empty(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.hash, self.start = np.unique(h[order], return_index=True)
        self.size = np.diff(np.append(self.start, len(h)))
        self.item, self.place = item[order], place[order]
        self.mark = np.zeros(1 << BITS, bool)
        self.mark[self.hash >> np.uint64(64 - BITS)] = True

    def find(self, texts: list[str]) -> list[list[int]]:
        """Item ids found in each text."""
        folded = [fold(t) for t in texts]
        found = self._find(folded)
        if self.places:
            found = [sorted({*whole, *self._covered(held)}) for whole, held in zip(found, self.stretches._find(folded))]
        return found

    def _covered(self, held: list[int]) -> list[int]:
        """Ids of the items of which the held stretches (in order of item and place) cover enough."""
        covered: dict[int, int] = {}
        reach: dict[int, int] = {}
        for n, p in (self.places[j] for j in held):
            covered[n] = covered.get(n, 0) + p + STRETCH - max(p, reach.get(n, 0))
            reach[n] = p + STRETCH
        return [self.sizes[n][0] for n, c in covered.items() if c >= self.part * self.sizes[n][1]]

    def _find(self, folded: list[bytes]) -> list[list[int]]:
        found: list[set[int]] = [{i for i, f in self.short if f in t} for t in folded]
        if len(self.hash):
            data = b"\0".join(folded)  # no item holds a zero byte, so nothing matches across texts
            ends = np.cumsum([len(t) + 1 for t in folded])
            h = grams(data)
            at = np.flatnonzero(self.mark[h >> np.uint64(64 - BITS)])
            slot = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
            same = self.hash[slot] == h[at]
            at, slot = at[same], slot[same]
            n = self.size[slot]
            post = ragged(self.start[slot], n)
            item, diagonal, doc = self.item[post], np.repeat(at, n) - self.place[post], np.repeat(
                np.searchsorted(ends, at, side="right"), n)
            step = self.most[item] + 1
            band = (diagonal + (1 << 40)) // step
            for shift in (0, 1):
                rows = np.stack((doc, item, band - shift), axis=1)
                order = np.lexsort(rows.T[::-1])
                rows = rows[order]
                cuts = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1))) if len(rows) else np.empty(0, int)
                counts = np.diff(np.append(cuts, len(rows)))
                keep = counts >= self.bound[rows[cuts, 1]] if len(cuts) else counts
                for d, i, b in rows[cuts[keep]].tolist() if len(cuts) else ():
                    if self.long[i][0] not in found[d] and self._verify(folded[d], int(ends[d]) - len(folded[d]) - 1, i, b):
                        found[d].add(self.long[i][0])
        return [sorted(f) for f in found]

    def _verify(self, text: bytes, offset: int, i: int, band: int) -> bool:
        item, k = self.long[i][1], int(self.most[i])
        low = band * (k + 1) - (1 << 40) - offset
        window = text[max(0, low - k):max(0, low + 2 * (k + 1) + len(item) + k)]
        return item in window or aligned(np.frombuffer(item, np.uint8), np.frombuffer(window, np.uint8), k)


def item_blocks(benchmark: DataFrame, limit: int | None = None):
    """The benchmark in lists of at most ``limit`` bytes of text (or one item)."""
    limit = limit or ITEM_BYTES
    rows, size = [], 0
    for r in benchmark.select(F.coalesce("item_id", F.lit(-1)).alias("i"), F.coalesce("text", F.lit("")).alias("t")) \
            .orderBy("i", "t").toLocalIterator():
        if rows and size + len(r["t"]) > limit:
            yield rows
            rows, size = [], 0
        rows.append((r["i"], r["t"]))
        size += len(r["t"])
    if rows:
        yield rows


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", found_col: str = "found_items",
         rate: float = RATE) -> DataFrame:
    """``docs`` with ``found_col`` (replaced if there is one): the sorted ids of the benchmark items in each text."""
    df = docs.withColumn(found_col, F.array().cast("array<long>"))
    schema = T.StructType([f for f in df.schema if f.name != found_col] + [T.StructField(found_col, T.ArrayType(T.LongType()))])
    df = df.select(*[F.col(f"`{f.name}`") for f in schema])
    for rows in item_blocks(benchmark):
        df = df.mapInArrow(_scan(rows, rate, text_col), schema)
    return df


def _scan(rows, rate, text_col):
    def run(batches):
        items = Items(rows, rate, PART)
        for batch in batches:
            at, last = batch.schema.get_field_index(text_col), batch.num_columns - 1
            for start, stop, texts in text_blocks(batch, at, 2 << 20):
                part = batch.slice(start, stop - start)
                got = [sorted({*a, *(b or ())}) for a, b in zip(items.find(texts), part.column(last).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array(got, pa.list_(pa.int64()))],
                                                 batch.schema.names)
    return run


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find(docs.select("doc_id", "text"), benchmark).select(
        "doc_id", F.size("found_items").cast("long").alias("n_items"), F.col("found_items").alias("item_ids"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found."""
    name = "found_items"
    while name in docs.columns:
        name += "_"
    return find(docs, benchmark, found_col=name).filter(F.size(name) == 0).drop(name)
