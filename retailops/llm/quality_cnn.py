"""Quality classifier: a byte-level convolutional network in numpy.

Method.  A text is its UTF-8 bytes, in overlapping chunks of ``2 * HOP`` bytes every ``HOP`` bytes, which cover all of it.
Learned filters (one weight per offset, byte and filter) slide over each chunk and are max-pooled; the chunk vectors are
averaged and maximised over the document, and one logistic unit combines both into a probability.

Training.  Labels come only from rows that are not held out, at most ``sample`` rows of each label (those with the
smallest hash of doc_id) with whole texts, and of those only as many as hold ``MAX_BYTES`` together, so what reaches the
driver has a fixed bound.  Gradients go through the pooling to the windows that won.  Nothing but the text is an input of
the score.

Scoring.  Each task scores whole texts in blocks; the model is about 140 kB.  Nothing is shuffled.

Defined results: NULL and empty texts are one blank chunk and get that score; a NULL doc_id is held out (its text is taken
as empty); without labels of both kinds the score is their share, or 0.5; repeated rows each give a row; one id with several
labels or texts is trained with the least label and its least text; a text longer than a block is a block of its own; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_blocks, text_or_empty

HOP, WIDTH, STRIDE, FILTERS = 128, 8, 2, 16
MAX_BYTES = 32 << 20  # of all training texts together: they stand in the driver
STEP_BYTES = 1 << 20  # of texts whose gradients are taken at once
PER_HOP = HOP // STRIDE


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each after ``WIDTH`` zeros and padded to whole hops, and the hops of each.

    A window that reaches over the end of a text sees only zeros, so a score does not depend on the texts beside it.
    """
    hops = np.array([-(-(WIDTH + len(t)) // HOP) for t in texts], np.int64)
    data = b"".join((b"\0" * WIDTH + t).ljust(int(h) * HOP, b"\0") for t, h in zip(texts, hops))
    return np.frombuffer(data + b"\0" * WIDTH, np.uint8), hops


class Network:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.filters = rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)
        self.constant: float | None = None

    def responses(self, data: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Filter responses at every ``STRIDE``-th byte of data[start:stop]."""
        y = self.filters[0].take(data[start:stop:STRIDE], axis=0)
        for k in range(1, WIDTH):
            y += self.filters[k].take(data[start + k:stop + k:STRIDE], axis=0)
        return y

    def hop_max(self, data: np.ndarray, hops: int) -> np.ndarray:
        """Largest response of each filter in each hop."""
        out, step = np.empty((hops, FILTERS), np.float32), 512
        for i in range(0, hops, step):
            n = min(step, hops - i)
            y = self.responses(data, i * HOP, (i + n) * HOP).reshape(n, PER_HOP * FILTERS)
            while y.shape[1] > FILTERS:  # halves of a hop against each other
                half = y.shape[1] // 2
                y = np.maximum(y[:, :half], y[:, half:])
            out[i:i + n] = y
        return out

    def pooled(self, top: np.ndarray, hops: np.ndarray):
        """Chunk vectors and the document vector [mean, max] of each text, from the hop maxima."""
        first = np.cumsum(hops) - hops
        last = np.zeros(len(top), bool)
        last[first + hops - 1] = True
        chunk = top.copy()  # a chunk is a hop and the next one of the same text
        both = np.flatnonzero(~last)
        chunk[both] = np.maximum(top[both], top[both + 1])
        act = np.maximum(chunk + self.bias, 0)
        return chunk, np.hstack((np.add.reduceat(act, first) / hops[:, None], np.maximum.reduceat(act, first)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        data, hops = layout([t or b" " for t in texts])
        doc = self.pooled(self.hop_max(data, int(hops.sum())), hops)[1]
        return 1 / (1 + np.exp(-(doc @ self.out + self.shift).astype(np.float64)))

    def train(self, texts: list[bytes], labels: np.ndarray, epochs: int = 10, batch: int = 128, rate: float = 0.01,
              seed: int = 2) -> "Network":
        """Adam on the cross-entropy with both labels weighted alike."""
        share = float(labels.mean()) if len(labels) else 0.5
        if share in (0.0, 1.0) or not len(labels):
            self.constant = share
            return self
        rng = np.random.default_rng(seed)
        params = [self.filters, self.bias, self.out, self.shift]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        steps = epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                which, t = order[i:i + batch], t + 1
                grads = self.mean_gradients([texts[j] for j in which], labels[which], share)
                for p, g, a, b in zip(params, grads, m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (1 - t / (steps + 1)) * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.999 ** t)) + 1e-8)
        return self

    def mean_gradients(self, texts: list[bytes], labels: np.ndarray, share: float):
        """``gradients`` of a batch, taken over parts of ``STEP_BYTES`` of text, so that long texts need no more memory."""
        total, at = None, 0
        while at < len(texts):
            stop, size = at + 1, len(texts[at])
            while stop < len(texts) and size + len(texts[stop]) <= STEP_BYTES:
                size += len(texts[stop])
                stop += 1
            part = [g * np.float32((stop - at) / len(texts)) for g in self.gradients(texts[at:stop], labels[at:stop], share)]
            total, at = part if total is None else [a + b for a, b in zip(total, part)], stop
        return total

    def gradients(self, texts: list[bytes], labels: np.ndarray, share: float):
        data, hops = layout([x or b" " for x in texts])
        n = int(hops.sum())
        y = self.responses(data, 0, n * HOP).reshape(n, PER_HOP, FILTERS)
        arg = y.argmax(axis=1)
        top = np.take_along_axis(y, arg[:, None], 1)[:, 0]
        chunk, doc = self.pooled(top, hops)
        p = 1 / (1 + np.exp(-(doc @ self.out + self.shift)))
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        d = ((p - labels) * weight / len(labels)).astype(np.float32)
        ddoc = d[:, None] * self.out
        first, owner = np.cumsum(hops) - hops, np.repeat(np.arange(len(hops)), hops)
        act = np.maximum(chunk + self.bias, 0)
        dact = (ddoc[:, :FILTERS] / hops[:, None])[owner]
        best = (np.maximum.reduceat(act, first)[owner] == act).astype(np.float32)
        best /= np.add.reduceat(best, first)[owner]  # equal maxima share
        dact = (dact + best * ddoc[owner, FILTERS:]) * (chunk + self.bias > 0)
        # the hop that won in each chunk, and the window that won in it
        hop = np.repeat(np.arange(n)[:, None], FILTERS, axis=1)
        nxt = np.minimum(hop + 1, n - 1)
        hop = np.where(np.take_along_axis(top, hop, 0) == chunk, hop, nxt)
        place = hop * HOP + np.take_along_axis(arg, hop, 0) * STRIDE
        f = np.broadcast_to(np.arange(FILTERS), place.shape)
        g = np.empty_like(self.filters)
        for k in range(WIDTH):
            at = data[place + k].astype(np.int64) * FILTERS + f
            g[k] = np.bincount(at.ravel(), weights=dact.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
        return g + 1e-5 * self.filters, dact.sum(axis=0), doc.T @ d + 1e-4 * self.out, np.array([d.sum()], np.float32)


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int, folds: int, fold: int) -> DataFrame:
    """(id, text, y): at most ``sample`` ids of each label that are not held out, those with the smallest hash of the id, one row each.

    An id with several labels has the least of them, and one with several texts the least in byte order, so a repeated run
    trains on the same rows.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, fold))
    known = known.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id", F.lit("sample")), "doc_id"]
    chosen = known.filter("y = 0").orderBy(*order).limit(sample).union(known.filter("y = 1").orderBy(*order).limit(sample))
    chosen = F.broadcast(chosen)  # at most 2 * sample ids
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(chosen, "doc_id")
    return rows.groupBy(F.col("doc_id").alias("id")).agg(F.min("text").alias("text"), F.min("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, max_bytes: int | None = None) -> Network:
    """Trained on whole texts: at most ``sample`` rows of each label and ``max_bytes`` of text in all, by the hash of the id."""
    rows = labelled_sample(docs, labels, "quality", sample, 5, 0).withColumn("size", F.octet_length("text").cast("long"))
    order = Window.orderBy(F.xxhash64("id", F.lit("sample")), "id")  # at most 2 * sample rows
    rows = rows.withColumn("held", F.sum("size").over(order)).filter(F.col("held") <= (max_bytes or MAX_BYTES)).select("id", "text", "y").collect()
    rows.sort(key=lambda r: r["id"])
    return Network().train([r["text"].encode("utf-8", "surrogatepass") for r in rows], np.array([r["y"] for r in rows], np.float32))


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per document."""

    def run(batches):
        for batch in batches:
            for start, stop, texts in text_blocks(batch, 1, 2 << 20):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start),
                     pa.array(network.score([t.encode("utf-8", "surrogatepass") for t in texts]))], ["id", "score"])

    df = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def report(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    return score(docs, fit(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``cut``; scored in place, so no row has to be found again."""
    network = fit(docs, labels)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for start, stop, texts in text_blocks(batch, at, 2 << 20):
                good = network.score([t.encode("utf-8", "surrogatepass") for t in texts]) >= cut
                yield batch.slice(start, stop - start).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
