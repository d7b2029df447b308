"""Toxicity by nearest labelled examples.

Method.  Texts are TF-IDF vectors over all words and word beginnings of the examples; no term is dropped, and each is weighted
by how well it tells the labels apart (``tells`` of the chi-square on the examples).  IDF counts all documents.  The ``k`` nearest by
cosine are exact.  Terms that stand in more than ``DENSE`` of the examples are rows of a matrix, and one product scores a
batch of texts on them.  The other terms stand in an inverted index whose posting lists are cut into blocks of ``BLOCK``
examples, with the largest weight of the term in each.  Lists that have fewer than ``FEW`` examples in a block are added at once,
in rows of ``WIDTH`` examples: most counts in them are 1, so one weight stands for a list, and only larger counts are read besides.
What is added by then is a lower bound of each cosine, so its ``k``-th best is one of the ``k``-th best cosine; the block
maxima give the most that the other lists can add to the examples of a block, and only blocks that reach the bound are scored.
Their votes, weighted by the squared cosine and smoothed by the share of toxic examples, give the score; the nearest are
returned as evidence.  A text without any term of the examples stands with the examples that have none, and gets their
smoothed share of toxic ones.

Training.  At most ``sample`` rows of each label that are not held out; their terms and vectors reach the driver and the
tasks, bounded by the texts of the sample.  One more pass over all documents counts in how many of them each of these terms
stands; each task sends one count per term.

Scoring reads whole texts in each task; nothing is shuffled.  The distinct words of a batch of texts are looked up in one go, one sort
counts the terms of many texts, and a Python worker keeps the index from one task to the next.  The matrix has at most ``CELLS`` cells.

Defined results: NULL and empty texts have no words; a NULL doc_id is not held out (crc32 of nothing is 0); without labels
of both kinds the score is their share, or 0.5; equal cosines at rank ``k`` go to the smaller example number; repeated rows
each give a row; an empty table gives an empty table; one id with several labels or texts is trained with the least label
and its least text; a text longer than a batch is a batch of its own; other columns are not read.
"""

from __future__ import annotations

import math
import re
import sys
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks, text_or_empty
from .pretokens import ragged
from .quality_cnn import held_out, labelled_sample

WORD = re.compile(r"[^\W\d_]+")
BLOCK = 64
DENSE = 0.03  # share of the examples
CELLS = 6 << 20  # of the matrix at most: it holds the terms in most examples
ROWS = 256  # texts in one product
TEXT_BYTES = 8 << 20  # of texts that are looked up together
PART_CHARACTERS = 1 << 19  # of texts that are cut into words together
RUNS, RUN_WORDS = 256, 1 << 14  # texts, and about how many words, whose terms are counted together
WIDTH = 8  # postings in a row of the thin lists
FEW = 24  # examples that a list has in each of its blocks at least, if block maxima are to serve


STEMS = range(4, 9)
LEVELS = (2, 3, 5, 9)


def terms(text: str) -> list[str]:
    """Words of a lower-case text and, marked with a star, their beginnings: inflected and compound forms share them."""
    out = WORD.findall(text)
    return out + [w[:n] + "*" for w in out for n in STEMS if len(w) >= n]


def words(text: str) -> Counter:
    """Counts of the terms; a term that comes ``level`` times or more also counts as a term of its own, ``term#level``."""
    c = Counter(terms(text.lower()))
    return c + Counter({f"{w}#{x}": n - x + 1 for w, n in c.items() for x in LEVELS if n >= x})


@lru_cache(maxsize=1)
def word_characters() -> np.ndarray:
    """Whether each code point is one of ``WORD``."""
    out = np.zeros(sys.maxunicode + 1, bool)
    for found in WORD.finditer("".join(map(chr, range(len(out))))):
        out[found.start():found.end()] = True
    return out


def all_words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of lower-cased texts, one after another, as ``WORD.findall`` gives them, and how many each text has."""
    lower = [t.lower() for t in texts]
    points = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = word_characters()[points]  # a line feed ends every text
    edge = np.diff(inside, prepend=False)
    start = np.flatnonzero(edge & inside)
    kept = points[inside]
    data = kept.tobytes().decode("utf-32-le").encode()
    at = np.zeros(len(kept) + 1, np.int32)  # where each of the kept characters starts in UTF-8
    np.cumsum(1 + (kept > 0x7F).astype(np.int8) + (kept > 0x7FF) + (kept > 0xFFFF), out=at[1:])
    offset = at[np.append((np.cumsum(inside) - 1)[start], len(kept))]
    ends = np.cumsum([len(t) + 1 for t in lower])
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offset), pa.py_buffer(data))
    return words, np.diff(np.searchsorted(start, ends), prepend=0)


def numbered_words(texts: list[str]) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct words of the texts, and the words of each text by their number."""
    parts, sizes, first, held = [], [], 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= PART_CHARACTERS or i + 1 == len(texts):
            words, size = all_words(texts[first:i + 1])
            parts.append(words)
            sizes.append(size)
            first, held = i + 1, 0
    coded = pa.concat_arrays(parts).dictionary_encode()
    return coded.dictionary, np.split(coded.indices.to_numpy(), np.cumsum(np.concatenate(sizes))[:-1])


class Terms:
    """A numbered vocabulary, and the counts of texts over it."""

    def __init__(self, words: list[str]):
        self.names = pa.array(words, pa.string())
        # no word and no beginning has a level: those names are not looked up
        self.place = np.array([i for i, w in enumerate(words) if "#" not in w], np.int64)
        self.plain = self.names.take(pa.array(self.place))
        # a term that comes several times also counts as ``term#level``: the plain term of each of those, and its number
        marked = [(i, *w.rsplit("#", 1)) for i, w in enumerate(words) if "#" in w]
        plain = self.numbers(pa.array([w for _, w, _ in marked], pa.string()))
        self.level = np.full((len(LEVELS), len(words)), -1, np.int32)
        at = np.array([LEVELS.index(int(x)) for _, _, x in marked], np.int64)
        known = plain >= 0
        self.level[at[known], plain[known]] = np.array([i for i, _, _ in marked], np.int64)[known]

    @cached_property
    def terms(self) -> dict[str, int]:
        """Numbers by term, for a few lookups; tasks use ``numbers``."""
        return {w: i for i, w in enumerate(self.names.to_pylist())}

    def numbers(self, terms: pa.Array) -> np.ndarray:
        """Number of each term without a level, -1 where it has none."""
        at = pc.fill_null(pc.index_in(terms, value_set=self.plain), -1).to_numpy(zero_copy_only=False)
        return np.append(self.place, -1)[at]

    def batch(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        return list(self.each(texts))

    def each(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers, counts) of the terms of each text; the distinct words of all texts are looked up in one go, and the counts of few
        texts are held at a time."""
        if not texts:
            return
        words, runs = numbered_words(texts)
        length = pc.utf8_length(words).to_numpy()
        which, asked = [np.arange(len(words))], [words]
        for n in STEMS:
            which.append(np.flatnonzero(length >= n))
            beginning = pc.utf8_slice_codeunits(words.take(pa.array(which[-1])), 0, n)
            asked.append(pc.binary_join_element_wise(beginning, "*", ""))
        which, term = np.concatenate(which), self.numbers(pa.concat_arrays(asked))
        which, term = which[term >= 0], term[term >= 0]
        flat = term[np.argsort(which, kind="stable")]  # the terms of each word, one word after another
        size = np.bincount(which, minlength=len(words))
        start = np.cumsum(size) - size
        first, held = 0, 0
        for i, run in enumerate(runs):
            held += len(run)
            if held >= RUN_WORDS or i + 1 - first == RUNS or i + 1 == len(runs):
                yield from self.summed(runs[first:i + 1], start, size, flat)
                first, held = i + 1, 0

    def summed(self, runs: list[np.ndarray], start: np.ndarray, size: np.ndarray, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(numbers, counts) of the terms of each run of words; one sort counts those of all runs."""
        run, width = np.concatenate(runs), max(1, len(self.names))
        each = size[run]
        # the terms of run i are the keys from i * width on
        key = np.repeat(np.repeat(np.arange(len(runs)) * width, [len(r) for r in runs]), each) + flat[ragged(start[run], each)]
        key.sort()
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        key, n = key[at], np.diff(np.append(at, len(key)))
        ends = np.searchsorted(key, np.arange(len(runs) + 1) * width)
        which = np.repeat(np.arange(len(runs), dtype=np.uint16), np.diff(ends))
        t = key - which * np.int64(width)
        often = n >= LEVELS[0]
        often_t, often_n, often_which, all_t, all_n, all_which = t[often], n[often], which[often], [t], [n], [which]
        for x, numbers in zip(LEVELS, self.level):
            more = often_n >= x
            found = numbers[often_t[more]]
            known = found >= 0
            all_t.append(found[known].astype(np.int64))
            all_n.append((often_n[more] - x + 1)[known])
            all_which.append(often_which[more][known])
        which = np.concatenate(all_which)
        order = np.argsort(which, kind="stable")
        ends = np.cumsum(np.bincount(which, minlength=len(runs)))[:-1]
        return list(zip(np.split(np.concatenate(all_t)[order], ends), np.split(np.concatenate(all_n)[order], ends)))

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return self.batch([text])[0]


_KEPT: dict[str, object] = {}  # what a Python worker keeps between tasks: one vocabulary or one index


def kept(tag: str, make):
    if tag not in _KEPT:
        _KEPT.clear()
        _KEPT[tag] = make()
    return _KEPT[tag]


class Index:
    """Examples as a block-max inverted index."""

    def __init__(self, vocabulary: list[tuple[str, float]], examples: list, k: int = 25):
        """vocabulary: (term, weight); examples: (id, label, counts), the counts as a dict by term or as (numbers, counts)."""
        self.tag = uuid.uuid4().hex
        self.vocabulary = Terms([w for w, _ in vocabulary])
        self.idf = np.array([x for _, x in vocabulary], np.float64)
        self.k = k
        vectors = []
        terms = self.vocabulary.terms if any(isinstance(c, dict) for _, _, c in examples) else {}
        for i, y, c in examples:
            if isinstance(c, dict):
                c = {terms[w]: n for w, n in c.items() if w in terms}
                c = np.array(sorted(c), np.int64), np.array([c[t] for t in sorted(c)], np.int64)
            vectors.append((i, y, *c, self.unit(*c)[1]))
        empty = [v[1] for v in vectors if not len(v[2])]
        self.share = (sum(v[1] for v in vectors) + 0.5) / (len(vectors) + 1)
        self.share_empty = (sum(empty) + 2 * self.share) / (len(empty) + 2)
        # neighbours in the lists look alike, so that few blocks have high bounds
        full = sorted(((i, y, t, n, int(t[np.argmax(x)])) for i, y, t, n, x in vectors if len(t)), key=lambda v: (v[1], v[4], v[0]))
        self.ids, self.labels = np.array([v[0] for v in full], np.int64), np.array([v[1] for v in full], np.float64)
        self.blocks = -(-len(full) // BLOCK)
        self.norm = np.array([np.linalg.norm((1 + np.log(n)) * self.idf[t]) for _, _, t, n, _ in full])
        term = np.concatenate([v[2] for v in full]) if full else np.empty(0, np.int64)
        order = np.argsort(term, kind="stable")  # postings by term, then example
        self.lists = np.searchsorted(term[order], np.arange(len(vocabulary) + 1)).astype(np.int32)
        count = np.concatenate([v[3] for v in full])[order] if full else np.empty(0, np.int64)
        self.count = count.astype(np.min_scalar_type(int(count.max(initial=0))))
        self.example = np.repeat(np.arange(len(full)), [len(v[2]) for v in full])[order].astype(np.min_scalar_type(len(full)))

    def __getstate__(self) -> dict:
        """What a task cannot derive; the rest is derived where it is used, so that little travels."""
        derived = ("vocabulary", "value", "cells", "often", "thin", "rows", "repeats", "dense")
        return {k: v for k, v in self.__dict__.items() if k not in derived} | {"joined": "\n".join(self.vocabulary.names.to_pylist())}

    def __setstate__(self, state: dict) -> None:
        joined = state.pop("joined")
        self.__dict__.update(state, vocabulary=Terms(joined.split("\n") if joined else []))

    @cached_property
    def value(self) -> np.ndarray:
        """Weight of each posting in the unit vector of its example."""
        return (1 + np.log(self.count, dtype=np.float64)) * np.repeat(self.idf, np.diff(self.lists)) / self.norm[self.example]

    @cached_property
    def often(self) -> np.ndarray:
        """Whether a term is a row of the matrix: in more than ``DENSE`` of the examples, and among the first that fit."""
        size = np.diff(self.lists)
        rank = np.empty(len(size), np.int64)
        rank[np.argsort(-size, kind="stable")] = np.arange(len(size))
        return (size > DENSE * len(self.ids)) & (rank < CELLS // max(1, len(self.ids)))

    @cached_property
    def thin(self) -> np.ndarray:
        """Whether a term is not in the matrix and has fewer than ``FEW`` examples in each of its blocks: a bound of a block would cost
        what its scores cost."""
        term = np.repeat(np.arange(len(self.idf)), np.diff(self.lists))
        cell = np.unique(term * (self.blocks + 1) + self.example.astype(np.int64) // BLOCK) // (self.blocks + 1)
        return ~self.often & (np.diff(self.lists) < FEW * np.bincount(cell, minlength=len(self.idf)))

    @cached_property
    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """First row of each thin list, and the examples in all rows; a list is cut into rows of ``WIDTH`` postings, and its last row is
        filled up with an example that there is not."""
        every = np.diff(self.lists)
        size = np.where(self.thin, every, 0)
        first = np.append(0, np.cumsum(-(-size // WIDTH)))
        example = np.full(first[-1] * WIDTH, len(self.ids), np.min_scalar_type(len(self.ids)))
        example[ragged(first[:-1] * WIDTH, size)] = self.example[np.repeat(self.thin, every)]
        return first.astype(np.int32), example.reshape(-1, WIDTH)

    @cached_property
    def repeats(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The postings of thin lists with a count over 1: first of each term, example, logarithm of the count."""
        every = np.diff(self.lists)
        at = np.flatnonzero(np.repeat(self.thin, every) & (self.count > 1))
        first = np.searchsorted(at, self.lists).astype(np.int32)
        return first, self.example[at], np.log(self.count[at], dtype=np.float64)

    @cached_property
    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """Row of each such term, and the matrix of these terms and all examples."""
        row = np.cumsum(self.often) - 1
        matrix = np.zeros((int(self.often.sum()), len(self.ids)))
        term = np.repeat(np.arange(len(self.idf)), np.diff(self.lists))
        at = self.often[term]
        matrix[row[term[at]], self.example[at]] = self.value[at]
        return row, matrix

    @cached_property
    def cells(self) -> tuple[np.ndarray, ...]:
        """Cells of each other term, and start, size, block and largest weight of each; a cell is the part of a list in one block."""
        term = np.repeat(np.arange(len(self.idf)), np.diff(self.lists))
        block = self.example.astype(np.int64) // BLOCK
        if not len(term):
            return np.zeros(len(self.idf) + 1, np.int64), *[np.empty(0, np.int64)] * 3, np.empty(0)
        at = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])))
        size, most = np.diff(np.append(at, len(term))), np.maximum.reduceat(self.value, at)
        use = ~(self.often | self.thin)[term[at]]
        at, size, most = at[use], size[use], most[use]
        return np.searchsorted(term[at], np.arange(len(self.idf) + 1)), at, size, block[at], most

    @property
    def at(self) -> list[np.ndarray]:
        return np.split(self.example, self.lists[1:-1])

    @property
    def weight(self) -> list[np.ndarray]:
        return np.split(self.value, self.lists[1:-1])

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        t = np.array(sorted(counts), np.int64)
        return self.unit(t, np.array([counts[i] for i in t.tolist()], np.int64))

    def unit(self, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (1 + np.log(n)) * self.idf[t]
        return t, x / math.sqrt(float(x @ x)) if len(t) else x

    def products(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Cosines of unit vectors with all examples on the terms that stand in many, in one product."""
        row, matrix = self.dense
        x = np.zeros((len(vectors), len(matrix)))
        for i, (t, w) in enumerate(vectors):
            at = self.often[t]
            x[i, row[t[at]]] = w[at]
        return x @ matrix

    def nearest(self, t: np.ndarray, x: np.ndarray, partial: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(example numbers, cosines, blocks scored) of the k nearest with a cosine over 0, nearest first.

        ``partial``: the row of ``products`` for this text.
        """
        c = self.products([(t, x)])[0] if partial is None else partial
        thin = self.thin[t]
        c = c + self.thinly(t[thin], x[thin])
        rare = ~(self.often[t] | thin)
        scored = 0
        if rare.any():
            c, scored = self.added(c, t[rare], x[rare])
        # equal cosines stay equal however they were summed, so those that may reach the k-th best are rounded
        least = np.partition(c, -self.k)[-self.k] if len(c) > self.k else 0.0
        n = np.flatnonzero(c >= least - 2e-12)
        near = c[n].round(12)
        n, near = n[near > 0], near[near > 0]
        order = np.lexsort((n, -near))[:self.k]
        return n[order], near[order], scored

    def thinly(self, t: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Cosines with all examples on these thin terms: each posting counts once, the repeated ones add the logarithm of their count."""
        first, example = self.rows
        x, n = x * self.idf[t], first[t + 1] - first[t]
        at = example.take(ragged(first[t], n), 0).ravel()
        c = np.bincount(at, np.repeat(x, n * WIDTH), len(self.ids) + 1)[:-1]
        first, example, log = self.repeats
        n = first[t + 1] - first[t]
        post = ragged(first[t], n)
        return (c + np.bincount(example[post], np.repeat(x, n) * log[post], len(c))) / self.norm

    def added(self, c: np.ndarray, t: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, int]:
        """The cosines with these terms added in the blocks that reach the bound (0 in the others), and how many those are."""
        cell_first, cell_at, cell_size, cell_block, cell_most = self.cells
        n_cells = cell_first[t + 1] - cell_first[t]
        cells = ragged(cell_first[t], n_cells)
        w, block = np.repeat(x, n_cells), cell_block[cells]
        most = np.maximum.reduceat(c, np.arange(0, len(c), BLOCK)) + np.bincount(block, w * cell_most[cells], self.blocks)
        least = np.partition(c, -self.k)[-self.k] if len(c) > self.k else 0.0
        chosen = (most * (1 + 1e-9) >= least) & (most > 0)
        part = np.flatnonzero(chosen[block])
        size = cell_size[cells[part]]
        post = ragged(cell_at[cells[part]], size)
        c = c + np.bincount(self.example[post], np.repeat(w[part], size) * self.value[post], len(c))
        return np.where(np.repeat(chosen, BLOCK)[:len(c)], c, 0), int(chosen.sum())

    def scores(self, texts: list[str]) -> list[tuple[float, list[int], list[float]]]:
        """(score, ids of the nearest, their cosines) per text."""
        out: list = [(self.share_empty, [], [])] * len(texts)
        some, vectors = [], []
        for i, (t, n) in enumerate(self.vocabulary.each(texts)):
            if len(t) and self.blocks:
                some.append(i)
                vectors.append(self.unit(t, n))
            if some and (len(some) == ROWS or i + 1 == len(texts)):
                for j, (t, x), partial in zip(some, vectors, self.products(vectors)):
                    out[j] = self.vote(*self.nearest(t, x, partial)[:2])
                some, vectors = [], []
        return out

    def score(self, text: str) -> tuple[float, list[int], list[float]]:
        return self.scores([text])[0]

    def vote(self, n: np.ndarray, cos: np.ndarray) -> tuple[float, list[int], list[float]]:
        w = cos ** 2
        s = (float(w @ self.labels[n]) + 0.2 * self.share) / (float(w.sum()) + 0.2)
        return s, self.ids[n[:3]].tolist(), [round(float(v), 6) for v in cos[:3]]


def frequencies(docs: DataFrame, names: list[str]) -> tuple[int, np.ndarray]:
    """Rows of ``docs``, and in how many of them each term stands; a task sends one count per term it met."""

    joined, tag = "\n".join(names), uuid.uuid4().hex

    def run(batches):
        vocabulary, rows = kept(tag, lambda: Terms(joined.split("\n"))), 0
        met = np.zeros(len(vocabulary.names), np.int64)
        for batch in batches:
            rows += batch.num_rows
            for _, _, texts in text_blocks(batch, 0, TEXT_BYTES):
                for t, _ in vocabulary.each(texts):
                    met[t] += 1
        at = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(met[at], rows))], ["term", "n"])

    got = docs.select(text_or_empty().alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(
        F.sum("n").alias("n")).toArrow()
    term, n = got["term"].to_numpy(), got["n"].to_numpy()
    out = np.zeros(len(names), np.int64)
    out[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), out


def fit(docs: DataFrame, labels: DataFrame, sample: int = 1500, k: int = 25, folds: int = 3, fold: int = 1) -> Index:
    """The index over a bounded sample, with all its terms; document frequencies are those of all ``docs``."""
    rows = labelled_sample(docs, labels, "toxic", sample, folds, fold)

    def run(batches):
        for batch in batches:
            for start, stop, texts in text_blocks(batch, 1, 1 << 20):
                found = [words(t) for t in texts]
                ends = pa.array(np.concatenate(([0], np.cumsum([len(c) for c in found]))), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, stop - start), batch.column(2).slice(start, stop - start),
                    pa.ListArray.from_arrays(ends, pa.array([w for c in found for w in c], pa.string())),
                    pa.ListArray.from_arrays(ends, pa.array([n for c in found for n in c.values()], pa.int32()))],
                    ["id", "y", "words", "counts"])

    held = rows.mapInArrow(run, "id long, y int, words array<string>, counts array<int>")
    held = held.toArrow().sort_by("id").combine_chunks()  # at most 2 * ``sample`` rows
    ids, y = held["id"].to_pylist(), held["y"].to_numpy()
    n1, n0 = int(y.sum()), int((1 - y).sum())
    if not n1 or not n0:
        index = Index([], [(i, int(v), {}) for i, v in zip(ids, y)], k)
        index.share_empty = n1 / (n1 + n0) if n1 + n0 else 0.5
        return index
    sizes = pc.list_value_length(held["words"]).to_numpy()
    coded = pc.list_flatten(held["words"]).combine_chunks().dictionary_encode()
    number, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    counts = pc.list_flatten(held["counts"]).to_numpy()
    del held, coded
    toxic = np.repeat(y, sizes)
    a = np.bincount(number, toxic, len(names))
    b = np.bincount(number, 1 - toxic, len(names))
    n = float(n1 + n0)
    chi = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / ((a + b) * np.maximum(n - a - b, 1.0) * n1 * n0)
    total, df = frequencies(docs, names)
    weight = (np.log((total + 1) / (df + 1)) + 1) * tells(chi)
    ends = np.cumsum(sizes)
    examples = []
    for i, v, stop, size in zip(ids, y.tolist(), ends.tolist(), sizes.tolist()):
        order = np.argsort(number[stop - size:stop])
        examples.append((i, v, (number[stop - size:stop][order], counts[stop - size:stop][order])))
    return Index(list(zip(names, weight.tolist())), examples, k)


def tells(chi: np.ndarray) -> np.ndarray:
    """The weight of a term by its chi-square: no term is dropped, and those that tell nothing apart count little."""
    return (chi + 0.01) / (chi + 20.0)


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, evidence, cosines) per document: the ids of the nearest examples and how near they are."""

    def run(batches):
        held = kept(index.tag, lambda: index)
        for batch in batches:
            for start, stop, texts in text_blocks(batch, 1, TEXT_BYTES):
                got = held.scores(texts)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, stop - start), pa.array([g[0] for g in got], pa.float64()),
                    pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.float64()))],
                    ["id", "score", "evidence", "cosines"])

    df = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    schema = f"id {df.schema['id'].dataType.simpleString()}, score double, evidence array<long>, cosines array<double>"
    return df.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def report(docs: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    return score(docs, fit(docs, labels)).select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score",
        (F.col("score") >= cut).cast("int").alias("predicted"), "evidence", "cosines")
