"""Spelling variants: words one edit apart, grouped under the most frequent spelling.

Words.  The runs ``[A-Za-z\\u00C0-\\u00FF]+`` of a text with A-Z in lower case.  Where ``every`` divides the crc32 of
``<doc_id>:<run>``, one code point of the run is deleted (a planted typing error).  Words of at least ``length`` code points that
come ``least`` times or more make the vocabulary.

Method.  Every letter is hashed to one of a few symbols, so a word becomes a reduced word.  For each distinct reduced word the
full one-edit neighbourhood over the symbols is generated: itself, every deletion, replacement and insertion.  Two words
one edit apart reduce to words at most one edit apart, so joining the neighbourhoods with the reduced vocabulary misses
no pair; the pairs of original words behind a hit are verified by their edit distance.  A reduced word is named by a
polynomial hash of its symbols, from which the name of each neighbour follows in constant time, so a very long word costs
its length, not its square.  Names that meet by accident only add a pair to verify.

Symbols.  Fewer symbols make fewer neighbours and more words behind each.  ``symbols_for`` takes the smallest number for which
the words that share a reduced word by chance are no more than the words themselves, by the counts of words per length;
every number gives the same result.

Scale.  Each task counts its words before they are shuffled and hands counts on when it holds ``HELD`` words.  A word that is a
third of all rows is one count per task.  Only the vocabulary is joined.  Forms at least double the count, so
chains are short; roots are followed by doubling steps over the table of forms.

Defined results: NULL and empty texts have no words; a NULL doc_id is written as nothing before the colon; repeated rows
each count; equal counts of near words go to the smaller in code-point order; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_blocks, text_or_empty

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
LETTERS = [*map(chr, range(ord("a"), ord("z") + 1)), *map(chr, range(0xC0, 0x100))]
HELD = 400_000  # words a task counts before it hands them on
KEYS = 1 << 20  # neighbours in one batch
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64
INVERSE = pow(BASE, -1, 1 << 64)


def altered(doc_id, run: str, every: int = 97) -> str:
    """The run as it is counted: with one code point gone where ``every`` divides its crc32."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % every else run[:h % len(run)] + run[h % len(run) + 1:]


def vocabulary(docs: DataFrame, length: int = 5, least: int = 3, every: int = 97, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches):
        counts, crc = Counter(), zlib.crc32
        for batch in batches:
            for start, _, texts in text_blocks(batch, 1, 4 << 20):
                for i, text in enumerate(texts, start):
                    doc_id = batch.column(0)[i].as_py()
                    first = crc(f"{'' if doc_id is None else doc_id}:".encode())
                    lower = text.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass")
                    for w, n in Counter(RUN.findall(lower)).items():
                        if len(w) < length:
                            continue
                        h = crc(w.encode(), first)
                        if not h % every:
                            h %= len(w)
                            w = w[:h] + w[h + 1:]
                            if len(w) < length:
                                continue
                        counts[w] += n
                    if len(counts) >= HELD:
                        yield out(counts)
                        counts = Counter()
        yield out(counts)

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def symbols_for(sizes: dict[int, int]) -> int:
    """Number of symbols for a vocabulary with so many words of each length."""
    total = sum(sizes.values())
    return next(s for s in range(4, 65) if s == 64 or sum(n * n / s ** length for length, n in sizes.items()) <= total)


def symbol_table(symbols: int) -> np.ndarray:
    """Symbol (1 and up) of each code point below 256."""
    table = np.zeros(256, np.uint64)
    for c in LETTERS:
        table[ord(c)] = 1 + zlib.crc32(c.encode()) % symbols
    return table


def powers(n: int) -> np.ndarray:
    """BASE ** 0 .. BASE ** n modulo 2 ** 64."""
    out = np.full(n + 1, BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def name(symbols: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Sums of symbol * BASE ** position over the first 0, 1, ... symbols; the last one names the reduced word."""
    return np.concatenate(([np.uint64(0)], np.cumsum(symbols * power[:len(symbols)], dtype=np.uint64)))


def neighbourhood(s: np.ndarray, power: np.ndarray, symbols: int) -> np.ndarray:
    """Names of all words over the symbols at most one edit from ``s``, distinct."""
    before = name(s, power)
    n, whole, base = len(s), before[-1], np.uint64(BASE)
    letters = np.arange(1, symbols + 1, dtype=np.uint64)[:, None]
    deleted = before[:-1] + (whole - before[1:]) * np.uint64(INVERSE)
    replaced = whole + (letters - s) * power[:n]
    inserted = before + letters * power[:n + 1] + (whole - before) * base
    return np.unique(np.concatenate((before[-1:], deleted, replaced.ravel(), inserted.ravel())))


def reduced(words: DataFrame, symbols: int) -> DataFrame:
    """(word, n, r): r names the reduced word."""

    def run(batches):
        table, power = symbol_table(symbols), powers(64)
        for batch in batches:
            r = np.empty(batch.num_rows, np.uint64)
            for i, w in enumerate(batch.column(0).to_pylist()):
                if len(w) >= len(power):
                    power = powers(2 * len(w))
                r[i] = name(table[np.frombuffer(w.encode("latin-1"), np.uint8)], power)[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(r.view(np.int64))], ["word", "n", "r"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, r long")


def reduced_pairs(words: DataFrame, symbols: int) -> DataFrame:
    """(r, key): the one-edit neighbours ``key`` of each reduced word ``r``; ``words`` has one word per reduced word."""

    def run(batches):
        table, power, held, size = symbol_table(symbols), powers(64), [], 0

        def out():
            r = np.repeat(np.array([x for x, _ in held], np.int64), [len(k) for _, k in held])
            return pa.RecordBatch.from_arrays([pa.array(r), pa.array(np.concatenate([k for _, k in held]).view(np.int64))], ["r", "key"])

        for batch in batches:
            for w, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(w) >= len(power) - 1:
                    power = powers(2 * len(w))
                keys = neighbourhood(table[np.frombuffer(w.encode("latin-1"), np.uint8)], power, symbols)
                held.append((r, keys))
                size += len(keys)
                if size >= KEYS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return words.select("word", "r").mapInArrow(run, "r long, key long")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of ``words`` (word, n; a stored table) one edit apart."""
    sizes = {r.length: r.n for r in words.groupBy(F.least(F.length("word"), F.lit(64)).alias("length")).agg(
        F.count("*").alias("n")).collect()}  # at most 64 rows
    symbols = symbols_for(sizes) if sizes else 4
    marked = stored(reduced(words, symbols))
    shapes = marked.groupBy("r").agg(F.min("word").alias("word"))
    met = reduced_pairs(shapes, symbols).join(shapes.select(F.col("r").alias("key")), "key")
    mine = marked.select("r", "word", "n")
    theirs = marked.select(F.col("r").alias("key"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return met.join(mine, "r").join(theirs, "key").filter(one_edit(F.col("word"), F.col("near"))).select("word", "n", "near", "near_n")


def one_edit(a: Column, b: Column) -> Column:
    """Exactly one code point inserted, deleted or replaced."""
    return (F.abs(F.length(a) - F.length(b)) <= 1) & (F.levenshtein(a, b, 1) == 1)


def forms(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n): a word's form is its most frequent near word, if at least twice as frequent."""
    best = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    all_ = words.join(best, "word", "left")
    taken = -F.col("best.n") >= 2 * F.col("n")
    return all_.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                       F.when(taken, F.col("best.word")).alias("form"), F.when(taken, -F.col("best.n")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for links (word, form), which never run in a circle: each step doubles how far a root reaches."""
    now = stored(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = after.select("word", "root")
        if not after.filter("moved").head(1):
            return now


def variants(docs: DataFrame, length: int = 5, least: int = 3, every: int = 97, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of the vocabulary."""
    found = stored(forms(stored(vocabulary(docs, length, least, every, id_col, text_col))))
    named = found.join(roots(found.filter("form is not null")), "word", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
