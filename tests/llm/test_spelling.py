import re
import zlib
from collections import Counter

import numpy as np
import pytest

from retailops.llm import spelling as M
from retailops.llm.common import documents

from .cases import SF, empty_documents, odd_documents


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows, length=5, least=3, every=97):
    counts = Counter()
    for i, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[:h % len(w)] + w[h % len(w) + 1:] if h % every == 0 else w] += 1
    v = {w: n for w, n in counts.items() if n >= least and len(w) >= length}
    by_length = {}
    for w in v:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [x for d in (-1, 0, 1) for x in by_length.get(len(w) + d, []) if one_edit(w, x)] for w in v}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-v[x], x), default=None)
        form[w] = best if best is not None and v[best] >= 2 * v[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), v[w], len(near[w]), v[form[w]] if form[w] else None) for w in v}


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_sf_equals_brute_force(spark):
    docs = documents(spark, SF)
    got = [tuple(r) for r in M.variants(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows_of(docs))


@pytest.mark.parametrize("length, least, every", [(5, 3, 97), (1, 1, 2)])
def test_odd_documents(spark, length, least, every):
    docs = odd_documents(spark)
    got = [tuple(r) for r in M.variants(docs, length, least, every).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows_of(docs), length, least, every)


def test_empty(spark):
    assert M.variants(empty_documents(spark)).count() == 0


def test_chains_ties_and_accents(spark):
    """Forms are followed over several steps, ties go by code point, and accented letters are one letter."""
    words = {"colour": 40, "coloure": 20, "colouree": 10, "coloureee": 5, "naïve": 9, "naive": 4, "naéve": 4, "eaten": 3, "eater": 8,
             "eates": 8, "Étage": 12, "étage": 6, "ßßßßß": 3, "ßßßßÿ": 6, "letter" * 2000: 7, "letter" * 2000 + "s": 3}
    docs = spark.createDataFrame([(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())], "doc_id int, text string")
    rows = {r.word: r for r in M.variants(docs, every=10**9).collect()}
    want = {x[0]: x for x in plain(rows_of(docs), every=10**9) if len(x[0]) < 1000}
    assert {w: tuple(r) for w, r in rows.items() if len(w) < 1000} == want
    assert rows["coloureee"].root == "colour" and rows["eaten"].form == "eater" and rows["naive"].form == "naïve"
    assert rows["letter" * 2000 + "s"].form == "letter" * 2000


def test_a_word_that_is_most_of_the_table(spark, monkeypatch):
    """A task hands its counts on many times, one word stands in every row, and the result is whole."""
    monkeypatch.setattr(M, "HELD", 20)
    docs = spark.createDataFrame([(i, f"thing thing thinge{chr(97 + i % 26)} other{chr(97 + i % 7)}{chr(97 + i % 11)}") for i in range(800)],
                                 "doc_id long, text string").repartition(7)
    assert {tuple(r) for r in M.variants(docs).collect()} == plain(rows_of(docs))


@pytest.mark.parametrize("symbols", [4, 7])
def test_neighbourhood_is_all_words_one_edit_away(symbols):
    rng = np.random.default_rng(3)
    power = M.powers(20)
    for n in range(7):
        s = rng.integers(1, symbols + 1, n).astype(np.uint64)
        words = {tuple(s)} | {(*s[:i], *s[i + 1:]) for i in range(n)}
        words |= {(*s[:i], np.uint64(x), *s[i + 1:]) for i in range(n) for x in range(1, symbols + 1)}
        words |= {(*s[:i], np.uint64(x), *s[i:]) for i in range(n + 1) for x in range(1, symbols + 1)}
        want = {int(M.name(np.array(w, np.uint64), power)[-1]) for w in words}
        assert set(M.neighbourhood(s, power, symbols).tolist()) == want and len(want) == len(words)


def test_symbols_follow_the_vocabulary():
    assert M.symbols_for({8: 100}) == 4
    small, large = (M.symbols_for({5: n, 8: 5 * n}) for n in (10**4, 10**7))
    assert 4 <= small < large <= 64
