"""Quality network, toxicity neighbours, decontamination, line dedup and the pipeline."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from retailops.llm import decontam as D
from retailops.llm import line_dedup as L
from retailops.llm import quality_cnn as N
from retailops.llm import toxicity as X
from retailops.llm.common import documents

from .cases import SF, empty_documents, odd_documents

MID = SF.replace("0.001", "0.1")


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- quality network -----------------------------------------------------------------------------------------------
def test_gradients_equal_differences():
    net = N.Network(3)
    rng = np.random.default_rng(9)
    texts = [rng.integers(32, 127, n, dtype=np.uint8).tobytes() for n in (900, 3, 400)]
    y = np.array([1, 0, 0], np.float32)

    def loss():
        p = net.score(texts)
        w = np.where(y == 1, 0.5 / 0.4, 0.5 / 0.6)
        return float(-(w * np.log(np.where(y == 1, p, 1 - p))).mean())

    g = net.gradients(texts, y, 0.4)
    for param, grad, at in ((net.out, g[2], (5,)), (net.bias, g[1], (3,)), (net.shift, g[3], (0,)),
                            (net.filters, g[0], np.unravel_index(np.abs(g[0]).argmax(), g[0].shape)),
                            (net.filters, g[0], np.unravel_index(np.abs(g[0]).argsort(axis=None)[-9], g[0].shape))):
        old, e = param[at].copy(), 1e-3
        param[at] = old + e
        up = loss()
        param[at] = old - e
        down = loss()
        param[at] = old
        assert abs((up - down) / (2 * e) - grad[at]) < 2e-3


def test_every_byte_counts():
    net = N.Network(4)
    text = b"plain words only " * 500
    base = net.score([text])[0]
    assert any(net.score([text[:i] + b"\xff\xfe\xfd\xfc" * 4 + text[i + 16:]])[0] != base for i in (8400,))
    alone = net.score([b"one", text, b""])
    assert np.allclose(alone, [net.score([t])[0] for t in (b"one", text, b"")], atol=1e-6)


def test_quality_held_out(spark):
    rows = N.report(documents(spark, MID), table(spark, "labels", MID)).join(table(spark, "labels", MID), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    good, bad = [r for r in held if r.quality == 1], [r for r in held if r.quality == 0]
    assert sum(r.predicted for r in good) >= 0.98 * len(good)
    assert sum(1 - r.predicted for r in bad) >= 0.8 * len(bad)


def test_quality_odd(spark):
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (5, 0, 1), (None, 1, 1), (7, None, None)],
                                   "doc_id long, quality int, toxic int")
    docs = odd_documents(spark)
    rows = N.report(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert N.report(empty_documents(spark), labels).count() == 0
    assert {r.score for r in N.report(docs, labels.limit(0)).collect()} == {0.5}
    assert N.keep(docs, labels.limit(0)).collect() == docs.collect()


def plain_probability(net, text):
    """The score of one text by plain loops: every window of every chunk."""
    data = b"\0" * N.WIDTH + (text or b" ")
    hops = -(-len(data) // N.HOP)
    data = data.ljust(hops * N.HOP, b"\0") + b"\0" * N.WIDTH
    top = []
    for h in range(hops):
        windows = [sum(net.filters[k][data[i + k]] for k in range(N.WIDTH)) for i in range(h * N.HOP, (h + 1) * N.HOP, N.STRIDE)]
        top.append(np.max(windows, axis=0))
    chunks = [np.maximum(np.maximum(top[h], top[min(h + 1, hops - 1)]) + net.bias, 0) for h in range(hops)]
    z = float(np.concatenate((np.mean(chunks, axis=0), np.max(chunks, axis=0))) @ net.out + net.shift[0])
    return 1 / (1 + np.exp(-z))


def test_scores_equal_plain_convolution():
    net = N.Network(5)
    texts = [b"", b"a", b"some words " * 30, bytes(range(256)) * 9, "é\U0001d11e".encode() * 100]
    assert np.allclose(net.score(texts), [plain_probability(net, t) for t in texts], atol=1e-5)


def test_training_in_parts_equals_training_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 123, n, dtype=np.uint8).tobytes() for n in (9000, 3, 400, 5000, 20)]
    y = np.array([1, 0, 0, 1, 0], np.float32)
    whole = N.Network(3).gradients(texts, y, 0.4)
    monkeypatch.setattr(N, "STEP_BYTES", 5000)
    for a, b in zip(whole, N.Network(3).mean_gradients(texts, y, 0.4)):
        assert np.allclose(a, b, atol=1e-5)


def test_training_rows_are_whole_and_defined(spark):
    """A clashing label and a repeated id always give the same row; a long text is not cut; the byte bound takes whole rows."""
    long = "word " * 9000
    docs = spark.createDataFrame([(1, "b text"), (1, "a text"), (2, long), (3, "x"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (4, 1)], "doc_id long, quality int")
    rows = {r.id: (r.text, r.y) for r in N.labelled_sample(docs, labels, "quality", 10, 5, 9).collect()}
    assert rows == {1: ("a text", 0), 2: (long, 0), 3: ("x", 1), 4: ("", 1)}
    seen = []
    train = N.Network.train
    N.Network.train = lambda self, texts, y: seen.append(texts) or train(self, texts, y)
    try:
        N.fit(docs, labels), N.fit(docs, labels, max_bytes=100)
    finally:
        N.Network.train = train
    assert max(map(len, seen[0])) == len(long) and sum(map(len, seen[1])) <= 100


# -- toxicity ------------------------------------------------------------------------------------------------------
def test_nearest_are_exact():
    rnd = random.Random(7)
    vocab = [(f"w{i}", 1 + i / 10) for i in range(40)]
    ex = [(n, n % 3 == 0, {f"w{rnd.randrange(40)}": rnd.randrange(1, 5) for _ in range(rnd.randrange(6))}) for n in range(900)]
    ix, less = X.Index(vocab, ex, 9), 0
    full = np.zeros((40, len(ix.ids)))
    for t, (a, w) in enumerate(zip(ix.at, ix.weight)):
        full[t, a] = w
    for _ in range(60):
        t, x = ix.vector({rnd.randrange(40): rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 4))})
        n, c, scored = ix.nearest(t, x)
        cos = x @ full[t]
        want = np.lexsort((np.arange(len(cos)), -cos.round(12)))[:9]
        want = want[cos[want] > 0]
        assert np.allclose(np.sort(c), np.sort(cos[want])) and len(n) == len(want)
        less += scored < ix.blocks
    assert less > 0


def test_block_maxima_only_where_they_serve():
    """Lists with few examples in each block are added at once: bounding their blocks costs what their scores cost."""
    rnd = random.Random(8)
    heavy = [(n, n % 2, {"all": 1, f"half{n % 2}": 1, **{f"w{rnd.randrange(400)}": rnd.randrange(1, 4) for _ in range(12)}}) for n in range(2000)]
    ix = X.Index([("all", 0.1), ("half0", 0.5), ("half1", 0.5), *[(f"w{i}", 1 + i / 400) for i in range(400)]], heavy, 9)
    size, cells = np.diff(ix.lists), np.diff(ix.cells[0])
    assert (size[3:] > 20).all() and not cells[3:].sum()  # a cell a posting before
    full = np.zeros((403, len(ix.ids)))
    for t, (a, w) in enumerate(zip(ix.at, ix.weight)):
        full[t, a] = w
    for _ in range(20):
        t, x = ix.vector({rnd.randrange(403): rnd.randrange(1, 4) for _ in range(30)})
        n, c, _ = ix.nearest(t, x)
        cos = (x @ full[t]).round(12)
        assert np.allclose(c, np.sort(cos)[::-1][:9])


def test_thin_lists_in_rows_give_full_cosines():
    """Thin lists read no weight per posting; last rows, counts over 1, terms of the matrix and texts without thin terms included."""
    rnd = random.Random(9)
    ex = [(n, n % 2, {"all": n % 5 + 1, **{f"w{rnd.randrange(1500)}": rnd.choice([1, 1, 2, 7]) for _ in range(20)}}) for n in range(700)]
    ix = X.Index([("all", 0.2), *[(f"w{i}", 1 + i / 1500) for i in range(1500)], ("none", 3.0)], ex, 9)
    first, example = ix.rows
    assert ix.thin[1:1501].all() and not ix.thin[0] and not hasattr(ix, "place")
    assert example.shape == (int((-(-np.diff(ix.lists)[ix.thin] // X.WIDTH)).sum()), X.WIDTH)
    assert (example < 700).sum() == np.diff(ix.lists)[ix.thin].sum() and len(ix.repeats[1]) == (ix.count[ix.lists[1]:] > 1).sum()
    full = np.zeros((1502, 700))
    for t, (a, w) in enumerate(zip(ix.at, ix.weight)):
        full[t, a] = w
    for asked in [[0], [1501], [0, 1501], *[sorted({rnd.randrange(1502) for _ in range(rnd.randrange(1, 60))}) for _ in range(30)]]:
        t, x = ix.vector({i: rnd.randrange(1, 4) for i in asked})
        thin = ix.thin[t]
        assert np.allclose(ix.thinly(t[thin], x[thin]), x[thin] @ full[t[thin]], atol=1e-14)
        cos = (x @ full[t]).round(12)
        want = [i for i in np.lexsort((np.arange(700), -cos))[:9] if cos[i] > 0]
        n, c, _ = ix.nearest(t, x)
        assert n.tolist() == want and np.allclose(c, cos[want], atol=1e-12)


def test_terms_of_many_texts_are_counted_together():
    """One pass counts the terms of many short texts (one pass a text before), with the same result for each."""
    rnd = random.Random(10)
    texts = [" ".join(rnd.choice(["bad", "badly", "fine", "of", "zzz"]) for _ in range(rnd.choice([0, 0, 1, 3, 40]))) for _ in range(600)]
    names = sorted(w for w in set().union(*(X.words(t) for t in texts)) if not w.startswith("zzz"))
    terms, passes = X.Terms(names), []
    summed = terms.summed
    terms.summed = lambda runs, *a: passes.append(len(runs)) or summed(runs, *a)
    got = terms.batch(texts)
    assert sum(passes) == len(got) == 600 and len(passes) <= 4
    for text, (t, n) in zip(texts, got):
        assert {names[i]: c for i, c in zip(t.tolist(), n.tolist())} == {w: c for w, c in X.words(text).items() if w in terms.terms}
    assert terms.batch([]) == [] and [len(t) for t, _ in X.Terms([]).batch(["a b", ""])] == [0, 0]


def test_words_are_those_of_the_pattern():
    texts = ["", "a", "Ab1cd_e fG", "ΟΔΟΣ", "İstanbul ²Ⅷ٣x", "ſt ﬁ\n\nz", "\U0001d51e\U00010400 中文\ud7ff!", "é́a\x00b", "\n", "end"]
    want = [X.WORD.findall(t.lower()) for t in texts]
    words, runs = X.numbered_words(texts)
    assert [[words[int(i)].as_py() for i in r] for r in runs] == want
    assert X.numbered_words(["", "12"])[1][1].size == 0
    terms = X.Terms(sorted({w for t in texts for w in X.words(t)}))
    for t, (number, n) in zip(texts, terms.batch(texts)):
        assert dict(zip([terms.names[int(i)].as_py() for i in number], n.tolist())) == dict(X.words(t))


def test_toxicity_held_out(spark):
    rows = X.report(documents(spark, MID), table(spark, "labels", MID)).join(table(spark, "labels", MID), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    toxic, clean = [r for r in held if r.toxic == 1], [r for r in held if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_toxicity_keeps_all_terms_and_counts_all_documents(spark):
    rnd = random.Random(5)
    letters = lambda n: "".join(chr(97 + int(d)) for d in str(n))
    rows = [(i, " ".join(["zz" + letters(i), "bad" if i % 2 else "fine"] + [rnd.choice(["uu", "vv", "ww"])] * (i % 4))) for i in range(60)]
    rows += [(100 + i, "uu") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    ix = X.fit(docs, labels, fold=9)
    want = set().union(*(X.words(t) for _, t in rows))
    assert set(ix.vocabulary.terms) == want and len(ix.ids) == 60
    a = {w: sum(w in X.words(t) for i, t in rows if i < 60 and i % 2) for w in want}
    b = {w: sum(w in X.words(t) for i, t in rows if i < 60 and not i % 2) for w in want}
    df = {w: sum(w in X.words(t) for _, t in rows) for w in want}
    for w, i in ix.vocabulary.terms.items():
        chi = 60 * (a[w] * (30 - b[w]) - b[w] * (30 - a[w])) ** 2 / ((a[w] + b[w]) * max(60 - a[w] - b[w], 1) * 900)
        assert np.isclose(ix.idf[i], (np.log(101 / (df[w] + 1)) + 1) * X.tells(np.array([chi]))[0])


def test_scores_equal_a_full_cosine_matrix(spark):
    """Votes and scores of real documents, whatever is dense, in lists or pruned, against all cosines."""
    docs = documents(spark, SF.replace("0.001", "0.01"))
    ix = X.fit(docs, table(spark, "labels", SF.replace("0.001", "0.01")))
    term = np.repeat(np.arange(len(ix.idf)), np.diff(ix.lists))
    rows = [r for r in X.score(docs, ix).collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    pruned = 0
    for r in rows[::7]:
        c = X.words(texts[r.doc_id] or "")
        x = np.zeros(len(ix.idf))
        for w, n in c.items():
            if w in ix.vocabulary.terms:
                x[ix.vocabulary.terms[w]] = (1 + np.log(n)) * ix.idf[ix.vocabulary.terms[w]]
        if not x.any():
            assert r.score == ix.share_empty
            continue
        cos = np.bincount(ix.example, (x / np.linalg.norm(x))[term] * ix.value, len(ix.ids)).round(12)
        best = [i for i in np.lexsort((np.arange(len(cos)), -cos))[:ix.k] if cos[i] > 0]
        w = cos[best] ** 2
        assert np.isclose(r.score, (w @ ix.labels[best] + 0.2 * ix.share) / (w.sum() + 0.2), atol=1e-9)
        assert np.allclose(r.cosines, cos[best[:3]], atol=1e-6)
        t = np.flatnonzero(x)
        pruned += ix.nearest(t, x[t] / np.linalg.norm(x))[2] < ix.blocks
    assert pruned and 0 < ix.often.sum() < len(ix.idf)


def test_terms_of_a_batch_equal_counted_words():
    texts = ["It's a Word, a word; WORDS² x1y _z_ ½", "", "déjà déjà déjà 中文 ſ K İi ß", "word " * 12 + "abc-def ghi"]
    names = sorted(set().union(*map(X.words, texts[::2])))
    terms = X.Terms(names)
    for text, (t, n) in zip(texts, terms.batch(texts)):
        assert {names[i]: c for i, c in zip(t.tolist(), n.tolist())} == {w: c for w, c in X.words(text).items() if w in terms.terms}


def test_toxicity_odd(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 17)], "doc_id long, quality int, toxic int")
    docs = odd_documents(spark)
    assert len(rows := X.report(docs, labels).collect()) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in X.report(docs, labels.limit(0)).collect()} == {0.5}
    assert X.report(empty_documents(spark), labels).count() == 0


# -- decontamination -----------------------------------------------------------------------------------------------
def plain_within(item, text, most):
    """Edits between the item and its best place in the text, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row) <= most


def test_alignment_equals_full_table():
    rnd = random.Random(11)
    for _ in range(300):
        item = bytes(rnd.choice(b"abc ") for _ in range(rnd.randrange(1, 25)))
        text = bytearray(bytes(rnd.choice(b"abc ") for _ in range(5)) + item + b"abcabc"[:rnd.randrange(6)])
        for _ in range(rnd.randrange(6)):
            p = rnd.randrange(len(text))
            text[p:p + rnd.randrange(2)] = bytes([rnd.choice(b"abcx")])[:rnd.randrange(2)]
        k = rnd.randrange(4)
        assert D.aligned(np.frombuffer(item, np.uint8), np.frombuffer(bytes(text), np.uint8), k) == plain_within(item, text, k)


def test_edited_passages_are_found_and_others_not():
    rnd = random.Random(12)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    rows = [(i, prose(rnd.randrange(8, 60))) for i in range(60)] + [(60, "tiny"), (61, ""), (62, None), (63, "...")]
    items = D.Items(rows)
    texts, want = [], []
    for n in range(300):
        i, t = rnd.choice(rows[:60])
        f = D.fold(t)
        edits = rnd.randrange(int(len(f) * 0.12) + 1)
        s = list(t.upper() if n % 3 else t)
        for _ in range(edits):
            p = rnd.randrange(len(s))
            s[p:p + 1] = rnd.choice([[], ["z"], [s[p], "q"]]) if len(s) > 3 else s[p:p + 1]
        texts.append(prose(rnd.randrange(40)) + "\n" * (n % 2) + " " + "".join(s) + " " + prose(rnd.randrange(40)))
    for t in texts:
        f = D.fold(t)
        want.append(sorted(i for (i, x), k in zip(items.long, items.most.tolist()) if plain_within_fast(x, f, k)))
    assert items.find(texts) == want
    assert sum(map(len, want)) > 100 and items.find([prose(3000), "", "tiny words"]) == [[], [], [60]]


def plain_within_fast(item, text, most):
    """The same by one vector per item byte over the whole text."""
    a, steps = np.frombuffer(text, np.uint8), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, c in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (a != c), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return bool(row.min() <= most)


def test_decontamination(spark, monkeypatch):
    bench = table(spark, "benchmark")
    whole = {r.doc_id: list(r.item_ids) for r in D.report(documents(spark, SF), bench).collect()}
    items = [(r.item_id, D.fold(r.text)) for r in bench.collect()]
    for r in documents(spark, SF).collect():
        assert set(whole[r.doc_id]) >= {i for i, f in items if f in D.fold(r.text)}
    assert any(whole.values())
    monkeypatch.setattr(D, "ITEM_BYTES", 1500)  # several passes find the same
    assert {r.doc_id: list(r.item_ids) for r in D.report(documents(spark, SF), bench).collect()} == whole


def test_items_with_a_line_gone_are_found(spark):
    rnd = random.Random(21)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = {i: [prose(12) for _ in range(5)] for i in range(12)}
    bench = spark.createDataFrame([(i, "\n".join(x)) for i, x in items.items()], "item_id long, text string")
    rows = [(i, "\n".join([prose(30), *x[:2], *x[3:], prose(30)])) for i, x in items.items()]
    rows += [(100 + i, "\n".join([prose(30), x[1], prose(30)])) for i, x in items.items()]
    rows += [(200, prose(3000)), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: list(r.item_ids) for r in D.report(docs, bench).collect()}
    assert got == {i: [i] if i < 100 else [] for i, _ in rows}
    assert sorted(r.doc_id for r in D.keep_clean(docs, bench).collect()) == [i for i, _ in rows if i >= 100]


def test_decontamination_odd(spark):
    docs = odd_documents(spark)
    bench = spark.createDataFrame([(1, "no id here"), (None, "one"), (3, None), (4, "")], "item_id long, text string")
    got = {(r.doc_id, r.text): list(r.found_items) for r in D.find(docs, bench).collect()}
    assert got[(None, "no id here")] == [1] and got[(4, "one")] == [-1] and got[(1, None)] == []
    kept = D.keep_clean(docs.withColumn("found_items", docs.text), bench)
    assert kept.columns == [*docs.columns, "found_items"] and kept.count() == sum(not v for v in got.values()) + 1
    assert D.report(empty_documents(spark), bench).count() == 0
    assert D.report(docs, bench.limit(0)).filter("n_items > 0").count() == 0


def test_items_with_a_fifth_gone_are_found(spark):
    """Recall by the share of an item that is left, in clean documents that are flagged by nothing else."""
    rows = [(r.item_id, r.text) for r in table(spark, "benchmark").collect()]
    texts = [r.text or "" for r in documents(spark, SF).collect()]
    items, rng = D.Items(rows, part=D.PART), random.Random(1)
    clean = [t for t, f in zip(texts, items.find(texts)) if not f]
    recall = {}
    for left in (1.0, 0.9, 0.8):
        planted, want = [], []
        for i, text in rows:
            w, host = text.split(" "), rng.choice(clean)
            gone = int(len(w) * (1 - left))
            at = rng.randrange(len(w) - gone + 1)
            planted.append(" ".join([host[:len(host) // 2], *w[:at], *w[at + gone:], host[len(host) // 2:]]))
            want.append(i)
        got = items.find(planted)
        recall[left] = sum(i in g for i, g in zip(want, got)) / len(want)
        assert sum(len(set(g) - {i}) for i, g in zip(want, got)) <= 0.05 * len(want)  # equal or nested items
    assert recall[1.0] == 1 and recall[0.9] >= 0.95 and recall[0.8] >= 0.9, recall


# -- line dedup ----------------------------------------------------------------------------------------------------
def plain_clean(rows, sites):
    trim = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x)
    whole = lambda t: tuple(trim(x) for x in t.split("\n"))
    spread, copies = defaultdict(set), defaultdict(set)
    for text, source in rows:
        if text is not None:
            copies[whole(text)].add(source)
            for x in whole(text):
                spread[x].add(source)
    out = []
    for text, source in rows:
        if text is None or len(copies[whole(text)]) >= sites:
            out.append((text, 0))
            continue
        parts = text.split("\n")
        left = [x for x in parts if not trim(x) or len(spread[trim(x)]) < sites]
        out.append(("\n".join(left), len(parts) - len(left)))
    return out


def test_line_dedup(spark):
    rnd = random.Random(4)
    shared = [f"shared line number {i} of the site footer" for i in range(12)]
    rows = []
    for n in range(300):
        own = [f"own text {n} {j} with some more words in it" for j in range(rnd.randrange(8))]
        lines = own + [rnd.choice(["", "  ", "\t"]) + s for i, s in enumerate(shared) if rnd.random() < 0.04 * i]
        rnd.shuffle(lines)
        rows.append((n, rnd.choice([None, "\n".join(lines)]) if n % 50 == 0 else "\n".join(lines), f"s{rnd.randrange(12)}" if n % 7 else None))
    rows += rows[:20] + [(400 + n, "Les.\n" + shared[n % 3], f"s{n}") for n in range(9)] + [(500 + n, f"{shared[11]}\n ok \n", f"s{n}") for n in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as line", "2 as key", "3 as gone")
    for sites in (4, 8, 12):
        got = sorted((str(r.row.doc_id), str(r.text), r.n_removed) for r in L.clean(docs, sites).collect())
        want = plain_clean([(t, s) for _, t, s in rows], sites)
        assert got == sorted((str(i), str(t), n) for (i, _, _), (t, n) in zip(rows, want))
        assert any(n for *_, n in got)


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(n, f"line over {s} sites and a few more words\nrest {n} {s} " + "x" * 80, f"site{n}") for s in range(80, 121, 4) for n in range(s)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    lost = {int(re.search(r"over (\d+)", r.row.text)[1]) for r in L.clean(docs, 100).collect() if r.n_removed}
    assert lost == {s for s in range(80, 121, 4) if s >= 100}


def test_copies_of_a_whole_text_stay(spark):
    text = "\n".join(f"sentence {i} of a document that was copied everywhere" for i in range(9))
    docs = spark.createDataFrame([(i, text, f"s{i}") for i in range(20)], "doc_id long, text string, source string")
    assert {r.text for r in L.clean(docs).collect()} == {text}


def test_pipeline_takes_boilerplate_out_of_short_pages(spark):
    head, foot = "welcome to the network of all our shops", "all rights reserved by the network of shops"
    copy = "\n".join(f"sentence {i} of a document that was copied everywhere" for i in range(9))
    rows = [(i, f"{head}\npage {i}\n{foot}", f"s{i}") for i in range(20)] + [(50 + i, copy, f"s{i}") for i in range(20)]
    rows += [(90, head, "s1"), (91, f"{copy}\none line more", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'en' as lang", "9L as n_chars")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.lines(spark, docs, SF).collect()}
    assert all(got[i] == (f"page {i}", len(f"page {i}")) for i in range(20))
    assert all(got[50 + i] == (copy, 9) for i in range(20))
    assert got[90] == ("", 0) and got[91] == ("one line more", 13)


def test_pipeline_takes_short_lines_out(spark):
    rows = [(i, f"Les.\n\npage {i} with some words of its own\n \n Les. ", f"s{i}") for i in range(8)]
    rows += [(20 + i, f"seven\nanother page {i} with its own words", f"s{i}") for i in range(7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'en' as lang", "9L as n_chars")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, SF).collect()}
    assert all(got[i] == f"\npage {i} with some words of its own\n " for i in range(8))
    assert all(got[20 + i] == rows[8 + i][1] for i in range(7))


def test_line_dedup_odd(spark):
    assert L.report(odd_documents(spark)).count() == odd_documents(spark).count()
    assert L.report(empty_documents(spark)).count() == 0


# -- pipeline ------------------------------------------------------------------------------------------------------
def test_pipeline_follows_its_stages(spark):
    sf = SF.replace("0.001", "0.01")  # large enough that lines of all lengths and short pages are cleaned
    docs = documents(spark, sf)
    rows = docs.collect()
    network = N.fit(docs, table(spark, "labels", sf))
    rows = [r for r, s in zip(rows, network.score([(r.text or "").encode() for r in rows])) if s >= 0.3]
    texts = [t for t, _ in plain_clean([(r.text, r.source) for r in rows], 8)]
    assert any(len(t) < 0.4 * len(r.text) for t, r in zip(texts, rows))
    from .test_simhash import plain_fingerprint, plain_groups
    groups = plain_groups([plain_fingerprint(t) for t in texts])
    first = {}
    for n in sorted(range(len(rows)), key=lambda n: rows[n].doc_id):
        first.setdefault(groups[n], n)
    items = D.Items([(r.item_id, r.text) for r in table(spark, "benchmark", sf).collect()])
    left = [n for n in first.values() if not items.find([texts[n]])[0]]
    got = sorted((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == sorted((rows[n].doc_id, hashlib.sha256(texts[n].encode()).hexdigest()) for n in left)
    assert 0 < len(got) < docs.count()


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        df = table(spark, name)
        (df.limit(0) if name == "documents" else df).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_the_columns(spark):
    docs = odd_documents(spark).withColumn("n_chars", documents(spark, SF).schema and __import__("pyspark").sql.functions.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == corpus_pipeline.COLUMNS, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
