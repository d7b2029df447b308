import re

import numpy as np
import pytest

from retailops.llm import minhash as M
from retailops.llm.common import documents

from .cases import SF, empty_documents, odd_documents


def plain_set(text, words=2):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def plain(rows, percent=80):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = {}
    for i, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in at[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    out = [(str(i), len(s), least.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets))]
    return sorted((i, n, str(c), i == str(c)) for i, n, c in out)


def rows_of(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in df.collect())


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("make", [odd_documents, lambda s: documents(s, SF)])
def test_groups_equal_brute_force(spark, make):
    docs = make(spark)
    assert rows_of(M.groups(docs)) == plain(pairs(docs))


def test_empty(spark):
    assert M.groups(empty_documents(spark)).count() == 0


def families(rng, sizes, length):
    """Texts at all similarities around the bound: each family's members change some words of one text."""
    out = []
    for f, size in enumerate(sizes):
        base = [f"w{f}x{i}" for i in range(length)]
        for _ in range(size):
            w = list(base)
            for at in rng.integers(0, length, rng.integers(0, length // 6)):
                w[at] = f"n{rng.integers(0, 10**9)}"
            out.append(" ".join(w))
    return out


def test_links_around_the_bound_chains_and_short_texts(spark):
    """Chains drift far from the bucket's smallest member, so stars alone would lose links; short texts fill few bins."""
    rng = np.random.default_rng(5)
    texts = families(rng, [25, 25, 40], 60) + families(rng, [12] * 12, 9)
    words = [f"c{i}" for i in range(40)]
    for i in range(60):  # a chain: each text changes one word at the end of the last one
        words = [*words[1:], f"d{i}"] if i % 2 else [*words[:-1], f"e{i}"]
        texts.append(" ".join(words))
    texts += ["a b c d e f", "a b c d e", "a b c d", "a", "A", "a b"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(int(i), t) for i, t in rows], "doc_id long, text string")
    assert rows_of(M.groups(docs)) == plain([(int(i), t) for i, t in rows])


def set_table(spark, sets):
    return spark.createDataFrame([(i, [int(x) for x in s.view(np.int64)], M.odd_sketch(s).tolist()) for i, s in sets],
                                 "node long, shingles array<long>, sketch array<long>")


def test_open_buckets_are_compared_across_components(spark):
    """A bucket whose centre is like no other: the star confirms nothing, and the open pairs hold the link."""
    sets = {1: range(0, 100), 2: range(50, 150), 3: range(52, 152), 4: range(400, 500)}
    held = set_table(spark, [(n, np.unique(M.mixed(np.array(x, np.uint64)))) for n, x in sets.items()])
    members = spark.createDataFrame([(9, 1), (9, 2), (9, 3), (8, 4), (8, 1)], "bucket long, node long")
    none = spark.createDataFrame([], "node long, root long")
    found = M.confirmed(M.open_pairs(members, none, held, 80), held, 80).collect()
    assert [(r.a, r.b) for r in found] == [(3, 2)]
    joined = spark.createDataFrame([(2, 2), (3, 2)], "node long, root long")
    assert M.open_pairs(members, joined, held, 80).count() == 0


@pytest.mark.parametrize("percent, part", [(80, 500), (80, 7), (55, 7)])
def test_open_pairs_lose_nothing(spark, monkeypatch, percent, part):
    """One bucket of many unlinked members, cut into parts or not: every pair that is alike is offered."""
    monkeypatch.setattr(M, "PART", part)
    rng = np.random.default_rng(8)
    held = M.shingle_sets(families(rng, [30, 30], 30) + families(rng, [10] * 5, 7) + families(rng, [6], 3000))
    members = spark.createDataFrame([(1, i) for i in range(len(held))], "bucket long, node long")
    half = [(i, 0) for i in range(0, len(held), 2)] if part == 7 else []  # a component of every other set, or none
    none = spark.createDataFrame(half, "node long, root long")
    pairs_ = M.open_pairs(members, none, set_table(spark, enumerate(held)), percent).collect()
    got = {(r.a, r.b) for r in pairs_}
    want = set()
    for i, x in enumerate(held):
        for j in range(i):
            both = len(np.intersect1d(x, held[j]))
            if 100 * both >= percent * (len(x) + len(held[j]) - both) and not (half and i % 2 == j % 2 == 0):
                want.add((i, j))
    assert want and want <= got and len(got) == len(pairs_) < len(held) ** 2 / 4


def test_hot_groups(spark, monkeypatch):
    """A third of the rows are one text, a third near copies of it: dealt in parts, every row gets its group once."""
    from retailops.llm import simhash
    monkeypatch.setattr(simhash, "PART_ROWS", 5)
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(i, base if i % 3 == 0 else f"{base} tail{i % 50}" if i % 3 == 1 else f"a text {i * i} of its own {i}") for i in range(300)]
    rows += [(None, base)] * 30 + [(5, rows[5][1])] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(M.groups(docs)) == plain(rows)


def test_densified_bins_agree_as_often_as_the_sets_are_alike():
    rng = np.random.default_rng(9)
    for n, same in ((5, 4), (40, 30), (3000, 2400)):
        hit = tries = 0
        for _ in range(40):
            h = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            a, b = np.unique(h[:n]), np.unique(np.concatenate((h[:same], h[n:2 * n - same])))
            hit += int((M.signature(a, 160) == M.signature(b, 160)).sum())
            tries += 160
        assert abs(hit / tries - same / (2 * n - same)) < 0.05
    assert len(set(M.signature(np.uint64([77]), 160).tolist())) == 1
