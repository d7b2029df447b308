"""Secret scan, quality rules and shards against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from retailops.llm import quality_rules as Q
from retailops.llm import secrets as S
from retailops.llm import shards as H
from retailops.llm.common import documents

from .cases import SF, empty_documents, odd_documents

MAKES = [odd_documents, lambda s: documents(s, SF)]
KEYWORD = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
                   for w in ("password", "passwd", "secret", "token", "api_?key")).replace("_[?]", "_?")
KINDS = [("assign", re.compile(rf"({KEYWORD})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 6),
         ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
         ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
MORE = [(r.kind, re.compile(r.pattern), lambda m: True) for r in S.MORE]


def plain_spans(text, kinds):
    found = [(m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(kinds) for m in p.finditer(text) if ok(m)]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found)), Counter(k for _, _, k, _ in found)


@pytest.mark.parametrize("make", MAKES)
def test_secrets(spark, make):
    docs = make(spark)
    want = []
    for r in docs.collect():
        t = r.text or ""
        base, n = plain_spans(t, KINDS)
        want.append((str(r.doc_id), n["assign"], n["access"], n["hex"], hashlib.sha256(base.encode()).hexdigest(),
                     plain_spans(t, KINDS + MORE)[0]))
    assert sorted((str(r[0]), *r[1:]) for r in S.report(docs).collect()) == sorted(want)
    assert make is not odd_documents or any(w[5] for w in want)


def test_long_runs_and_dense_spans_are_linear(spark):
    """1 MB of a rule's beginning, and 64,000 spans in one text: each well under the time that a square would take."""
    import time
    docs = spark.createDataFrame([(1, "eyJ" * 350_000)], "doc_id long, text string")
    dense = spark.createDataFrame([(2, "token=abcdefgh " * 64_000)], "doc_id long, text string")
    S.report(docs.selectExpr("doc_id", "substring(text, 1, 9) as text")).collect()  # compiled
    for df, n in ((docs, 0), (dense, 64_000)):
        start = time.time()
        assert S.report(df).first().n_assign == n
        assert time.time() - start < 30


def test_jwt_is_found_at_word_starts(spark):
    part = "eyJ" + "a" * 12
    docs = spark.createDataFrame([(1, f"x {part}.{part}.{part} {part}.{part}")], "doc_id long, text string")
    assert [tuple(x) for x in S.find(docs).first().spans_jwt] == [("jwt", 2, 49)]


def test_secrets_empty(spark):
    assert S.report(empty_documents(spark)).count() == 0


def test_trigram_queries():
    assert S.trigram_query("abcd") == [frozenset({"abc", "bcd"})]
    assert S.trigram_query("[0-9a-f]{24,}") is None
    assert S.trigram_query("(?i:foo|BARS)x?") == [frozenset({"foo"}), frozenset({"bar", "ars"})]
    assert set(S.trigram_query("ab?cde")) == {frozenset({"acd", "cde"}), frozenset({"abc", "bcd", "cde"})}
    assert S.trigram_query("(abc)?") is None
    assert S.trigram_query("gh[pq]_z+") == [frozenset({"ghp", "hp_", "p_z"}), frozenset({"ghq", "hq_", "q_z"})]


def test_trigram_queries_hold_for_matches():
    """Any text that a rule matches satisfies its query."""
    texts = ["pAssWord=abcdefg", "API_KEY: x", "apikey='q", "AKIA" + "Z" * 16, "ghs_" + "a" * 36, "xoxb-0123456789",
             "-----BEGIN RSA PRIVATE KEY-----", "sk_live_" + "0" * 16, "AIza" + "b" * 35, "eyJ" + "a" * 10 + ".b" * 1 + "c" * 9 + "." + "d" * 10]
    for t, r in itertools.product(texts, S.BASE + S.MORE):
        q = S.trigram_query(r.pattern)
        if re.search(r.pattern, t) and q:
            assert any(all(g in t.lower() for g in way) for way in q), (t, r.kind)


def plain_features(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = Counter(zip(w, w[1:], w[2:]))
    cover = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if win[x] > 1 for j in (i, i + 1, i + 2)}
    solid = "".join(w)
    return len(w), len(solid), sum(c in "#*$%&|<>" for c in solid), len(lines) - len(set(lines)), len(cover)


@pytest.mark.parametrize("make", MAKES)
def test_rule_counts(spark, make):
    docs = make(spark)
    want = []
    for r in docs.collect():
        f = plain_features(r.text)
        want.append((str(r.doc_id), *f, f[0] < 50 or 100 * f[4] > 50 * f[0]))
    rows = Q.verdicts(docs).collect()
    assert sorted((str(r[0]), *r[1:7]) for r in rows) == sorted(want)
    assert not any(r.kept and r.base_failed for r in rows)


def test_em_finds_planted_rates():
    """Rules of known rates on a known mixture: EM recovers the rates and the classes without the classes."""
    rnd = random.Random(5)
    truth, seen, right = [(0.02, 0.7), (0.05, 0.8), (0.03, 0.6), (0.10, 0.9), (0.01, 0.5)], Counter(), []
    for _ in range(20000):
        bad = rnd.random() < 0.15
        votes = tuple(-1 if rnd.random() < t[bad] else 1 for t in truth)
        seen[votes] += 1
        right.append((votes, bad))
    good, rates = Q.estimate(sorted(seen.items()), 5)
    assert all(abs(r[0] - t[0]) < 0.03 and abs(r[1] - t[1]) < 0.06 for r, t in zip(rates, truth))
    assert sum((Q.posterior(v, good, rates) < 0.5) == b for v, b in right) > 0.96 * len(right)


def test_rules_agree_with_labels(spark):
    sf = SF.replace("0.001", "0.1")
    rows = Q.verdicts(documents(spark, sf)).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    free = [r for r in rows if not r.base_failed]
    assert sum(r.kept for r in free if r.quality == 1) >= 0.98 * sum(r.quality == 1 for r in free)
    assert sum(not r.kept for r in free if r.quality == 0) >= 0.8 * sum(r.quality == 0 for r in free)


def test_rules_empty(spark):
    assert Q.verdicts(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("make", MAKES)
def test_shards(spark, make):
    docs = make(spark).repartition(5)
    rows = H.shuffle_shards(docs).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(
        (str(r.doc_id), len(b := (r.text or "").encode()) + 1, zlib.crc32(b)) for r in docs.collect())
    by = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(16)}
    assert sum(map(len, by.values())) == len(rows)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(v == list(range(len(v))) for v in by.values())
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}


def test_shards_empty(spark):
    assert H.shuffle_shards(empty_documents(spark)).count() == 0


def test_hypergeometric_law():
    rng = random.Random(1)
    got = Counter(H.hypergeometric(rng, 6, 9, 5) for _ in range(30000))
    from math import comb
    for k in range(6):
        assert abs(got[k] / 30000 - comb(6, k) * comb(9, 5 - k) / comb(15, 5)) < 0.01
    m = H.communication_matrix([5, 0, 17, 1000, 3], 16, 3)
    assert [sum(x) for x in m] == [5, 0, 17, 1000, 3]
    assert {sum(c) for c in zip(*m)} <= {64, 65}


def test_buckets_hold_many_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "BUCKET", 10)
    rows = H.shuffle_shards(spark.range(5000).selectExpr("id as doc_id", "'t' as text").repartition(7)).collect()
    by = Counter(r.shard for r in rows)
    assert set(by.values()) <= {312, 313} and len({(r.shard, r.slot) for r in rows}) == 5000
