import re

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from retailops.llm import simhash as M
from retailops.llm.common import documents

from .cases import SF, empty_documents, odd_documents


def plain_fingerprint(text, words=3):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    sh = [" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps, radius=3):
    fps = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= radius) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("make", [odd_documents, lambda s: documents(s, SF)])
def test_components(spark, make):
    docs = make(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    fps = [plain_fingerprint(t) for _, t in rows]
    groups = plain_groups(fps)
    least = {}
    for (i, _), g in zip(rows, groups):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = sorted((str(i), f"{f:016x}", str(least.get(g))) for (i, _), f, g in zip(rows, fps, groups))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in M.component_ids(docs).collect())
    assert got == want
    kept = M.keep_one(docs)
    assert kept.columns == docs.columns
    left = kept.collect()
    assert len(left) == len(set(groups))
    assert {r.doc_id for r in left if r.doc_id is not None} == set(least.values())


def test_empty(spark):
    assert M.component_ids(empty_documents(spark)).count() == 0
    assert M.keep_one(empty_documents(spark)).count() == 0


def clustered(rng, n):
    base = rng.integers(0, 1 << 63, n // 10, dtype=np.uint64) * np.uint64(2)
    out = []
    for _ in range(n):
        f = int(rng.choice(base))
        for b in rng.integers(0, 64, rng.integers(0, 4)):
            f ^= 1 << int(b)
        out.append(f)
    return np.unique(np.array(out, np.uint64))


def test_tree_finds_all_within_radius():
    rng = np.random.default_rng(1)
    fps = clustered(rng, 2000)
    q = clustered(rng, 300)
    got = {(a, b) for x, y in M.Tree(fps).within(q, 3) for a, b in zip(x.tolist(), y.tolist())}
    d = np.bitwise_count(q[:, None] ^ fps[None, :])
    assert got == set(zip(*(x.tolist() for x in np.nonzero(d <= 3))))


@pytest.mark.parametrize("hot", [10_000, 7])
def test_links_connect_what_brute_force_connects(spark, hot):
    """With shards split into parts of 7 or not split at all, chains and clusters come out whole."""
    rng = np.random.default_rng(2)
    chain, f = [], 12345
    for b in range(64):  # a chain: each differs from the last by one bit, the ends by 64
        f ^= 1 << b
        chain.append(f)
    dense = [int(x) for x in (np.uint64(1) << np.arange(64, dtype=np.uint64)) ^ np.uint64(0xABCDEF)]
    fps = sorted({*clustered(rng, 400).tolist(), *chain, *dense, 0, 1})
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    edges = M.links(df, 3, hot)
    assert edges.count() < 64 * len(fps)
    roots = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in M.components(edges).collect()}
    groups = plain_groups(fps)
    got, want = {}, {}
    for f, g in zip(fps, groups):
        want.setdefault(g, set()).add(f)
        got.setdefault(roots.get(f, f), set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_hot_groups_are_dealt_in_parts(spark, monkeypatch):
    """A third of all rows hold one text, another part near copies of it: every row still gets its component once."""
    monkeypatch.setattr(M, "PART_ROWS", 5)
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(i, base if i % 3 == 0 else f"{base} tail{i % 40}" if i % 3 == 1 else f"text {i * i} of its own {i}") for i in range(300)]
    rows += [(None, base)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fps = [plain_fingerprint(t) for _, t in rows]
    least = {}
    for (i, _), g in zip(rows, roots := plain_groups(fps)):
        least[g] = i if g not in least else min(least[g], i) if i is not None else least[g]
    assert max(roots.count(g) for g in least) > 100
    want = sorted((str(i), f"{f:016x}", str(least[g])) for (i, _), f, g in zip(rows, fps, roots))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in M.component_ids(docs).collect()) == want


def test_components_run_few_tasks(spark):
    """Every task leaves shuffle files and a part file: a round takes five exchanges, told once for edges that go both ways."""
    spark.sparkContext.setJobGroup("components", "a chain")
    try:
        chain = spark.range(1, 40).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
        roots = M.components(chain.repartition(4, "a")).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {(r.node, r.root) for r in roots} == {(i, 0) for i in range(1, 40)}
    jobs, tell = spark.sparkContext.statusTracker().getJobIdsForGroup("components"), spark.sparkContext.statusTracker()
    stages = {i for job in jobs for i in tell.getJobInfo(job).stageIds}
    tasks = sum(x.numCompletedTasks for x in map(tell.getStageInfo, stages) if x)
    assert tasks < 80, tasks  # 111 with a union, a count and one exchange more in each round
