import zlib
from hashlib import sha256

import pytest

from retailops.llm import merkle as M
from retailops.llm.common import documents

from .cases import SF, empty_documents, odd_documents


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = [None if v is None else str(v) for v in (row.doc_id, row.source, row.lang, row.n_chars, text)]
    return h(*["-" if v is None else f"{len(v.encode())}:{v}" for v in fields])


def tree(nodes):
    """(top, siblings of each node from the bottom up, as lists per level with the node's place)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            a = p - p % 3
            paths[i].append((nodes[a:p], nodes[p + 1:a + 3]))
            at[i] = p // 3
        nodes = [h(*nodes[a:a + 3]) for a in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain(rows):
    by = {}
    for r in rows:
        text = r.text
        if text is not None and zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 2 == 0:
            text = text.replace("\n", "")
        by.setdefault(r.source, []).append((r.doc_id, leaf(r, r.text), leaf(r, text)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        built[s] = tree([x[1] for x in by[s]])
    root, tops = tree([built[s][0] for s in order]) if order else (None, [])
    out = []
    for s, top in zip(order, tops):
        for (doc_id, original, tampered), path in zip(by[s], built[s][1]):
            now = tampered
            for left, right in path + top:
                now = h(*left, now, *right)
            proof = h(*[x for left, right in path + top for x in left + right])
            out.append((str(doc_id), original, built[s][0], root, proof, now, now == root))
    return sorted(out)


def rows_of(df):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_sf_equals_plain(spark, monkeypatch, levels):
    monkeypatch.setattr(M, "LEVELS", levels)
    docs = documents(spark, SF)
    got = rows_of(M.report(docs))
    assert got == plain(docs.collect()) and 0 < sum(r[-1] for r in got) < len(got)


def test_hot_source_nulls_repeats_and_lone_sources(spark, monkeypatch):
    """Half of all rows in one source, a NULL source, empty source, sources of one row, repeated rows and NULL fields."""
    monkeypatch.setattr(M, "LEVELS", 2)
    rows = [(i, "hot", "en", i, f"text\n{i}") for i in range(120)]
    rows += [(i, None if i % 3 else "", None, None, None if i % 2 else "a\nb") for i in range(120, 140)]
    rows += [(7, "hot", "en", 7, "text\n7")] * 30 + [(None, "hot", "en", 1, f"n{i % 3}\n") for i in range(9)]
    rows += [(200 + i, f"site{i}é", "de", 3, "x") for i in range(11)]
    docs = table(spark, rows).repartition(5)
    assert rows_of(M.report(docs)) == plain(docs.collect())


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10])
def test_small_trees(spark, n):
    docs = table(spark, [(i, "one", "en", 1, f"a\n{i}") for i in range(n)])
    assert rows_of(M.report(docs)) == plain(docs.collect())


def test_every_source_has_one_row(spark):
    docs = table(spark, [(i, f"s{i}", "en", 1, f"a\n{i}") for i in range(8)])
    assert rows_of(M.report(docs)) == plain(docs.collect())


def test_odd_and_empty(spark):
    docs = odd_documents(spark).withColumn("n_chars", M.F.lit(5).cast("long"))
    docs = docs.withColumn("tree", M.F.lit("x")).withColumn("rank", M.F.lit("x")).withColumn("branch", M.F.lit("x"))
    assert rows_of(M.report(docs)) == plain(docs.collect())
    empty = M.report(docs.limit(0))
    assert empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and not empty.count()


def test_only_asked_leaves_descend(spark, monkeypatch):
    """A request for some leaves gives their proofs alone, and each proof folds to the root."""
    monkeypatch.setattr(M, "LEVELS", 2)
    made = M.manifest(table(spark, [(i, f"s{i % 2}", "en", 1, f"t{i}") for i in range(100)]))
    asked = made["leaves"].filter("doc_id in (0, 1, 50, 99)")
    got = M.proofs(made, asked, ["doc_id", "leaf", "n", "trees"]).collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 50, 99]
    for r in got:
        assert r.digest == r.leaf and r.root == made["root"].first().digest
        assert M.folded_up(r.path, r.leaf, ((r["rank"], r.n), (r.tree, r.trees))) == r.root
        assert M.folded_up(r.path, r.leaf[::-1], ((r["rank"], r.n), (r.tree, r.trees))) != r.root
