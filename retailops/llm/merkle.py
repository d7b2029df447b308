"""Merkle manifest of a table: content-addressed records, and inclusion proofs by descent from the root.

Tree.  A row is a leaf: the SHA-256 of its fields, each ``-`` if NULL, else its UTF-8 byte count, a colon and its value.
The leaves of a source ascend by doc_id; runs of ``FAN`` consecutive nodes become the hash of their concatenated hex
digests, until one node, the subroot, is left.  The subroots, by source, are the leaves of one more tree of the same shape,
whose last node is the root.

Method.  The manifest is a store of records, each from a digest to the digests of its children.  Records are kept in pages:
a page holds the records of up to ``LEVELS`` levels below the digest that names it, so that one join brings a request
down that many levels.  A request for a leaf is its tree and rank.  It starts at the root and at each level takes the
digit of its rank (base ``FAN``) to choose a child, collecting the children it does not choose.  Requests that share a path
go down together: above the last page they are the distinct prefixes of the asked ranks, so a path is only ever shuffled
once per page, never once per leaf.  The segments collected on the way down are reversed into the order of the
proof, from the leaf up; folding them with a leaf gives a root that either equals the manifest's or does not.

Scale.  Ranks come from a range exchange by (source, doc_id, leaf, a drawn number), stored, then numbers inside each range and counts
per source and range, so a source with a third of all rows is cut over many tasks; equal rows too.  Building takes one
shuffle of digests per ``LEVELS`` levels, each ``FAN ** LEVELS`` times smaller than the last.  Texts are only hashed
where they are read.

Defined results: NULL fields are leaves like others; NULL doc_ids stand first, equal doc_ids are ordered by their leaf;
repeated rows each are a leaf; a source of one row has that leaf as its subroot; an empty table has no rows and no root; the
crc32 of a NULL doc_id is 0, so its text is tampered with; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

FAN = 3
LEVELS = 4  # levels in one page: at most FAN ** LEVELS digests at its foot
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TRIED = "tree long, start binary, proof binary, folded binary"
RECORDS = "array<struct<digest:binary,children:array<binary>>>"


def digest(*fields: Column) -> Column:
    """The leaf digest (binary) of the fields in their order."""
    parts = []
    for f in fields:
        s = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def parent(children: Sequence[bytes]) -> bytes:
    return sha256("".join(c.hex() for c in children).encode()).digest()


def height(n: int) -> int:
    """Levels above the leaves of a tree with ``n`` leaves."""
    h, reach = 0, 1
    while reach < n:
        h, reach = h + 1, reach * FAN
    return h


def each(batch: pa.RecordBatch):
    """The rows of a batch as dicts, one at a time: a page is some thousand objects."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def folded_up(path: Sequence[bytes], node: bytes, places: Sequence[tuple[int, int]]) -> bytes:
    """The root that ``node`` gives with the siblings of its path, at its (rank, leaves) in its tree and then in the trees above."""
    at = 0
    for place, size in places:
        while size > 1:
            digit = place % FAN
            others = min(FAN, size - (place - digit)) - 1
            node = parent([*path[at:at + digit], node, *path[at + digit:at + others]])
            at, place, size = at + others, place // FAN, -(-size // FAN)
    return node


def in_ranges(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` (a stored table) cut into ranges of ``keys``, NULL first; equal keys are spread by a drawn number.  Stored, with ``range`` and ``draw``."""
    cut = rows.withColumn("draw", F.rand(7)).repartitionByRange(*keys, "draw")
    return stored(cut.withColumn("range", F.spark_partition_id()))


def offsets(cut: DataFrame, tree: str) -> DataFrame:
    """(tree, range, before, n): rows of the tree in earlier ranges, and in all."""
    whole = Window.partitionBy(tree)  # a tree has at most one row per range here
    before = F.sum("held").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    return cut.groupBy(tree, "range").agg(F.count("*").alias("held")).select(
        tree, "range", F.coalesce(before, F.lit(0)).alias("before"), F.sum("held").over(whole).alias("n"))


def numbered(cut: DataFrame, counts: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """``cut`` with the columns of ``counts`` and ``rank``, from 0 within its tree; no window holds more than one range.  Stored."""
    place = F.row_number().over(Window.partitionBy(tree, "range").orderBy(*order, "draw")) - 1
    out = cut.withColumn("inside", place).join(counts, [tree, "range"])
    return stored(out.withColumn("rank", F.col("before") + F.col("inside")).drop("before", "inside", "range", "draw"))


def pages(nodes: DataFrame) -> DataFrame:
    """One round of building: nodes (tree, n, base, at, digest) at height ``base`` become pages (digest, tree, n, base, at, records), where ``at`` is
    the place of the digest at its height."""
    span = FAN ** LEVELS
    runs = nodes.groupBy("tree", "n", "base", F.expr(f"at div {span}").alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("foot"))  # at most ``span`` digests

    def run(batches):
        for batch in batches:
            out = []
            for r in each(batch):
                level, top, records = [x["digest"] for x in r["foot"]], min(r["base"] + LEVELS, height(r["n"])), {}
                for _ in range(r["base"], top):
                    groups = [level[i:i + FAN] for i in range(0, len(level), FAN)]
                    level = [parent(g) for g in groups]
                    records.update(zip(level, groups))
                out.append({"digest": level[0], "tree": r["tree"], "n": r["n"], "base": top, "at": r["page"],
                            "records": [{"digest": d, "children": c} for d, c in records.items()]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("digest", pa.binary()), ("tree", pa.int64()), ("n", pa.int64()), ("base", pa.int32()), ("at", pa.int64()),
                        ("records", pa.list_(pa.struct([("digest", pa.binary()), ("children", pa.list_(pa.binary()))])))])
    return runs.mapInArrow(run, f"digest binary, tree long, n long, base int, at long, records {RECORDS}")


def build(leaves: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(store, tops) of leaves (tree long, n, rank, digest): the store has a page per row (digest, records), one of equal ones;
    tops are (tree, n, digest)."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    now = leaves.select("tree", F.col("n").cast("long").alias("n"), F.lit(0).alias("base"), F.col("rank").alias("at"), "digest")
    tops, stores = now.filter("n = 1"), []
    for base in range(0, height(most), LEVELS):
        made = stored(pages(now.filter(F.col("n") > FAN ** base)))
        stores.append(made.select("digest", "records"))
        now = made.select("tree", "n", "base", "at", "digest")
        tops = tops.union(now.filter(F.col("n") <= F.pow(F.lit(FAN), F.col("base"))))
    if not stores:
        return None, tops.select("tree", "n", "digest")
    store = stores[0]
    for s in stores[1:]:
        store = store.union(s)
    return stored(store.groupBy("digest").agg(F.first("records").alias("records"))), stored(tops.select("tree", "n", "digest"))


def tests(kind, tested: str, tree, n, start, paths, requests) -> pa.RecordBatch:
    """What the paths say of the tested digests: (tree, start, proof, folded, request)."""
    folded = [folded_up(p, q[tested], ((q["rank"], size), (t, q["trees"]))) for p, q, size, t in zip(paths, requests, n, tree)]
    return pa.RecordBatch.from_arrays([
        pa.array(tree, pa.int64()), pa.array(start, pa.binary()), pa.array([parent(p) for p in paths], pa.binary()),
        pa.array(folded, pa.binary()), pa.array(requests, kind)], ["tree", "start", "proof", "folded", "request"])


def tested_lone(rest: DataFrame, payload: Sequence[str], tested: str) -> DataFrame:
    """(tree, rank, start, proof, folded, *payload) of leaves that are their tree's only node."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            tree, start, path, request = ([r[c] for r in rows] for c in ("tree", "start", "path", "request"))
            yield tests(batch.schema.field("request").type, tested, tree, [1] * len(rows), start, path, request)

    rows = rest.select("tree", "start", "path", F.struct("rank", *payload).alias("request"))
    told = rows.mapInArrow(run, f"{TRIED}, request {rows.schema['request'].dataType.simpleString()}")
    return told.select("tree", "request.rank", "start", "proof", "folded", *[f"request.{c}" for c in payload])


def descend(store: DataFrame | None, starts: DataFrame, asked: DataFrame, payload: Sequence[str], tested: str = "") -> DataFrame:
    """(tree, rank, start, digest, path, *payload) of the asked leaves: their digest, and the proof path from the leaf up.

    With ``tested``, a column of the payload (which also has ``trees``), (tree, rank, start, proof, folded, *payload) instead: the hash of
    the path, and the root that the digest in that column gives with it.

    ``starts``: (tree, n, digest, path), a tree's last node and the path above it, from the leaf up; ``asked``: (tree, n, rank,
    *payload), distinct ranks.  A page is brought to the requests that pass it by a join on its digest.
    """
    most = starts.agg(F.max("n")).first()[0] or 0
    width, out = FAN ** LEVELS, ["tree", "rank", "start", "digest", "path"]
    state = starts.select("tree", F.col("n").cast("long").alias("n"), F.lit(0).cast("long").alias("at"),
                          F.col("digest").alias("start"), "digest", "path")
    for base in reversed(range(0, height(most), LEVELS)):
        # where the requests that pass this height enter it (at) and leave it (place)
        at, place = (F.expr(f"rank div {width ** (base // LEVELS + up)}") for up in (1, 0))
        deep = asked.filter(F.col("n") > FAN ** base)
        if base:
            steps = deep.select("tree", at.alias("at"), place.alias("rank")).distinct()
            steps = steps.groupBy("tree", "at").agg(F.collect_list(F.struct("rank")).alias("requests"))  # at most ``width``
        else:
            steps = deep.groupBy("tree", at.alias("at")).agg(F.collect_list(F.struct("rank", *payload)).alias("requests"))
        met = state.filter(F.col("n") > FAN ** base).join(store, "digest").join(steps, ["tree", "at"])

        def run(batches, base=base):
            for batch in batches:
                kind = batch.schema.field("requests").type.value_type
                for r in each(batch):
                    records = {x["digest"]: x["children"] for x in r["records"]}
                    ends, paths = [], []
                    for request in r["requests"]:
                        node, segments = r["digest"], [r["path"]]
                        for level in range(min(height(r["n"]) - base, LEVELS) - 1, -1, -1):
                            digit = request["rank"] // FAN ** level % FAN
                            children = records[node]
                            segments.append(children[:digit] + children[digit + 1:])
                            node = children[digit]
                        ends.append(node)
                        paths.append([x for s in reversed(segments) for x in s])
                    many = len(ends)
                    if tested and not base:
                        yield tests(kind, tested, [r["tree"]] * many, [r["n"]] * many, [r["start"]] * many, paths, r["requests"])
                        continue
                    yield pa.RecordBatch.from_arrays([
                        pa.array([r["tree"]] * many, pa.int64()), pa.array([r["n"]] * many, pa.int64()),
                        pa.array([r["start"]] * many, pa.binary()), pa.array(ends, pa.binary()),
                        pa.array(paths, pa.list_(pa.binary())), pa.array(r["requests"], kind)],
                        ["tree", "n", "start", "digest", "path", "request"])

        request = met.schema["requests"].dataType.elementType.simpleString()
        tried = f"{TRIED}, request {request}"
        went = met.select("tree", "n", "start", "digest", "path", "records", "requests").mapInArrow(
            run, tried if tested and not base else f"tree long, n long, start binary, digest binary, path array<binary>, request {request}")
        if not base:
            rest = state.filter("n = 1").drop("n", "at").join(asked.filter("n = 1"), "tree")
            one = tested_lone(rest, payload, tested) if tested else rest.select(*out, *payload)
            shown = ["proof", "folded"] if tested else ["digest", "path"]
            return went.select("tree", "request.rank", "start", *shown, *[f"request.{c}" for c in payload]).union(one)
        state = stored(went.select("tree", "n", F.col("request.rank").alias("at"), "start", "digest", "path").union(
            state.filter(F.col("n") <= FAN ** base)))
    rest = state.drop("n", "at").join(asked, "tree")  # no tree has two nodes
    return tested_lone(rest, payload, tested) if tested else rest.select(*out, *payload)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, extra: Sequence[Column] = ()) -> dict[str, DataFrame | None]:
    """The manifest of ``docs``: ``leaves`` (doc_id, leaf, tree, rank, n, trees, *extra), the page stores ``store`` and
    ``top_store`` (None where no tree has two nodes), ``subroots`` (tree, n, digest, trees) and ``root`` (tree, n, digest; no row for an empty table)."""
    branch = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("branch")  # NULL stands first
    cut = in_ranges(stored(docs.select(branch, "doc_id", digest(*map(F.col, fields)).alias("leaf"), *extra)), ["branch", "doc_id", "leaf"])
    counts = stored(offsets(cut, "branch"))
    names = in_ranges(stored(counts.select("branch").distinct().withColumn("all", F.lit(0))), ["all", "branch"])
    names = numbered(names, offsets(names, "all"), "all", ["branch"]).select(
        "branch", F.col("rank").alias("tree"), F.col("n").alias("trees"))
    leaves = numbered(cut, counts.join(names, "branch"), "branch", ["doc_id", "leaf"]).drop("branch")
    store, subroots = build(leaves.select("tree", "n", "rank", F.col("leaf").alias("digest")))
    trees = leaves.filter("rank = 0").select("tree", "trees")
    subroots = stored(subroots.join(trees, "tree").withColumn("top", F.lit(0).cast("long")))  # one tree of subroots, number 0
    top_store, root = build(subroots.select(F.col("top").alias("tree"), F.col("trees").alias("n"), F.col("tree").alias("rank"), "digest"))
    return {"leaves": leaves, "store": store, "top_store": top_store, "subroots": subroots, "root": root}


def proofs(made: dict[str, DataFrame | None], asked: DataFrame, payload: Sequence[str], tested: str = "") -> DataFrame:
    """(tree, rank, digest, path, subroot, root, *payload) of asked leaves (tree, n, rank, *payload) of a manifest, or, with
    ``tested``, their ``proof`` and ``folded`` root (``descend``) in place of digest and path."""
    none = F.array().cast("array<binary>").alias("path")
    top = made["subroots"].select(F.col("top").alias("tree"), F.col("trees").alias("n"), F.col("tree").alias("rank"),
                                  F.col("n").alias("leaves"))
    subs = stored(descend(made["top_store"], made["root"].select("tree", "n", "digest", none), top, ["leaves"]))
    starts = subs.select(F.col("rank").alias("tree"), F.col("leaves").alias("n"), "digest", "path")
    root = made["root"].select("digest").first()  # one row
    found = descend(made["store"], starts, asked, payload, tested).withColumnRenamed("start", "subroot")
    return found.withColumn("root", F.lit(bytes(root[0]) if root else None).cast("binary"))


def report(docs: DataFrame, every: int = 2) -> DataFrame:
    """Leaves, roots and proofs of all documents, checked against a copy in which, where ``every`` divides the crc32 of the doc_id,
    the line feeds of the text are gone."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % every == 0
    changed = digest(*[F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text")) if f == "text" else F.col(f)
                       for f in FIELDS])
    made = manifest(docs, extra=[changed.alias("tampered")])
    payload = ["doc_id", "leaf", "tampered", "n", "trees"]
    found = proofs(made, made["leaves"], payload, "tampered")
    text = [F.lower(F.hex(c)).alias(a) for c, a in (("leaf", "leaf"), ("subroot", "subroot"), ("root", "root"), ("proof", "proof_sha256"),
                                                    ("folded", "folded_root"))]
    return found.select("doc_id", *text, (F.col("folded") == F.col("root")).alias("verified"))
