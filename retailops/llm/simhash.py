"""SimHash near-duplicates: fingerprints of word shingles, linked through BK-trees, grouped into components.

Method.  Words are the runs between ASCII white space of the text with A-Z in lower case; a shingle is ``words`` of them
joined by a space (a shorter text is one shingle).  The hash of a shingle is XXH64 with seed 42; a bit of the
fingerprint is 1 if more than half of the hashes have it.  A text without words has fingerprint 0.  Fingerprints within
``radius`` bits are linked, and the smallest doc_id that links reach names the component.

Finding links.  Equal fingerprints are one node.  The 64 bits are cut into ``radius + 2`` blocks; fingerprints within the
radius agree on at least two blocks in full, so each node is sent to one shard per pair of blocks, named by the bits of
that pair.  The members of a shard build a BK-tree (children keyed by the integer Hamming distance to their parent) and
search it, following only edges within the radius of the distance just measured.  Nothing is missed, whatever the data.
Shards above ``HOT`` members are split: every part builds its own tree and every member searches the trees of all parts,
in separate tasks, so no task holds a hot shard.  A shard's own links leave it as a spanning forest: one row per member
and tree at most, never a row per pair.

Components.  Alternating large-star and small-star rounds over the stored links, until nothing changes.  Links,
components and fingerprints stay in Spark tables; only counts reach the driver.  Rows are counted per fingerprint before
they meet their component, and those of a hot fingerprint or component are dealt in parts (``join_spread``).

Defined results: NULL and empty texts have no words, so they are linked to each other; a NULL doc_id is ignored when the
smallest is taken, and a component with no id at all has NULL; repeated rows each give a row; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import row_key, stored, text_blocks, text_or_empty

SEED = 42
HOT = 2000
PART_ROWS, PARTS = 1000, 100_000  # a key with more rows than that, or than one row in PARTS of all, is dealt in parts
PAIRS = 1 << 20  # (query, node) pairs looked at together
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def fingerprint(text: str, words: int = 3) -> int:
    w = text.encode("utf-8", "surrogatepass").translate(LOWER).translate(_SPACES).split(b" ")
    w = [x for x in w if x] if b"" in w else w
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = np.concatenate(([0], ends[:-words])).tolist()
    stops = (ends[words - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones, n, step = np.zeros(64, np.int64), len(starts), 1 << 16
    for i in range(0, n, step):
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[i:i + step], stops[i:i + step])), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, fp): key identifies the row's id and text, fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            for start, stop, texts in text_blocks(batch, 2, 4 << 20):
                fp = np.fromiter((fingerprint(t, words) for t in texts), np.uint64, len(texts)).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start),
                                                  batch.column(1).slice(start, stop - start), pa.array(fp)], ["id", "key", "fp"])

    df = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), text_or_empty(text_col).alias("text"))
    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, key long, fp long")


class Tree:
    """BK-tree over distinct fingerprints, built and searched for many at a time.

    Node i has parent, distance to the parent, and its children as a range of ``order``, sorted by that distance.
    """

    def __init__(self, fps: np.ndarray):
        n = len(fps)
        self.fps = fps
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        at, todo = np.zeros(n, np.int64), np.arange(1, n)  # the node each newcomer stands at; the first is the root
        while len(todo):
            d = np.bitwise_count(fps[todo] ^ fps[at[todo]]).astype(np.int64)
            slot = at[todo] * 65 + d
            found, first = np.unique(slot, return_index=True)
            new = todo[first]  # the first newcomer at a free (node, distance) becomes its child
            parent[new], edge[new] = at[new], d[first]
            at[todo] = new[np.searchsorted(found, slot)]
            stay = np.ones(len(todo), bool)
            stay[first] = False
            todo = todo[stay]
        self.order = np.lexsort((edge, parent))[1:]  # the root's parent is -1 and stands first
        self.keys = parent[self.order] * 65 + edge[self.order]

    def within(self, queries: np.ndarray, radius: int):
        """Pairs (query number, node number) at most ``radius`` apart, in pieces."""
        step = max(1, PAIRS // max(1, len(self.fps)))
        for i in range(0, len(queries), step):
            q, node = np.arange(i, min(i + step, len(queries))), np.zeros(min(step, len(queries) - i), np.int64)
            while len(q):
                d = np.bitwise_count(queries[q] ^ self.fps[node]).astype(np.int64)
                hit = d <= radius
                if hit.any():
                    yield q[hit], node[hit]
                low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
                high = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), side="right")
                count = high - low
                q = np.repeat(q, count)
                ends = np.cumsum(count)
                node = self.order[np.arange(len(q)) + np.repeat(low - (ends - count), count)] if len(q) else q


def forest(n: int, links) -> np.ndarray:
    """Smallest member of the group of each of ``n`` nodes under the links (pieces of arrays a, b)."""
    root = np.arange(n)
    for a, b in links:
        while True:
            ra, rb = root[a], root[b]
            while (root[ra] != ra).any() or (root[rb] != rb).any():
                ra, rb = root[ra], root[rb]
            open_ = ra != rb
            if not open_.any():
                break
            a, b = a[open_], b[open_]
            np.minimum.at(root, np.maximum(ra[open_], rb[open_]), np.minimum(ra[open_], rb[open_]))
    while (root[root] != root).any():
        root = root[root]
    return root


def shard_links(members: np.ndarray, tree_of: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of one shard part: each member to the smallest member of every group of the tree's that it touches."""
    fps = np.unique(tree_of)
    tree = Tree(fps)
    mine = forest(len(fps), tree.within(fps, radius))
    linked = np.flatnonzero(mine != np.arange(len(fps)))
    out = [(fps[linked], fps[mine[linked]])]
    others = np.setdiff1d(members, fps)
    if len(others):
        met = [np.unique(a * len(fps) + mine[b]) for a, b in tree.within(others, radius)]
        if met:
            pair = np.unique(np.concatenate(met))
            out.append((others[pair // len(fps)], fps[pair % len(fps)]))
    return out


def links(nodes: DataFrame, radius: int = 3, hot: int | None = None) -> DataFrame:
    """(a, b) with a > b (as signed longs): links that connect all ``nodes`` (column fp, distinct) within the radius."""
    hot = hot or HOT
    blocks = radius + 2
    cut = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << cut[i + 1]) - 1) ^ ((1 << cut[i]) - 1) for i in range(blocks)]
    pairs = [masks[i] | masks[j] for i, j in combinations(range(blocks), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in pairs]
    dealt = nodes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(signed)])).alias("s"))
    dealt = dealt.select("fp", "s.t", "s.v")
    sizes = dealt.groupBy("t", "v").agg(F.count("*").alias("size")).filter("size > 1")
    dealt = dealt.join(sizes.hint("shuffle_hash"), ["t", "v"])
    parts = F.ceil(F.col("size") / hot).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    sent = dealt.select("t", "v", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    sent = sent.filter("part >= own").select("t", "v", "part", "fp", (F.col("own") == F.col("part")).alias("inside"))
    sent = sent.repartition("t", "v", "part").sortWithinPartitions("t", "v", "part")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table):
            t, v, part = (table.column(i).to_numpy() for i in range(3))
            fp, inside = table.column(3).to_numpy().view(np.uint64), table.column(4).to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (v[1:] != v[:-1]) | (part[1:] != part[:-1]), [True])))
            found = []
            small = np.diff(edges) == 2  # most shards: two members, one comparison
            x, y = edges[:-1][small], edges[:-1][small] + 1
            near = np.bitwise_count(fp[x] ^ fp[y]) <= radius
            found.append((fp[x[near]], fp[y[near]]))
            for a, b in zip(edges[:-1][~small].tolist(), edges[1:][~small].tolist()):
                if inside[a:b].any():
                    found += shard_links(np.unique(fp[a:b]), fp[a:b][inside[a:b]], radius)
            a, b = (np.concatenate([f[i] for f in found]).view(np.int64) for i in (0, 1))
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            pair = np.unique(np.stack((hi, lo), axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            n = table.num_rows
            last = [table.column(i)[n - 1].as_py() for i in range(3)]
            same = np.ones(n, bool)
            for i in range(3):
                same &= table.column(i).to_numpy() == last[i]
            first = n - int(np.argmin(same[::-1])) if not same.all() else 0
            if first:  # the last shard may go on in the next batch
                yield flush(table.slice(0, first))
                held = table.slice(first).combine_chunks().to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    return sent.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of the links; root is the smallest node reachable."""
    def stars(e: DataFrame, large: bool) -> DataFrame:
        # large star: every larger neighbour of u goes to the smallest around u; small star: every smaller one does.  Edges that
        # go both ways are told within a row: a union would run twice as many tasks, each with shuffle files of its own
        turned = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
        both = e.select(F.inline(F.array(F.struct("a", "b"), turned))) if large else e
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        near = both.join(least, "a")
        if large:
            return near.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        to_least = F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
        return near.select(F.inline(F.array(to_least, F.struct("a", F.col("m").alias("b"))))).filter("a != b")

    edges = stored(edges)
    before = None
    for _ in range(rounds):
        # a large star gives one row per edge, so only the small one's are made distinct; counted as they are stored
        seen, of_edges = Observation(), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        edges = stored(stars(stars(edges, True), False).distinct().observe(seen, F.count("*").alias("n"), of_edges.alias("h")))
        if seen.get == before:
            break
        before = seen.get
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def join_spread(rows: DataFrame, lookup: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """``rows`` (a stored table) with the columns of ``lookup`` (one row per key); a hot key is dealt over many tasks.

    ``sizes`` (key, n) counts the rows of each key.  Keys over the limit are cut into parts of that many rows, and their
    one row of ``lookup`` goes to every part.  At most ``PARTS`` keys can pass the limit, so they are broadcast.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    limit = max(PART_ROWS, total // PARTS)
    hot = F.broadcast(sizes.filter(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    # any part gives the same row; the draw is seeded and ``rows`` is stored, so a repeated task draws alike
    left = rows.join(hot, key, "left").withColumn("part", F.floor(F.rand(SEED) * parts)).drop("parts")
    right = lookup.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    return left.join(right, [key, "part"]).drop("part")


def groups(marked: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, n, id, first, root) per fingerprint of ``marked`` (id, key, fp): its rows, their smallest id, their first row
    as (no id, id, key), and the root that all fingerprints of a component share."""
    nodes = stored(marked.groupBy("fp").agg(
        F.count("*").alias("n"), F.min("id").alias("id"),
        F.min(F.struct(F.col("id").isNull().alias("x"), F.col("id"), F.col("key"))).alias("first")))
    roots = components(links(nodes.select("fp"), radius))
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def component_ids(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) per document."""
    marked = stored(fingerprints(docs, words, id_col, text_col).select("id", "key", "fp"))
    found = stored(groups(marked, radius).select("fp", "n", "id", "root"))
    least = found.groupBy("root").agg(F.min("id").alias("component_id"))
    named = join_spread(found.select("root", "fp"), least, "root", found.groupBy("root").agg(F.count("*").alias("n")))
    rows = join_spread(marked.select("id", "fp"), named.select("fp", "component_id"), "fp", found.select("fp", "n"))
    return rows.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id (without ids: the smallest key)."""
    found = groups(stored(fingerprints(docs, words, id_col, text_col)), radius)
    keep = found.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("key"))
    rows = docs.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("key"))
    return rows.join(keep.hint("shuffle_hash"), "key", "left_semi").dropDuplicates(["key"]).select("row.*")
