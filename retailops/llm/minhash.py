"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets and star-shaped candidate edges.

Sets.  Words are the runs between ASCII white space of the text with A-Z in lower case; a document's set holds its distinct shingles
of ``words`` words.  With fewer words the whole sequence is the one shingle; a text without words has the empty set and is
linked with nothing.  Documents are linked if ``100 * intersection >= percent * union``.

Method.  Each shingle is hashed once; the hash names one of ``bands * rows`` bins, and a bin keeps its smallest hash (one-permutation
hashing).  An empty bin takes the value of the first bin that is not empty among bins drawn for it alone, the same
draws for every document (optimal densification), so that it agrees between two sets with the probability of their
similarity, however small they are.  ``rows`` bins make a band, and documents that agree on a band share a bucket.  With 32 bands of 5
rows a pair at similarity 0.8 shares none with probability 3e-6 (0.672 ** 32), a closer pair more rarely still.

Candidates.  Equal sets are one node.  A bucket makes a star: every member is paired with its centre only, so edges never exceed
nodes times bands.  The centre is the member that meets most others over all its buckets, as the text that copies were made
from does.  Star edges are confirmed on the full sets.  A star loses a pair of which neither is the centre, when the centre is
not like both; that can only be where a bucket is left with members of more than one component.  Members of such
open buckets are compared across components by their odd sketches: bit i of a sketch is the parity of the shingles that hash to
i, so two sketches never differ in more bits than the sets in shingles, which bounds the intersection from above.
Only pairs within the bound leave the comparison, and they are confirmed as well, so every link that any bucket offers is kept.
The same bound spares star edges that cannot be links the full comparison.

Scale.  Texts are read twice: for the signatures, and, of candidates only, for the full sets, which travel once per edge.
Members are counted per bucket before they meet, and hot buckets, centres and groups of copies are dealt in parts
(``join_spread``); the members of an open bucket are compared in parts of ``PART``.  Links, sets
and components stay in stored tables.

Exactness.  Set sizes are exact.  Between documents shingles are compared by 64-bit hashes, sets by a 128-bit digest.

Defined results: NULL and empty texts have size 0 and are their own component; a NULL doc_id is ignored when the smallest is taken;
a component without any id has NULL, and its rows count as kept; repeated rows each give a row; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache
from hashlib import blake2b
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, stored, text_blocks, text_or_empty
from .simhash import components, join_spread

SEED = 13
SKETCH = 8  # 64-bit words of an odd sketch; a power of two
PART = 500  # members of an open bucket in one part
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on each other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], words: int = 2) -> list[np.ndarray]:
    """The set of each text as ascending 64-bit hashes of its distinct shingles."""
    number = defaultdict(count().__next__)  # of each distinct word among these texts
    runs = []
    for text in texts:
        w = text.encode("utf-8", "surrogatepass").translate(LOWER).split(b" ")
        runs.append(np.fromiter(map(number.__getitem__, filter(None, w)), np.int64))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in number), np.uint64, len(number))
    out = []
    for ids in runs:
        size = min(words, len(ids))
        if not size:
            out.append(np.empty(0, np.uint64))
            continue
        h = np.full(len(ids) - size + 1, size, np.uint64)  # shingles of other lengths differ
        for i in range(size):
            h = mixed(h + hashes[ids[i:len(ids) - size + 1 + i]])
        out.append(np.unique(h))
    return out


@lru_cache(maxsize=4096)
def draws(attempt: int, bins: int) -> np.ndarray:
    """For every bin the bin it asks at this attempt."""
    at = np.arange(bins, dtype=np.uint64) + np.uint64(attempt * bins + 1)
    return (mixed(mixed(at)) % np.uint64(bins)).astype(np.int64)


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """The densified smallest hash of each bin for a set of ascending hashes (at least one)."""
    bin_of = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)  # ascending too
    first = np.flatnonzero(np.append(True, bin_of[1:] != bin_of[:-1]))
    out, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[bin_of[first]], filled[bin_of[first]] = hashes[first], True
    empty, attempt = np.flatnonzero(~filled), 0
    while len(empty):
        donor = draws(attempt, bins)[empty]
        found = filled[donor]
        out[empty[found]] = out[donor[found]]
        empty, attempt = empty[~found], attempt + 1
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One number per band of a signature."""
    parts = sig.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for column in parts.T:
        key = mixed(key + column)
    return key


def digest(hashes: np.ndarray) -> bytes:
    return blake2b(hashes.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, words: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key, cls, n, bands) per document: key finds its text again, cls names its set, n is the set's size."""

    def run(batches):
        for batch in batches:
            for start, stop, texts in text_blocks(batch, 2, 2 << 20):
                sets = shingle_sets(texts, words)
                keys = [band_keys(signature(s, bands * rows), bands).view(np.int64) if len(s) else np.empty(0, np.int64) for s in sets]
                ends = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start),
                    pa.array([digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))], ["id", "key", "cls", "n", "bands"])

    df = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), text_or_empty(text_col).alias("text"))
    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, key long, cls binary, n long, bands array<long>")


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """``SKETCH`` words of 64 bits: bit i is the parity of the hashes whose low bits are i."""
    at = np.bincount((hashes & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(at.astype(np.uint8), bitorder="little").view(np.int64)


def full_sets(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles, sketch) of the wanted nodes (node, cls, key): their texts are read again."""

    def run(batches):
        for batch in batches:
            for _, _, texts in text_blocks(batch, 0, 2 << 20):
                sets = shingle_sets(texts, words)
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
                sketches = pa.array(np.concatenate([odd_sketch(s) for s in sets]))
                yield pa.RecordBatch.from_arrays([
                    pa.array([digest(s) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * SKETCH, pa.int32()), sketches)], ["cls", "shingles", "sketch"])

    texts = docs.select(row_key(id_col, text_col).alias("key"), text_or_empty(text_col).alias("text"))
    texts = texts.join(wanted.select("key").distinct().hint("shuffle_hash"), "key", "left_semi").select("text")
    sets = texts.mapInArrow(run, "cls binary, shingles array<long>, sketch array<long>")
    return sets.dropDuplicates(["cls"]).join(wanted.select("cls", "node"), "cls").select("node", "shingles", "sketch")


def alike(x: Column, y: Column, both: Column, percent: int) -> Column:
    """100 * intersection >= percent * union, of the set sizes and the size of the intersection."""
    return 100 * both >= percent * (x + y - both)


def can_be_alike(a: str, b: str, percent: int) -> Column:
    """Whether two sets can be alike by their sizes and sketches (columns n_a, sketch_a, n_b, sketch_b)."""
    x, y = F.col(f"n_{a}"), F.col(f"n_{b}")
    differ = sum((F.bit_count(F.col(f"sketch_{a}")[i].bitwiseXOR(F.col(f"sketch_{b}")[i])) for i in range(SKETCH)), F.lit(0))
    return alike(x, y, F.least(x, y), percent) & alike(x, y, (x + y - differ) / 2, percent)


def facts(sets: DataFrame, side: str) -> DataFrame:
    return sets.select(F.col("node").alias(side), F.size("shingles").cast("long").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose full sets are alike."""
    member = sets.select(F.col("node").alias("a"), F.col("shingles").alias("mine"))
    centre = sets.select(F.col("node").alias("b"), F.col("shingles").alias("theirs"))
    edges = stored(edges)
    if edges.isEmpty():  # the sets need not be shuffled
        return edges
    sizes = stored(edges.groupBy("b").agg(F.count("*").alias("n")))
    met = join_spread(edges, centre.join(sizes.select("b"), "b", "left_semi"), "b", sizes).join(member, "a")
    both = F.size(F.array_intersect("mine", "theirs"))
    return met.filter(alike(F.size("mine"), F.size("theirs"), both, percent)).select("a", "b")


def open_pairs(members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) with a > b: pairs of members (bucket, node) of one bucket but different components that can be alike.

    Members of a bucket's largest component need not meet each other: the others,
    mostly few, are sent to every part of ``PART`` members, and meet all members there, so no task holds a hot bucket.
    """
    labels = members.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    labels = stored(labels)
    by_root = labels.groupBy("bucket", "root").agg(F.count("*").alias("held"))
    several = by_root.groupBy("bucket").agg(F.max(F.struct("held", "root")).alias("most"), F.count("*").alias("roots"), F.sum("held").alias("n"))
    several = stored(several.filter("roots > 1").select("bucket", "n", F.col("most.root").alias("largest"), F.ceil(F.col("n") / PART).cast("int").alias("cut")))
    held = join_spread(labels, several.drop("n"), "bucket", several.select("bucket", "n"))
    all_ = held.join(sets.select("node", F.size("shingles").cast("long").alias("n"), "sketch"), "node")
    all_ = stored(all_.select("bucket", "node", "root", "n", "sketch", "cut", (F.col("root") != F.col("largest")).alias("apart")))
    part = F.pmod(F.xxhash64("node"), F.col("cut")).cast("int")
    named = lambda df, side: df.select("bucket", "part", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "root", "n", "sketch", "apart")])
    x = named(all_.filter("apart").withColumn("part", F.explode(F.expr("sequence(0, cut - 1)"))), "a")
    y = named(all_.withColumn("part", part), "b")
    met = x.join(y, ["bucket", "part"]).filter(
        (F.col("root_a") != F.col("root_b")) & (~F.col("apart_b") | (F.col("node_a") > F.col("node_b"))) & can_be_alike("a", "b", percent))
    return met.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")).distinct()


def star_edges(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b): every member a of a bucket (bucket, node; n members) with its centre b, which meets most others in all."""
    met = join_spread(members, sizes, "bucket", sizes)
    score = met.groupBy("node").agg(F.sum("n").alias("score"))
    known = stored(members.join(score, "node"))
    centre = known.groupBy("bucket").agg(F.max(F.struct("score", "node")).alias("c")).select("bucket", F.col("c.node").alias("b"))
    return join_spread(known, centre, "bucket", sizes).filter("node != b").select(F.col("node").alias("a"), "b").distinct()


def linked(docs: DataFrame, classes: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(node, root): components of the links that a bucket shows between classes (node, cls, key, n, bands; a stored table)."""
    all_ = classes.select("node", F.explode("bands").alias("bucket"))
    sizes = stored(all_.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    members = stored(join_spread(all_, sizes.select("bucket"), "bucket", sizes).select("bucket", "node"))
    wanted = members.select("node").distinct().join(classes.select("node", "cls", "key"), "node")
    sets = stored(full_sets(docs, stored(wanted), words, id_col, text_col))
    edges = star_edges(members, sizes).join(facts(sets, "a"), "a").join(facts(sets, "b"), "b").filter(can_be_alike("a", "b", percent))
    roots = components(confirmed(edges.select("a", "b"), sets, percent))
    more = confirmed(open_pairs(members, roots, sets, percent), sets, percent)
    # the first links are connected by now: each of their nodes goes on with one link to its root
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more.select("a", "b")))


def groups(docs: DataFrame, words: int = 2, percent: int = 80, bands: int = 32, rows: int = 5, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per document."""
    marked = stored(signatures(docs, words, bands, rows, id_col, text_col))
    full = marked.filter("n > 0")
    classes = full.groupBy("cls").agg(F.count("*").alias("held"), F.min("id").alias("id"), F.min("key").alias("key"),
                                      F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))
    roots = linked(docs, classes, words, percent, id_col, text_col)
    named = classes.select("cls", "held", "id", "node").join(roots, "node", "left")
    named = stored(named.withColumn("root", F.coalesce("root", "node")))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = stored(join_spread(named, least, "root", named.groupBy("root").agg(F.count("*").alias("n"))))
    sizes = named.select("cls", F.col("held").alias("n"))
    told = join_spread(full.select("id", "cls", F.col("n").alias("n_shingles")), named.select("cls", "component_id"), "cls", sizes)
    alone = marked.filter("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    out = told.select("id", "n_shingles", "component_id").union(alone)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
