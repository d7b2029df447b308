"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix (law ``rows``).

Method.  Each source partition permutes its rows locally.  How many rows partition p sends to shard s is drawn from the
multivariate hypergeometric law that a uniform shuffle implies, so every column of the matrix sums to the exact shard
size.  The first ``a`` rows of a partition's permutation go to shard 0, the next ``b`` to shard 1, and so on; after the
exchange each shard permutes its rows again, which gives the slots.

Scale.  The local permutation is a sort inside the reading task.  Sizes, random keys and row numbers are stored once
(no text), so a lost executor cannot change them.  The matrix has one row per source partition (never per document) and
is joined, with a broadcast hint only below ``MAX_BROADCAST`` cells.  The second permutation ranks uniform random keys
in buckets of about ``BUCKET`` rows, so no task holds a whole shard and no value of the data can make a bucket hot.

Defined results: NULL text has size 1 and CRC-32 0, like an empty text; equal rows and NULL ids are separate rows and
each gets its own slot; an empty table gives an empty table; other columns are not read.  Equal texts are not kept
together: shard sizes at most one apart rule that out for large groups.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_or_empty

BUCKET = 4096
MAX_BROADCAST = 1 << 18


def hypergeometric(rng: random.Random, good: int, bad: int, sample: int) -> int:
    """Number of good ones in a sample without replacement: inversion outwards from the mode."""
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    mode = min(high, max(low, (sample + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    p = math.exp(log_choose(good, mode) + log_choose(bad, sample - mode) - log_choose(good + bad, sample))
    u = rng.random() - p
    up, down, pu, pd = mode, mode, p, p
    while u > 0 and (up < high or down > low):
        if up < high:
            pu *= (good - up) * (sample - up) / ((up + 1) * (bad - sample + up + 1))
            up += 1
            u -= pu
            if u <= 0:
                return up
        if down > low:
            pd *= down * (bad - sample + down) / ((good - down + 1) * (sample - down + 1))
            down -= 1
            u -= pd
            if u <= 0:
                return down
    return mode


def communication_matrix(rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each partition sends to each shard; row sums are ``rows``, column sums at most one apart."""
    rng, total = random.Random(seed), sum(rows)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in rows:
        left, rest, line = n, sum(room), []
        for s in range(shards):
            rest -= room[s]
            take = hypergeometric(rng, room[s], rest, left)
            line.append(take)
            left -= take
        room = [a - b for a, b in zip(room, line)]
        matrix.append(line)
    return matrix


def shuffle_shards(docs: DataFrame, shards: int = 16, seed: int = 7, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) per document."""
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    local = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.rand(seed).alias("first"), F.rand(seed + 1).alias("second"))
    local = local.sortWithinPartitions("first").withColumn("n", F.monotonically_increasing_id())
    rows = stored(local.select("id", "size", "crc", "second", F.shiftright("n", 33).alias("part"),
                               F.col("n").bitwiseAND((1 << 33) - 1).alias("at")))
    counts = sorted((r["part"], r["count"]) for r in rows.groupBy("part").count().collect())  # one row per partition
    total = sum(c for _, c in counts)
    matrix = communication_matrix([c for _, c in counts], shards, seed)
    cuts = spark.createDataFrame([(p, [sum(m[:s + 1]) for s in range(shards)]) for (p, _), m in zip(counts, matrix)],
                                 "part long, cuts array<long>")
    if len(counts) * shards <= MAX_BROADCAST:
        cuts = F.broadcast(cuts)
    buckets = max(1, math.ceil(total / shards / BUCKET))
    sent = rows.join(cuts, "part").select(
        "id", "size", "crc", "second", "part", "at",
        F.size(F.filter("cuts", lambda c: c <= F.col("at"))).alias("shard"),
        F.floor(F.col("second") * buckets).cast("int").alias("bucket"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sent.groupBy("shard", "bucket").agg(F.count("*").alias("rows")).select(
        "shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("second", "part", "at")
    return sent.withColumn("rank", F.row_number().over(inside)).join(offsets, ["shard", "bucket"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard",
        (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
