"""Line dedup: lines that spread over many sites are boilerplate and are removed.

Method.  A line (trimmed of ASCII white space) is known by its hash.  Per line hash a HyperLogLog sketch collects the
sites (column ``source``) of its documents; sketches merge by aggregation, so a line that a third of all rows hold still
sends one small sketch per task.  A sketch count well over or under ``sites`` decides; for lines near it (``BAND``
standard errors of the sketch) the distinct sites are counted exactly.  Lines on at least ``sites`` sites are removed
from every document; the other lines stay as they are.  A document stays whole if its whole text (its trimmed lines in
order) is itself on at least ``sites`` sites, counted by the same sketches; near-dedup settles such copies.

Scale.  Only hashes and sketches are exchanged for the decision.  The lines found are broadcast only up to
``MAX_BROADCAST``, counted first; so the places of a hot line need not meet in one task.  Removals come back as line numbers per document, which
are bounded by the lines of that document, and meet the text in one exchange under a key of the row.

Defined results: NULL text stays NULL and has no lines; empty or white lines are never removed; a NULL source is a site of
its own; repeated rows are changed alike and all returned; a text of spread lines only that is no spread copy becomes
empty; an empty table gives an empty table; other columns are passed through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, stored

LG = 8  # 256 registers
ERROR = 1.04 / 2 ** (LG / 2)
BAND = 4.0
MAX_BROADCAST = 1 << 20  # line hashes, 8 bytes each
WHOLE = -1  # place of the hash of a whole text
EDGES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _lines(text: str = "text") -> Column:
    return F.split(F.col(text), "\n")


def occurrences(docs: DataFrame, least: int, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(key, site, at, line): the hash of each line of ``least`` characters or more, with its place, and that of each whole text."""
    place = [row_key(text_col, site_col).alias("key"), F.xxhash64(site_col).alias("site")]
    df = docs.select(*place, F.posexplode(_lines(text_col)).alias("at", "raw"))
    df = df.withColumn("raw", F.regexp_replace("raw", EDGES, ""))
    df = df.filter(F.length("raw") >= least).select("key", "site", "at", F.xxhash64("raw").alias("line"))
    trimmed = F.transform(_lines(text_col), lambda x: F.regexp_replace(x, EDGES, ""))
    return df.union(docs.filter(F.col(text_col).isNotNull()).select(
        *place, F.lit(WHOLE), F.xxhash64(F.lit("whole text"), F.array_join(trimmed, "\n"))))


def small(lines: DataFrame) -> DataFrame:
    """A stored table of line hashes, with a broadcast hint if it is small; else adaptive execution joins it."""
    return F.broadcast(lines) if lines.count() <= MAX_BROADCAST else lines


def boilerplate(seen: DataFrame, sites: int) -> DataFrame:
    """(line) of the lines on at least ``sites`` sites."""
    sketches = seen.groupBy("line").agg(F.hll_sketch_agg("site", LG).alias("s"), F.count("*").alias("n"))
    spread = sketches.filter(F.col("n") >= sites).select("line", F.hll_sketch_estimate("s").alias("about"))
    spread = stored(spread.filter(F.col("about") >= sites * (1 - BAND * ERROR)))
    sure = F.col("about") > sites * (1 + BAND * ERROR)
    close = small(spread.filter(~sure).select("line"))
    exact = seen.join(close, "line", "left_semi").select("line", "site").distinct().groupBy("line").agg(
        F.count("*").alias("n")).filter(F.col("n") >= sites).select("line")
    return spread.filter(sure).select("line").union(exact)


def clean(docs: DataFrame, sites: int = 8, least: int = 1, most: None = None, text_col: str = "text",
          site_col: str = "source") -> DataFrame:
    """(row, text, n_lines, n_removed): the rows as a struct, with the text that is left."""
    seen = stored(occurrences(docs, least, text_col, site_col))
    gone = seen.join(small(stored(boilerplate(seen, sites))), "line", "left_semi").select("key", "at").distinct().groupBy("key").agg(
        F.collect_list("at").alias("gone"))
    rows = docs.select(F.struct("*").alias("row"), row_key(text_col, site_col).alias("key"))
    rows = rows.join(gone.hint("shuffle_hash"), "key", "left").select(
        "row", "gone", F.col("row")[text_col].alias("old"), F.split(F.col("row")[text_col], "\n").alias("lines"))
    new = F.array_join(F.filter("lines", lambda x, i: ~F.array_contains("gone", i)), "\n")
    rows = rows.withColumn("new", F.when(F.col("gone").isNotNull(), new))
    rows = rows.withColumn("cut", F.coalesce(~F.array_contains("gone", WHOLE), F.lit(False)))
    return rows.select(
        "row", F.when(F.col("cut"), F.col("new")).otherwise(F.col("old")).alias("text"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("cut"), F.size("gone")).otherwise(0).cast("long").alias("n_removed"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: lines, removed lines, size and digest of what is left (NULL text: empty)."""
    text = F.coalesce("text", F.lit(""))
    return clean(docs).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed",
                              F.length(text).cast("long").alias("left_chars"), F.md5(text).alias("left_md5"))
