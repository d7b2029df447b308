"""Report text: read lines in order, drop noise, write text.

Files are read line by line and may be split: lines are numbered inside a
split, and the line counts of the earlier splits of a report (one row per
split) are added.  Order inside a split is the reader's own, so numbers do
not depend on which task or attempt reads it, and no window exceeds a split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Noise lines of the point-of-sale export (case-insensitive).
COPYRIGHT_RE = r"(?i)Copyright\s*©"
PAGE_RE = r"(?i)Page\s+\d+\s+of"
REPORT_ID_RE = r"(?i)^REP_S_\d+"
VENDOR_URL_RE = r"(?i)\bwww\.[\w-]+\.com\b"
PRINT_DATE_RE = r"^\d{2}-\w{3}-\d{2}"


def read_report_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1: (report_id, pos, line) for every line of every file under ``path``; ``pos`` counts from 0.

    The report is the folder ``report_id=...`` the file lies in (its files follow each other by name), else the file
    name without its ending.
    """
    file = F.col("_metadata.file_path")
    folder = F.regexp_extract(file, r"/report_id=([^/]+)/", 1)
    name = F.regexp_extract(file, r"([^/]+?)(\.[^./]*)?$", 1)
    raw = spark.read.text(path).select(
        F.when(folder != "", _unescaped(_unescaped(folder))).otherwise(_unescaped(name)).alias("report_id"),
        file.alias("_file"), F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_id"), F.make_valid_utf8("value").alias("line"))
    split = ["report_id", "_file", "_at"]
    before = Window.partitionBy("report_id").orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = raw.groupBy(*split).agg(F.count(F.lit(1)).alias("_n")).select(
        *split, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*split).orderBy("_id"))
    return raw.withColumn("_k", inside).join(counts, split).select(
        "report_id", (F.col("_before") + F.col("_k") - 1).alias("pos"), "line")


def _unescaped(c: Column) -> Column:
    """Percent signs of a path decoded; a plus stays a plus."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def is_noise(line: str = "line") -> F.Column:
    """FIL-1: blank, copyright, leading report id, vendor URL."""
    t = F.trim(F.col(line))
    # a plain search for a fixed part first: patterns that may start anywhere cost most of reading a line
    return (~F.coalesce(t.rlike(r"\S"), F.lit(False)) | (t.contains("©") & t.rlike(COPYRIGHT_RE)) | t.rlike(REPORT_ID_RE)
            | (F.lower(t).contains("www.") & t.rlike(VENDOR_URL_RE)))


def is_page(text: Column) -> Column:
    """Text that holds "Page N of" (``PAGE_RE``); NULL for NULL."""
    return F.lower(text).contains("page") & text.rlike(PAGE_RE)


def is_page_header(line: str = "line") -> F.Column:
    """FIL-2: any line holding "Page N of"."""
    return F.coalesce(is_page(F.col(line)), F.lit(False))


def drop_noise(lines: DataFrame, pages: bool = True) -> DataFrame:
    cond = is_noise("line")
    if pages:
        cond = cond | is_page_header("line")
    return lines.where(~cond)


def write_report_text(lines: DataFrame, path: str, order: tuple[str, ...] = ("pos",)) -> None:
    """Write reports as text, a folder per report whose files follow each other by name.

    The sort is by range, so a long report spreads over many tasks.  The id is never NULL, so that the writer keeps
    the order as it is; line ends inside a line become blanks.
    """
    (lines.select(F.coalesce("report_id", F.lit("unnamed")).alias("report_id"), *order,
                  F.translate(F.coalesce("line", F.lit("")), "\r\n", "  ").alias("line"))
     .sort("report_id", *order).select("report_id", "line").write.mode("overwrite").partitionBy("report_id").text(path))
