"""Forward fill ("carry the latest header down") in bounded-size windows.

A report's lines are cut into chunks: a column ``chunk`` of the lines that
never disagrees with their order, else ``chunk_rows`` consecutive positions.
Inside a chunk, ``last(x, ignorenulls)`` over a running frame fills values.
The value entering a chunk comes from a prefix scan of "last value seen" over
two levels: the last value of every group of ``SPAN`` chunks is carried over the
groups, then each group carries it over its own chunks.  With numbered chunks no
window is larger than a chunk or than ``SPAN`` chunks, whatever the report's
length; a third level would only be needed past ``SPAN`` * ``SPAN`` chunks in one
report (a million chunks of 65,536 lines).  Chunks named by a text stand in one group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

SPAN = 1024


def _entering(last: DataFrame, keys: Sequence[str], at: str, cols: Sequence[str], out: str) -> DataFrame:
    """``last`` with ``out``_c: the last non-NULL ``_last_c`` of the rows with the same keys and a smaller ``at``."""
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return last.select(*keys, at, *[F.col(f"_last_{c}") for c in cols],
                       *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"{out}{c}") for c in cols])


def chunk_entries(per_chunk: DataFrame, cols: Sequence[str], key: str = "report_id") -> DataFrame:
    """(key, _chunk, _in_c...): the value of each column that enters each chunk, of a table with ``_last_c`` per (key, _chunk)."""
    numbered = isinstance(per_chunk.schema["_chunk"].dataType, NumericType)
    t = per_chunk.withColumn("_span", F.floor(F.col("_chunk") / SPAN) if numbered else F.lit(0).cast("bigint"))
    own = _entering(t, [key, "_span"], "_chunk", cols, "_own_")
    if not numbered:
        return own.select(key, "_chunk", *[F.col(f"_own_{c}").alias(f"_in_{c}") for c in cols])
    spans = t.groupBy(key, "_span").agg(*[
        F.max_by(F.col(f"_last_{c}"), F.when(F.col(f"_last_{c}").isNotNull(), F.col("_chunk"))).alias(f"_last_{c}") for c in cols])
    group = _entering(spans, [key], "_span", cols, "_group_").select(key, "_span", *[f"_group_{c}" for c in cols])
    return own.join(group, [key, "_span"], "left").select(
        key, "_chunk", *[F.coalesce(f"_own_{c}", f"_group_{c}").alias(f"_in_{c}") for c in cols])


def carry_forward(df: DataFrame, cols: Sequence[str], key: str = "report_id", order: str = "pos",
                  chunk_rows: int = 1 << 16) -> DataFrame:
    cols = list(cols)
    d = df.withColumn("_chunk", F.col("chunk") if "chunk" in df.columns else F.floor(F.col(order) / F.lit(chunk_rows)))
    per_chunk = d.groupBy(key, "_chunk").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_last_{c}") for c in cols])
    running = Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = d.join(chunk_entries(per_chunk, cols, key), [key, "_chunk"], "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.last(c, ignorenulls=True).over(running), F.col(f"_in_{c}")))
    return out.drop("_chunk", *[f"_in_{c}" for c in cols])
