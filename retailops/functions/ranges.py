"""Positions in sorted order without sorting a table or a group in one task.

A numeric column is cut into value ranges: ``CELLS`` equal ranges between its least and greatest value, and each of those into
``CELLS`` equal ranges between the least and greatest value found in it.  The bounds are exact minima and maxima, so a cell is
a pure function of the row and of the table: recomputation cannot move a row.  The bounds are one row and at most ``CELLS`` + 1
rows, so they are broadcast whatever the data.  Counting rows per cell and adding the counts up, first over the ranges,
then inside each, gives the rows before a cell; only the rows of one cell are ever sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 256


def _cell(value: Column, low: Column, high: Column) -> Column:
    part = F.floor((value - low) / (high - low) * CELLS)
    return F.when(value.isNull(), -1).when(high > low, F.least(part, F.lit(CELLS - 1))).otherwise(0).cast("int")


def cells(t: DataFrame, value: Column) -> DataFrame:
    """``t`` with ``_v`` (the value as a double) and its cell ``_c1``, ``_c2``; NULL is a cell before all others."""
    t = t.withColumn("_v", value.cast("double"))
    whole = F.broadcast(t.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))  # one row
    t = t.crossJoin(whole).withColumn("_c1", _cell(F.col("_v"), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    each = t.groupBy("_c1").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    t = t.join(F.broadcast(each), "_c1", "left")  # at most CELLS + 1 rows
    return t.withColumn("_c2", _cell(F.col("_v"), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def _running(counts: DataFrame, by: Sequence[str], cell: str, out: str) -> DataFrame:
    """Counts (by..., cell, n) with ``out``, the count of earlier cells; at most CELLS + 1 cells stand in one array."""
    held = counts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(cell, "n"))).alias("_all"))
    summed = F.aggregate(F.col("_all.n"), F.array(F.lit(0).cast("bigint")),
                         lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    zipped = held.select(*by, F.inline(F.arrays_zip(F.col("_all").alias("x"), F.slice(summed, F.lit(1), F.size("_all")).alias("s"))))
    return zipped.select(*by, F.col(f"x.{cell}").alias(cell), F.col("x.n").alias("n"), F.col("s").alias(out))


def cell_offsets(t: DataFrame, by: Sequence[str] = (), n: str = "n") -> DataFrame:
    """(by..., _c1, _c2, _n, _before): the weight ``n`` of each cell of ``t`` and of the cells before it with the same ``by``."""
    by = list(by)
    fine = t.groupBy(*by, "_c1", "_c2").agg(F.sum(n).alias("n"))
    first = _running(fine.groupBy(*by, "_c1").agg(F.sum("n").alias("n")), by, "_c1", "_b1").drop("n")
    second = _running(fine, [*by, "_c1"], "_c2", "_b2")
    return second.join(first, [*by, "_c1"]).select(*by, "_c1", "_c2", F.col("n").alias("_n"), (F.col("_b1") + F.col("_b2")).alias("_before"))


def _inside(t: DataFrame, offsets: DataFrame, by: Sequence[str], order: Sequence[Column], n: str) -> DataFrame:
    """``t`` with ``before`` from the offsets of its cell and the rows of the cell that stand earlier."""
    at = [*by, "_c1", "_c2"]
    earlier = F.sum(n).over(Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    met = t.withColumn("_in", F.coalesce(earlier, F.lit(0))).join(offsets, at)
    return met.withColumn("before", F.col("_before") + F.col("_in")).drop("_in", "_before", "_n", "_c1", "_c2", "_v")


def rows_before(t: DataFrame, value: Column, by: Sequence[str] = (), order: Sequence[Column] = (), n: str = "n") -> DataFrame:
    """``t`` with ``before``: the weight ``n`` of the rows with the same ``by`` (none NULL) that stand before it.

    Rows stand by ascending ``value`` (a number), then by ``order``; a row each of these values.
    """
    placed = cells(t, value)
    return _inside(placed, cell_offsets(placed, by, n), list(by), [F.asc("_v"), *order], n)


def exact_medians(t: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """(by..., name): the exact median per group (as ``median``) by counting values per range and refining the range that holds the middle."""
    by = list(by)
    counts = t.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("n"))
    placed = cells(counts, F.col("_x"))
    offsets = cell_offsets(placed, by)
    total = offsets.groupBy(*by).agg(F.sum("_n").alias("_all"))
    low, high = F.expr("(_all - 1) div 2"), F.expr("_all div 2")

    def holds(at: Column, start: Column, size: Column) -> Column:
        return (start <= at) & (at < start + size)

    middle = offsets.join(total, by).where(holds(low, F.col("_before"), F.col("_n")) | holds(high, F.col("_before"), F.col("_n")))
    near = _inside(placed, middle, by, [F.asc("_v")], "n")  # one or two cells a group
    x = [F.max(F.when(holds(at, F.col("before"), F.col("n")), F.col("_x"))) for at in (low, high)]
    return near.groupBy(*by).agg(((x[0] + x[1]) / 2).alias(name))
