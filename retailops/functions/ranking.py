"""Distributed ranking and whole-table scaling.

``global_rank`` numbers rows 1..N in a total order without funnelling the table through one task.  Rows are grouped by
values that lead the order (``lead``); rows per group are counted, the rows before each group follow from counts per value
range (``ranges``), and rows are numbered inside their group.  Neither the rows nor the group table is ever sorted in
one task, and a group is a pure function of the row, so recomputation, partition coalescing or a lost executor cannot move
a row to another group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import rows_before


def global_rank(df: DataFrame, order: Sequence[Column], name: str, lead: Sequence[tuple[Column, bool]]) -> DataFrame:
    """Add a 1-based ``name`` column following ``order`` (a total order: metric first, natural keys last).

    ``lead``: (expression, descending) pairs that never disagree with ``order``: its first keys, or coarser versions of
    them (a prefix of a name, a rounded number); the first one is a number.  Choose them so that a group stays small where
    the first key has many ties.  A row whose group is not found again (a lead that changes when it is recomputed)
    is an error, never a lost row.
    """
    keys = [f"_lead{i}" for i in range(len(lead))]
    rows = df.select("*", *[c.alias(k) for k, (c, _) in zip(keys, lead)])
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    first = F.col(keys[0]).cast("double")
    # a NULL stands first in an ascending order and last in a descending one
    value = F.coalesce(-first, F.lit(float("inf"))) if lead[0][1] else first
    groups = rows_before(groups, value, order=[F.desc(k) if down else F.asc(k) for k, (_, down) in zip(keys, lead)])
    groups = groups.select(*[F.col(k).alias(f"{k}_g") for k in keys], F.col("before").alias("_off"))
    ranked = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}_g")) for k in keys])
    offset = F.coalesce("_off", F.raise_error(F.lit("a leading value of the rank changed when it was computed again")).cast("bigint"))
    return ranked.join(groups, same, "left").withColumn(name, (offset + F.col("_in")).cast("int")).drop(
        *keys, *[f"{k}_g" for k in keys], "_off", "_in")


def dense_rank_by(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Add a 1-based dense rank of ``value`` (a stored or rounded number, greatest first, NULL last) within ``by``.

    Only the distinct values are ranked, by counts per value range, so a group of any size is dealt over many tasks.
    """
    distinct = df.select(by, F.col(value).alias("_x")).where(F.col(by).isNotNull()).distinct().withColumn("n", F.lit(1).cast("bigint"))
    ranks = rows_before(distinct, F.coalesce(-F.col("_x").cast("double"), F.lit(float("inf"))), [by])
    ranks = ranks.select(F.col(by).alias("_by"), "_x", (F.col("before") + 1).cast("int").alias(name))
    return df.join(ranks, (F.col(by) == F.col("_by")) & F.col(value).eqNullSafe(F.col("_x")), "left").drop("_by", "_x")


def minmax_scale(df: DataFrame, cols: Sequence[str], suffix: str = "_norm",
                 constant_value: float = 0.0) -> DataFrame:
    """(x - min) / (max - min) over the whole table, ``constant_value`` when the
    range is zero.  The min/max come from a one-row aggregate that is broadcast
    (a single row, so its size is fixed), never from an unpartitioned window."""
    stats = df.agg(*[F.min(c).alias(f"_mn_{c}") for c in cols],
                   *[F.max(c).alias(f"_mx_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(stats))
    for c in cols:
        rng = F.col(f"_mx_{c}") - F.col(f"_mn_{c}")
        out = out.withColumn(
            f"{c}{suffix}",
            F.when(rng > 0, (F.col(c) - F.col(f"_mn_{c}")) / rng).otherwise(F.lit(constant_value)))
    return out.drop(*[f"_mn_{c}" for c in cols], *[f"_mx_{c}" for c in cols])
