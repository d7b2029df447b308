"""Ranks, medians and carried values by value ranges, against plain Python and Spark's own aggregates."""

import random
import re

import pytest
from pyspark.sql import functions as F

from retailops.functions import fill, ranges
from retailops.functions.ranking import dense_rank_by, global_rank

SF = "/root/testdata/sf0.001"


def skewed(rng, n):
    """Values of all sizes: ties, outliers, a cluster, negatives and NULL."""
    kinds = [lambda: None, lambda: 5.0, lambda: rng.random(), lambda: rng.random() * 1e-9, lambda: rng.choice([-1e300, 1e300, 1e18, -7.25]),
             lambda: float(rng.randint(0, 40))]
    return [kinds[min(int(rng.random() * 7), 5)]() for _ in range(n)]


@pytest.mark.parametrize("cells", [256, 3])
def test_rows_before(spark, monkeypatch, cells):
    monkeypatch.setattr(ranges, "CELLS", cells)
    rng = random.Random(1)
    rows = {(rng.choice("abc"), v, rng.randint(0, 3)): rng.randint(1, 5) for v in skewed(rng, 400)}
    rows = [(*k, n) for k, n in rows.items()]
    df = spark.createDataFrame(rows, "g string, v double, t int, n long").repartition(6)
    got = {(r.g, r.v, r.t): r.before for r in ranges.rows_before(df, F.col("v"), ["g"], [F.asc("t")]).collect()}
    key = lambda v, t: (v is not None, v or 0.0, t)
    assert got == {(g, v, t): sum(m for h, w, u, m in rows if h == g and key(w, u) < key(v, t)) for g, v, t, _ in rows}
    alone = {(r.g, r.v, r.t): r.before for r in ranges.rows_before(df, F.col("v"), order=[F.asc("t"), F.asc("g")]).collect()}
    assert alone == {(g, v, t): sum(m for h, w, u, m in rows if (*key(w, u), h) < (*key(v, t), g)) for g, v, t, _ in rows}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 500])
def test_medians_equal_median(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice("ab"), v) for v in skewed(rng, n)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    want = {r.g: r.m for r in df.where("v is not null").groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert {r.g: r.m for r in ranges.exact_medians(df, ["g"], "v", "m").collect()} == want


def test_median_of_ten_million_distinct_values_in_one_group(spark):
    df = spark.range(0, 10_000_000, 1, 8).select(F.lit("g").alias("g"), F.sqrt("id").alias("v"))
    got = ranges.exact_medians(df, ["g"], "v", "m").first().m
    assert got == (4_999_999 ** 0.5 + 5_000_000 ** 0.5) / 2


def test_dense_rank_is_dense_and_no_window_holds_a_group(spark):
    rng = random.Random(7)
    rows = [(rng.choice("abbbbbb"), v) for v in skewed(rng, 600)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    ranked = dense_rank_by(df, "g", "v", "rk")
    got = sorted(map(str, ranked.collect()))
    order = {g: sorted({v for h, v in rows if h == g}, key=lambda v: (v is None, -(v or 0))) for g in "ab"}
    want = sorted(str((g, v, order[g].index(v) + 1 if g else None)) for g, v in rows)
    assert [re.sub(r"\w+=", "", x).removeprefix("Row") for x in got] == want
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    windows = re.findall(r"windowspecdefinition\((.*?) ASC", plan)
    assert windows and all("_c1#" in w and "_c2#" in w for w in windows)


def test_global_rank_with_a_million_distinct_leads(spark):
    df = spark.range(0, 1_000_000, 1, 8).withColumn("v", F.sqrt("id"))
    r = global_rank(df, [F.desc("v")], "rk", [(F.col("v"), True)])
    assert r.agg(F.count("*"), F.min(F.col("rk") + F.col("id")), F.max(F.col("rk") + F.col("id"))).first()[:] == (1_000_000, 1_000_000, 1_000_000)


def plain_fill(rows):
    out, held = [], {}
    for report, pos, v in sorted(rows):
        held[report] = v if v is not None else held.get(report)
        out.append((report, pos, held[report]))
    return out


@pytest.mark.parametrize("span, chunk", [(2, 1), (3, 4), (1024, 1 << 16)])
def test_carry_over_groups_of_chunks(spark, monkeypatch, span, chunk):
    monkeypatch.setattr(fill, "SPAN", span)
    rng = random.Random(span)
    rows = [(r, p, f"h{p}" if rng.random() < 0.03 else None) for r in "xy" for p in rng.sample(range(400), 250)]
    df = spark.createDataFrame(rows, "report_id string, pos long, h string").repartition(4)
    got = sorted(((r.report_id, r.pos, r.h) for r in fill.carry_forward(df, ["h"], chunk_rows=chunk).collect()))
    assert got == plain_fill(rows)


def test_carry_over_the_lines_of_documents(spark):
    """All lines of all documents as one report, a chunk each: the first words of long lines are carried down."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = docs.select(F.lit("all").alias("report_id"), (F.col("doc_id") * 100_000 + F.col("at")).alias("pos"),
                        F.when(F.length("line") > 300, F.substring("line", 1, 40)).alias("h"))
    rows = [(r.report_id, r.pos, r.h) for r in lines.collect()]
    got = sorted(((r.report_id, r.pos, r.h) for r in fill.carry_forward(lines, ["h"], chunk_rows=1).collect()),)
    assert got == plain_fill(rows) and len({h for _, _, h in got}) > 20


def test_entries_of_a_million_chunks_in_one_report(spark):
    """The table of chunks alone: each chunk gets the value of the nearest earlier chunk that has one."""
    df = spark.range(0, 1_000_000, 1, 8).select(F.lit("r").alias("report_id"), F.col("id").alias("_chunk"),
                                                F.when(F.col("id") % 3001 == 0, F.col("id")).alias("_last_h"))
    got = fill.chunk_entries(df, ["h"])
    wrong = got.where(~F.col("_in_h").eqNullSafe(F.expr("case when _chunk > 0 then (_chunk - 1) div 3001 * 3001 end")))
    assert got.count() == 1_000_000 and wrong.count() == 0
