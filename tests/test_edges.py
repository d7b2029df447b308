"""Edge cases of demand, staffing, category growth and the scorecard on micro tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from retailops.functions import scalars as S
from retailops.operators import category as C
from retailops.operators import demand as D
from retailops.operators import expansion as X
from retailops.operators import staffing as T


def at(day, hour, minute=0, second=0):
    return dt.datetime(2025, 3, day, hour, minute, second)


def attendance(spark, rows):
    df = spark.createDataFrame(rows, "emp_id long, emp_name string, branch string, punch_in timestamp_ntz, punch_out timestamp_ntz")
    hours = F.timestamp_diff("SECOND", F.col("punch_in"), F.col("punch_out")) / 3600
    return df.withColumn("work_duration_hours", hours)


def months(spark, rows):
    df = spark.createDataFrame([(b, dt.date(y, m, 1), t) for b, y, m, t in rows], "branch string, date date, total double")
    return df.select("branch", F.date_format("date", "MMMM").alias("month"), F.month("date").alias("month_num"),
                     F.year("date").alias("year"), "total", "date")


@pytest.mark.parametrize("hour, want", [(0, "overnight"), (5, "overnight"), (6, "morning"), (11, "morning"), (12, "afternoon"), (16, "afternoon"),
                                        (17, "evening"), (21, "evening"), (22, "late_night"), (23, "late_night"), (None, None)])
def test_shift_bins_are_closed_on_the_left(spark, hour, want):
    df = spark.createDataFrame([(hour,)], "h int").select(S.shift_type(F.col("h")).alias("s"))
    assert df.first().s == want


def test_missing_punch_out_null_branch_and_midnight(spark):
    att = attendance(spark, [
        (1, "a", "N", at(1, 22), at(2, 2)), (1, "a", "N", at(3, 9), None), (2, "b", "N", at(3, 9), at(3, 13)),
        (3, "c", None, at(3, 9), at(3, 10)), (4, "d", "S", at(8, 12), None)])
    shifts = {(r.emp_id, r.date.day): r for r in T.shift_patterns(att).collect()}
    assert shifts[1, 1].crosses_midnight == 1 and shifts[1, 1].is_weekend == 1  # a Saturday
    assert shifts[1, 3].hour_out is None and shifts[1, 3].work_duration_hours is None
    prof = {r.branch: r for r in T.staffing_profile(att, months(spark, [("N", 2025, 3, 80.0)]), 3).collect()}
    assert set(prof) == {"N", "S"}
    n = prof["N"]
    assert (n.num_employees, n.total_shifts, n.total_hours, n.median_shift_hours) == (2, 3, 8.0, 4.0)
    assert n.revenue_per_hour == 10.0 and n.min_shifts_per_employee == 1 and n.max_shifts_per_employee == 2
    assert prof["S"].median_shift_hours is None and prof["S"].month_revenue == 0.0 and prof["S"].revenue_per_hour == 0.0
    daily = {(r.branch, r.date.day): r for r in T.daily_coverage(att).collect()}
    assert (None, 3) not in daily and daily["N", 3].total_shifts == 2 and daily["N", 3].coverage_span_hours == 4.0
    assert daily["S", 8].coverage_span_hours is None


def test_recommendations_follow_growth_with_floor_and_cap(spark):
    att = attendance(spark, [(e, "x", b, at(d, 9), at(d, 17)) for b in ("Up", "Down", "Flat") for d in (3, 4) for e in range(4)])
    fsum = spark.createDataFrame([("Up", 3.0), ("Down", -0.9), ("Flat", None)], "branch string, forecast_vs_historical double")
    recs = {r.branch: r for r in T.shift_recommendations(T.shift_patterns(att), fsum).collect()}
    assert recs["Up"].recommended_staff_per_day == 7  # 16 wanted, 4 at hand and 3 more
    assert recs["Down"].demand_multiplier == 0.5 and recs["Down"].recommended_staff_per_day == 2
    assert recs["Flat"].demand_multiplier == 1.0 and recs["Flat"].median_hours_per_shift == 8.0
    acts = {r.branch: r for r in T.hiring_action(spark.createDataFrame([("Up", 4), ("Down", 4), ("Flat", 4), ("Else", 1)], "branch string, num_employees long"),
                                                 fsum).collect()}
    assert {b: r.action for b, r in acts.items()} == {"Up": "HIRE", "Down": "OPTIMIZE", "Flat": "MAINTAIN", "Else": "MAINTAIN"}
    assert acts["Up"].suggested_additional == 6 and acts["Down"].suggested_additional == 0


def test_demand_of_one_month_zero_bases_and_gaps(spark):
    m = months(spark, [("One", 2025, 1, 10.0), ("Zero", 2025, 1, 0.0), ("Zero", 2025, 2, 5.0), ("Zero", 2025, 4, 0.0), ("Down", 2025, 1, 9.0),
                       ("Down", 2025, 2, 6.0), ("Down", 2025, 3, 1.0)])
    f = D.monthly_features(m)
    got = {(r.branch, r.month_num): r for r in f.collect()}
    assert got["One", 1].mom_growth is None and got["One", 1].month_share == 1.0
    assert got["Zero", 2].mom_growth is None and got["Zero", 4].mom_growth == -1.0 and got["Zero", 4].lag_2 == 0.0
    rates = {r.branch: r for r in D.growth_rate(f).collect()}
    assert (rates["One"].n_rates, rates["One"].growth_rate) == (0, 0.0)
    assert rates["Zero"].n_rates == 1 and rates["Down"].growth_rate == -0.3  # held at the floor
    fc = {(r.branch, r.steps_ahead): r for r in D.forecast(f, 2).collect() if r.steps_ahead}
    assert fc["One", 1].forecast_trend == 10.0 and fc["One", 1].ci_lower == fc["One", 1].ci_upper == fc["One", 1].forecast
    assert fc["Down", 2].forecast_trend == 0.0 and 0 <= fc["Down", 2].ci_lower < fc["Down", 2].forecast and fc["Down", 2].date == dt.date(2025, 5, 1)


def sources(spark):
    m = months(spark, [("N", 2025, 1, 10.0), ("N", 2025, 2, 30.0), ("Alone", 2025, 1, 4.0)])
    division = spark.createDataFrame([("N", "ITEMS", 10.0, 20.0, 10.0, 40.0), ("N", "X", 0.0, 0.0, 0.0, 0.0), ("Q", "ITEMS", 1.0, 1.0, 1.0, 3.0)],
                                     "branch string, division string, delivery double, dine_in double, take_away double, total double")
    avg = spark.createDataFrame([("N", "TABLE", 4, 20.0), ("N", "DELIVERY", 0, 0.0), (None, "TABLE", 9, 9.0)],
                                "branch string, menu_channel string, num_customers int, sales double")
    orders = spark.createDataFrame([("N", "c1", 1), ("N", "c2", 3), ("Q", "c1", 5)], "branch string, customer string, num_orders int")
    return m, division, avg, orders


def test_profile_and_scorecard_of_branches_that_some_sources_lack(spark):
    """Only branches with months count; a source without rows for a branch gives zeros, a NULL branch belongs to none."""
    m, division, avg, orders = sources(spark)
    prof = {r.branch: r for r in D.branch_profile(m, division, avg, orders).collect()}
    assert set(prof) == {"N", "Alone"}
    n, a = prof["N"], prof["Alone"]
    assert (n.total_revenue, n.overall_growth, n.peak_month, n.table_share, n.total_customers, n.avg_ticket_size) == (40.0, 2.0, "February", 0.5, 4, 5.0)
    assert (n.delivery_customers, n.delivery_orders, n.avg_orders_per_delivery_customer, n.active_divisions) == (2, 4, 2.0, 1)
    assert (a.num_months, a.overall_growth, a.table_share, a.total_customers, a.avg_ticket_size, a.active_divisions) == (1, 0.0, 0.0, 0, 0.0, 0)
    tax = spark.createDataFrame([("N", 2.5)], "branch string, vat double")
    att = attendance(spark, [(1, "a", "N", at(3, 9), at(3, 13)), (1, "a", "N", at(4, 9), None), (2, "b", None, at(3, 9), at(3, 10))])
    card = {r.branch: r for r in X.scorecard(m, division, avg, orders, tax, att, ["X"]).collect()}
    n, a = card["N"], card["Alone"]
    assert set(card) == {"N", "Alone"}
    assert (n.momentum, n.vat_contribution, n.channels_active, n.repeat_rate, n.num_employees, n.total_shifts, n.avg_shift_hours) == (2.0, 2.5, 1, 0.5, 1, 2, 4.0)
    assert (n.revenue_per_customer, n.revenue_per_employee, n.delivery_share, n.beverage_ratio) == (10.0, 40.0, 0.25, 0.0)
    assert (a.revenue_cv, a.num_employees, a.revenue_per_employee, a.repeat_rate, a.takeaway_share) == (None, 0, 0.0, 0.0, 0.0)


def test_category_ranks_gaps_and_lists(spark):
    rows = [("N", "A", "g", f"latte {i}", 10.0, 100.0) for i in range(4)] + [("N", "A", "g", "mocha", 1.0, 7.0)]
    rows += [("S", "A", "g", "latte 1", 1.0, 100.0), ("S", "A", "g", "bread", 5.0, 400.0), ("T", "A", "g", "bread", 5.0, 0.0)]
    items = spark.createDataFrame(rows, "branch string, division string, grp string, description string, qty double, total_amount double")
    items = C.classify_items(items.withColumn("unit_price", F.col("total_amount") / F.col("qty")))
    perf = {(r.branch, r.description): r.branch_rank for r in C.product_performance(items).collect()}
    assert perf == {**{("N", f"latte {i}"): 1 for i in range(4)}, ("N", "mocha"): 2, ("S", "latte 1"): 1}
    division = spark.createDataFrame([("N", "ITEMS", 407.0), ("S", "ITEMS", 500.0)], "branch string, division string, total double")
    summary = C.category_summary(items, division)
    gaps = {(r.branch, r.category): r for r in C.growth_gaps(items, summary, 2).collect()}
    assert gaps["S", "coffee"].missing_products == 4 and gaps["S", "coffee"].missing_product_list == "latte 0; latte 2"
    assert gaps["T", "coffee"].missing_products == 5 and gaps["T", "coffee"].current_revenue_share == 0.0
    missing = {(r.branch, r.description) for r in C.missing_products(items, summary).collect()}
    assert missing == {("S", f"latte {i}") for i in (0, 2, 3)} | {("S", "mocha")} | {("T", f"latte {i}") for i in range(4)} | {("T", "mocha")}
