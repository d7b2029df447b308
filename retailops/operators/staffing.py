"""Staffing: shift patterns, branch profile, daily coverage, recommendations.

Per-row calendar fields are projections; every profile is a ``groupBy`` over
branch (x shift / x day) with map-side partial aggregation.  Exact medians come
from counts per value range (``functions.ranges``), so no buffer holds the
values of a branch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import exact_medians
from ..functions.scalars import ceil9, rnd, safe_div, shift_type

# Shift types that get recommendations (late_night has none but
# still counts in the share denominator), weekend day numbers (Mon=0), the
# demand-multiplier floor, extra staff cap, hiring thresholds.
SHIFT_ORDER = ["morning", "afternoon", "evening", "overnight"]
WEEKEND_DAYS = [5, 6]
MULTIPLIER_FLOOR = 0.5
EXTRA_STAFF_CAP = 3
HIRE_ABOVE, OPTIMIZE_BELOW, HIRE_FACTOR = 0.3, -0.2, 0.5
DEFAULT_PEAK_SHIFT = "afternoon"
DEFAULT_HOURS = 8.0


def _order_index(col: str, values: list[str]) -> F.Column:
    out = F.lit(len(values))
    for i, v in reversed(list(enumerate(values))):
        out = F.when(F.col(col) == v, F.lit(i)).otherwise(out)
    return out


# ---------------------------------------------------------------- STF-1
def shift_patterns(att: DataFrame) -> DataFrame:
    day_num = F.weekday("punch_in")
    return att.select(
        "emp_id", "emp_name", "branch",
        F.to_date("punch_in").alias("date"),
        F.date_format("punch_in", "EEEE").alias("day_of_week"),
        day_num.alias("day_num"),
        F.hour("punch_in").alias("hour_in"),
        F.hour("punch_out").alias("hour_out"),
        shift_type(F.hour("punch_in")).alias("shift_type"),
        day_num.isin(WEEKEND_DAYS).cast("int").alias("is_weekend"),
        (F.to_date("punch_out") > F.to_date("punch_in")).cast("int").alias("crosses_midnight"),
        "work_duration_hours")


# ---------------------------------------------------------------- STF-2
def staffing_profile(att: DataFrame, monthly: DataFrame, month: int = 12) -> DataFrame:
    a = att.where(F.col("branch").isNotNull())
    st = shift_type(F.hour("punch_in"))
    hrs = F.col("work_duration_hours")
    g = a.groupBy("branch").agg(
        F.count_distinct("emp_id").alias("num_employees"),
        F.count(F.lit(1)).alias("total_shifts"),
        F.sum(hrs).alias("_th"), F.avg(hrs).alias("_ah"),
        F.stddev_samp(hrs).alias("_sh"),
        F.count(st).alias("_nst"),
        *[F.count(F.when(st == lab, 1)).alias(f"_n_{lab}") for lab in ("morning", "afternoon", "evening", "overnight")],
        F.avg(F.weekday("punch_in").isin(WEEKEND_DAYS).cast("double")).alias("_we"),
        F.count_distinct(F.to_date("punch_in")).alias("working_days"))
    per_emp = a.groupBy("branch", "emp_id").agg(F.count(F.lit(1)).alias("_k")).groupBy("branch").agg(
        F.avg("_k").alias("_ak"), F.min("_k").alias("_mink"), F.max("_k").alias("_maxk"))
    rev = (monthly.where(F.month("date") == month).groupBy("branch")
           .agg(F.sum("total").alias("_rev")))
    mid = exact_medians(a, ["branch"], "work_duration_hours", "_mh")
    j = g.join(per_emp, "branch").join(mid, "branch", "left").join(rev, "branch", "left")
    r = F.coalesce(F.col("_rev"), F.lit(0.0))
    return j.select(
        "branch", F.col("num_employees").cast("bigint").alias("num_employees"),
        F.col("total_shifts").cast("bigint").alias("total_shifts"),
        rnd("_th", 2).alias("total_hours"), rnd("_ah", 2).alias("avg_shift_hours"),
        rnd("_mh", 2).alias("median_shift_hours"), rnd("_sh", 2).alias("std_shift_hours"),
        rnd("_ak", 2).alias("avg_shifts_per_employee"),
        F.col("_mink").cast("bigint").alias("min_shifts_per_employee"),
        F.col("_maxk").cast("bigint").alias("max_shifts_per_employee"),
        F.col("working_days").cast("bigint").alias("working_days"),
        rnd(safe_div("total_shifts", "working_days"), 2).alias("avg_employees_per_day"),
        rnd("_we", 4).alias("weekend_share"),
        *[rnd(F.coalesce(safe_div(f"_n_{lab}", "_nst"), F.lit(0.0)), 4).alias(f"{lab}_share")
          for lab in ("morning", "afternoon", "evening", "overnight")],
        rnd(r, 2).alias("month_revenue"),
        rnd(safe_div(r, "_th"), 2).alias("revenue_per_hour"),
        rnd(safe_div(r, "total_shifts"), 2).alias("revenue_per_shift"),
        rnd(safe_div(r, "num_employees"), 2).alias("revenue_per_employee"))


# ---------------------------------------------------------------- STF-3
def daily_coverage(att: DataFrame) -> DataFrame:
    a = att.where(F.col("branch").isNotNull()).withColumn("date", F.to_date("punch_in"))
    g = a.groupBy("branch", "date").agg(
        F.count_distinct("emp_id").alias("employees_on_duty"),
        F.count("emp_id").alias("total_shifts"),
        F.sum("work_duration_hours").alias("_th"), F.avg("work_duration_hours").alias("_ah"),
        F.min("punch_in").alias("_in"), F.max("punch_out").alias("_out"))
    dn = F.weekday("date")
    return g.select(
        "branch", "date", F.col("employees_on_duty").cast("bigint").alias("employees_on_duty"),
        F.col("total_shifts").cast("bigint").alias("total_shifts"),
        rnd("_th", 2).alias("total_hours"), rnd("_ah", 2).alias("avg_shift_hours"),
        F.date_format("date", "EEEE").alias("day_of_week"), dn.alias("day_num"),
        dn.isin(WEEKEND_DAYS).cast("int").alias("is_weekend"),
        rnd(F.timestamp_diff("MICROSECOND", F.col("_in"), F.col("_out")) / 3.6e9, 2).alias("coverage_span_hours"))


# ---------------------------------------------------------------- STF-4
def _growth(fsum: DataFrame) -> DataFrame:
    return fsum.select("branch", F.coalesce("forecast_vs_historical", F.lit(0.0)).alias("growth"))


def shift_recommendations(shifts: DataFrame, fsum: DataFrame) -> DataFrame:
    s = shifts.where(F.col("branch").isNotNull())
    tot = s.groupBy("branch").agg(F.count(F.lit(1)).alias("_tot"))
    we = F.col("is_weekend") == 1
    g = s.where(F.col("shift_type").isin(SHIFT_ORDER)).groupBy("branch", "shift_type").agg(
        F.count(F.lit(1)).alias("current_shift_count"),
        F.count_distinct("emp_id").alias("employees_available"),
        F.avg("work_duration_hours").alias("_ah"),
        F.count_distinct("date").alias("_days"),
        F.count(F.when(we, 1)).alias("_nwe"), F.count_distinct(F.when(we, F.col("date"))).alias("_dwe"),
        F.count(F.when(~we, 1)).alias("_nwd"), F.count_distinct(F.when(~we, F.col("date"))).alias("_dwd"))
    mid = exact_medians(s.where(F.col("shift_type").isin(SHIFT_ORDER)), ["branch", "shift_type"], "work_duration_hours", "_mh")
    j = g.join(mid, ["branch", "shift_type"], "left").join(tot, "branch").join(_growth(fsum), "branch", "left")
    mult = F.greatest(1 + F.coalesce(F.col("growth"), F.lit(0.0)), F.lit(MULTIPLIER_FLOOR))
    per_day = safe_div("current_shift_count", "_days")
    rec = F.least(ceil9(per_day * mult), F.col("employees_available") + EXTRA_STAFF_CAP)
    return j.select(
        "branch", "shift_type", F.col("current_shift_count").cast("bigint").alias("current_shift_count"),
        rnd(F.col("current_shift_count") / F.col("_tot"), 4).alias("shift_share"),
        F.col("employees_available").cast("bigint").alias("employees_available"),
        rnd("_ah", 2).alias("avg_hours_per_shift"), rnd("_mh", 2).alias("median_hours_per_shift"),
        rnd(per_day, 2).alias("avg_staff_per_day"),
        rnd(F.col("_nwd") / F.greatest("_dwd", F.lit(1)), 2).alias("weekday_avg_staff"),
        rnd(F.col("_nwe") / F.greatest("_dwe", F.lit(1)), 2).alias("weekend_avg_staff"),
        rnd(mult, 4).alias("demand_multiplier"),
        rec.cast("bigint").alias("recommended_staff_per_day"),
        rnd("_mh", 1).alias("recommended_shift_hours"))


# ---------------------------------------------------------------- STF-5
def schedule_guidelines(daily: DataFrame, shifts: DataFrame) -> DataFrame:
    d = daily.groupBy("branch", "day_num").agg(
        F.min("day_of_week").alias("day_of_week"),
        F.avg("employees_on_duty").alias("_ae"), F.avg("total_hours").alias("_ahrs"),
        F.avg("coverage_span_hours").alias("_acov"))
    c = (shifts.where(F.col("shift_type").isNotNull())
         .groupBy("branch", "day_num", "shift_type").agg(F.count(F.lit(1)).alias("_k")))
    peak = c.groupBy("branch", "day_num").agg(
        F.min_by("shift_type", F.struct(-F.col("_k"), F.col("shift_type"))).alias("_peak"))
    j = d.join(peak, ["branch", "day_num"], "left")
    wknd = F.col("day_num").isin(WEEKEND_DAYS)
    rec = F.when(wknd, F.greatest(ceil9("_ae"), ceil9(F.col("_ae") + 0.5))).otherwise(ceil9("_ae"))
    j = j.withColumn("_rec", rec)
    return j.select(
        "branch", "day_of_week", "day_num", wknd.cast("int").alias("is_weekend"),
        rnd("_ae", 2).alias("observed_avg_employees"), rnd("_ahrs", 2).alias("observed_avg_total_hours"),
        rnd("_acov", 2).alias("observed_avg_coverage_span"),
        F.coalesce("_peak", F.lit(DEFAULT_PEAK_SHIFT)).alias("peak_shift_type"),
        F.col("_rec").cast("bigint").alias("recommended_employees"),
        F.when(F.col("_rec") > 0, rnd(F.col("_ahrs") / F.col("_rec"), 1))
         .otherwise(F.lit(DEFAULT_HOURS)).alias("recommended_hours_per_employee"))


# ---------------------------------------------------------------- STF-6
def hiring_action(profile: DataFrame, fsum: DataFrame) -> DataFrame:
    j = profile.select("branch", "num_employees").join(_growth(fsum), "branch", "left")
    g = F.coalesce(F.col("growth"), F.lit(0.0))
    action = F.when(g > HIRE_ABOVE, "HIRE").when(g < OPTIMIZE_BELOW, "OPTIMIZE").otherwise("MAINTAIN")
    extra = F.when(g > HIRE_ABOVE, F.greatest(F.lit(1), ceil9(F.col("num_employees") * g * HIRE_FACTOR))) \
        .otherwise(F.lit(0))
    reason = (F.when(g > HIRE_ABOVE, F.format_string(
        "The forecast is %s%% over the average month: more hands are needed.", rnd(g * 100, 0).cast("bigint")))
        .when(g < OPTIMIZE_BELOW, F.format_string(
            "The forecast is %s%% under the average month: cut extra hours, keep the staff.", rnd(F.abs(g) * 100, 0).cast("bigint")))
        .otherwise(F.lit("The forecast is near the average month: no change.")))
    return j.select("branch", "num_employees", rnd(g, 4).alias("growth"), action.alias("action"),
                    extra.cast("bigint").alias("suggested_additional"), reason.alias("reason"))


# ---------------------------------------------------------------- STF-7
def staffing_summary(profile: DataFrame, recs: DataFrame, sched: DataFrame, fsum: DataFrame) -> DataFrame:
    dom = recs.groupBy("branch").agg(
        F.min_by(F.struct("shift_type", "shift_share"),
                 F.struct(-F.col("shift_share"), _order_index("shift_type", SHIFT_ORDER))).alias("_d"))
    # at most one entry per kind of shift
    entry = F.format_string("%s: %s staff of %s h, demand x %s", "shift_type", "recommended_staff_per_day",
                            F.col("recommended_shift_hours").cast("decimal(12,1)"), F.col("demand_multiplier").cast("decimal(12,4)"))
    per_shift = recs.groupBy("branch").agg(F.array_sort(F.collect_list(
        F.struct(_order_index("shift_type", SHIFT_ORDER).alias("i"), entry.alias("x")))).alias("_recs"))
    wk = sched.groupBy("branch").agg(
        F.mode(F.when(F.col("is_weekend") == 0, F.col("recommended_employees")), True).alias("_wd"),
        F.mode(F.when(F.col("is_weekend") == 1, F.col("recommended_employees")), True).alias("_we"),
        F.min_by("day_of_week", F.struct(-F.col("observed_avg_total_hours"), F.col("day_num"))).alias("peak_day"))
    hire = hiring_action(profile, fsum).select("branch", F.col("action").alias("hiring_action"),
                                               "suggested_additional", F.col("reason").alias("hiring_reason"))
    net = profile.agg(
        F.sum("num_employees").cast("bigint").alias("network_total_employees"),
        rnd(F.avg("revenue_per_employee"), 2).alias("network_avg_revenue_per_employee"),
        F.min_by("branch", F.struct(-F.col("revenue_per_employee"), F.col("branch"))).alias("most_efficient_branch"))
    j = (profile.join(dom, "branch", "left").join(per_shift, "branch", "left").join(wk, "branch", "left").join(hire, "branch", "left")
         .crossJoin(F.broadcast(net)))
    return j.select(
        "branch", "num_employees", rnd(rnd("avg_shift_hours", 2), 1).alias("avg_shift_hours"),
        rnd(rnd("avg_employees_per_day", 2), 1).alias("avg_employees_per_day"),
        "revenue_per_hour", "revenue_per_employee",
        F.col("_d.shift_type").alias("dominant_shift"), F.col("_d.shift_share").alias("dominant_shift_share"),
        F.coalesce(F.array_join(F.col("_recs.x"), "; "), F.lit("")).alias("shift_recommendations"),
        F.coalesce("_wd", F.lit(0)).cast("bigint").alias("weekday_recommended_employees"),
        F.coalesce("_we", F.lit(0)).cast("bigint").alias("weekend_recommended_employees"),
        "peak_day", "hiring_action", "suggested_additional", "hiring_reason",
        "network_total_employees", "network_avg_revenue_per_employee", "most_efficient_branch",
        F.concat("most_efficient_branch", F.lit(" earns the most per employee: compare its shifts with the others'.")).alias("key_finding"))
