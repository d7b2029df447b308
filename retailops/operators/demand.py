"""Demand: monthly features, branch profile, and an ensemble forecast.

Everything runs on the branch x month table, which is pre-aggregated from
the order facts before any window is applied; windows are partitioned by
branch and the fitted models are ordinary aggregates (``regr_slope``,
``median``, ``stddev_pop``), so no branch's history is handed to Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import global_rank
from ..functions.scalars import rnd, safe_div

# Ensemble weights (trend, wma, growth), z for the interval,
# WMA window and drift per step, growth clamp.
ENSEMBLE_WEIGHTS = (0.35, 0.40, 0.25)
CI_Z = 1.96
WMA_WINDOW = 3
WMA_DRIFT = 0.02
GROWTH_CLAMP = (-0.3, 0.5)


def tagged_union(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of several sources in one table, by ``branch``: a column that a source lacks is NULL in its rows.

    The first source says which branches there are; rows of others without a branch belong to none.
    """
    return reduce(lambda a, b: a.unionByName(b.where(F.col("branch").isNotNull()), allowMissingColumns=True), others, first)


def _by_date(branch: str = "branch"):
    return Window.partitionBy(branch).orderBy("date")


# ---------------------------------------------------------------- DEM-1
def monthly_features(monthly: DataFrame) -> DataFrame:
    w = _by_date()
    wall = Window.partitionBy("branch")
    lag1 = F.lag("total", 1).over(w)
    share_base = F.sum("total").over(wall)
    return monthly.select(
        "branch", "month", "month_num", "year", "total", "date",
        lag1.alias("lag_1"),
        F.lag("total", 2).over(w).alias("lag_2"),
        rnd(F.try_divide(F.col("total"), lag1) - 1, 6).alias("mom_growth"),
        rnd(F.avg("total").over(w.rowsBetween(-1, 0)), 4).alias("rolling_avg_2"),
        rnd(F.avg("total").over(w.rowsBetween(-2, 0)), 4).alias("rolling_avg_3"),
        rnd(F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("cumulative_total"),
        rnd(F.when(share_base > 0, F.col("total") / share_base).otherwise(0.0), 6).alias("month_share"),
        (F.row_number().over(w) - 1).cast("int").alias("trend_idx"),
        F.month("date").alias("month_of_year"))


# ---------------------------------------------------------------- DEM-2
def channel_shares(division: DataFrame) -> DataFrame:
    """Delivery / dine-in / take-away shares of the ``ITEMS`` (all-divisions) row."""
    items = division.where(F.col("division") == "ITEMS")
    tot = F.col("delivery") + F.col("dine_in") + F.col("take_away")
    return items.select(
        "branch",
        safe_div("delivery", tot).alias("delivery_share"),
        safe_div("dine_in", tot).alias("table_share"),
        safe_div("take_away", tot).alias("takeaway_share"),
        F.col("total").alias("items_total"))


def branch_profile(monthly: DataFrame, division: DataFrame, avg_sales: DataFrame,
                   orders: DataFrame) -> DataFrame:
    w = _by_date()
    m = monthly.withColumn("_pct", F.try_divide(F.col("total"), F.lag("total", 1).over(w)) - 1)
    # one aggregate over all sources: see tagged_union
    items = channel_shares(division)
    seen = orders.groupBy("branch").agg(F.count_distinct("customer").alias("o_customers"), F.sum("num_orders").alias("o_orders"))
    facts = tagged_union(
        m.select("branch", F.lit(1).alias("m_row"), "date", "month", "total", "_pct"),
        items.select("branch", "delivery_share", "table_share", "takeaway_share"),
        avg_sales.select("branch", F.col("num_customers").alias("c_customers"), F.col("sales").alias("c_sales")),
        seen,
        division.where(F.col("total") > 0).select("branch", F.lit(1).alias("d_row")))
    mine = F.col("m_row") == 1
    g = facts.groupBy("branch").agg(
        F.sum("total").alias("_tot"), F.count("m_row").alias("num_months"),
        F.min_by("total", "date").alias("_first"), F.max_by("total", "date").alias("_last"),
        F.avg("_pct").alias("_mom"), F.stddev_samp("total").alias("_std"), F.avg("total").alias("_mean"),
        F.min_by("month", F.when(mine, F.struct(-F.col("total"), F.col("date")))).alias("peak_month"),
        *[F.max(c).alias(c) for c in ("delivery_share", "table_share", "takeaway_share")],
        F.sum("c_customers").alias("_c"), F.sum("c_sales").alias("_s"), F.max("o_customers").alias("_dc"),
        F.max("o_orders").alias("_do"), F.count("d_row").alias("_ad")).where(F.col("num_months") > 0)
    n = F.col("num_months")
    j = g.select(
        "branch", "delivery_share", "table_share", "takeaway_share", "_c", "_s", "_dc", "_do", "_ad", rnd("_tot", 2).alias("total_revenue"), n.cast("bigint").alias("num_months"),
        rnd(safe_div("_tot", n), 2).alias("avg_monthly_revenue"),
        rnd(F.when(n >= 2, safe_div(F.col("_last") - F.col("_first"), "_first")).otherwise(0.0), 4)
        .alias("overall_growth"),
        rnd(F.when(n >= 2, F.col("_mom")).otherwise(0.0), 4).alias("avg_mom_growth"),
        rnd(F.when(F.col("_mean") > 0, F.col("_std") / F.col("_mean")).otherwise(0.0), 4).alias("revenue_cv"),
        "peak_month")
    z = F.lit(0)
    return j.select(
        "branch", "total_revenue", "num_months", "avg_monthly_revenue", "overall_growth", "avg_mom_growth",
        "revenue_cv", "peak_month",
        *[rnd(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in ("delivery_share", "table_share", "takeaway_share")],
        F.coalesce("_c", z).cast("bigint").alias("total_customers"),
        rnd(F.coalesce(safe_div("_s", "_c"), F.lit(0.0)), 2).alias("avg_ticket_size"),
        F.coalesce("_dc", z).cast("bigint").alias("delivery_customers"),
        F.coalesce("_do", z).cast("bigint").alias("delivery_orders"),
        rnd(F.coalesce(safe_div("_do", "_dc"), F.lit(0.0)), 2).alias("avg_orders_per_delivery_customer"),
        F.coalesce("_ad", z).cast("bigint").alias("active_divisions"))


# ---------------------------------------------------------------- DEM-3
def forecast_dataset(features: DataFrame, profile: DataFrame) -> DataFrame:
    rank = global_rank(profile.select("branch", "total_revenue"),
                       [F.desc("total_revenue"), F.asc("branch")], "branch_revenue_rank", [(F.col("total_revenue"), True)])
    j = features.join(profile, "branch", "left").join(rank.drop("total_revenue"), "branch", "left")
    j = j.withColumn("revenue_ratio", rnd(F.try_divide(F.col("total"), F.col("avg_monthly_revenue")), 6))
    return j.drop("cumulative_total", "peak_month")


# ---------------------------------------------------------------- DEM-4..6
def model_inputs(features: DataFrame) -> DataFrame:
    """Per branch: OLS fit, WMA, growth rate, residual spread, last point."""
    w = _by_date()
    wd = Window.partitionBy("branch").orderBy(F.desc("date"))
    lag = F.lag("total", 1).over(w)
    m = features.select(
        "branch", "date", "trend_idx", "total",
        F.when(lag > 0, (F.col("total") - lag) / lag).alias("_rate"),
        F.row_number().over(wd).alias("_rd"),
        F.count(F.lit(1)).over(Window.partitionBy("branch")).alias("_n"))
    wn = F.least(F.col("_n"), F.lit(WMA_WINDOW))
    wt = F.when(F.col("_rd") <= wn, wn - F.col("_rd") + 1)
    fit = m.groupBy("branch").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.regr_slope("total", "trend_idx").alias("slope"),
        F.regr_intercept("total", "trend_idx").alias("intercept"),
        F.max("trend_idx").alias("last_idx"),
        F.max_by("total", "trend_idx").alias("last_value"),
        F.max("date").alias("last_date"),
        (F.sum(wt * F.col("total")) / F.sum(wt)).alias("wma"),
        F.min(wn).alias("wma_window"),
        F.count("_rate").alias("n_rates"),
        F.median("_rate").alias("_med"))
    lo, hi = GROWTH_CLAMP
    g = F.when(F.col("n_rates") > 0, F.least(F.greatest(F.col("_med"), F.lit(lo)), F.lit(hi))).otherwise(0.0)
    fit = fit.withColumn("growth_rate", g).drop("_med")
    # residual spread of the linear fit (population std; 0 for a single point)
    fitted = F.when(F.col("n_points") >= 2, F.col("intercept") + F.col("slope") * F.col("trend_idx")) \
        .otherwise(F.col("total"))
    res = (features.select("branch", "trend_idx", "total")
           .join(fit.select("branch", "n_points", "slope", "intercept"), "branch")
           .groupBy("branch").agg(F.stddev_pop(F.col("total") - fitted).alias("_rs")))
    return fit.join(res, "branch", "left").withColumn("residual_std", F.coalesce("_rs", F.lit(0.0))).drop("_rs")


def _trend_at(idx) -> F.Column:
    return F.when(F.col("n_points") >= 2, F.col("intercept") + F.col("slope") * idx).otherwise(F.col("last_value"))


def _clip0(c: F.Column) -> F.Column:
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def trend_fit(features: DataFrame) -> DataFrame:
    f = model_inputs(features)
    return f.select("branch", F.col("n_points").cast("bigint").alias("n_points"),
                    rnd("slope", 4).alias("slope"), rnd("intercept", 2).alias("intercept"),
                    rnd(_clip0(_trend_at(F.col("last_idx") + 1)), 2).alias("next_trend"))


def wma(features: DataFrame) -> DataFrame:
    f = model_inputs(features)
    return f.select("branch", F.col("wma_window").cast("int").alias("wma_window"), rnd("wma", 2).alias("wma"),
                    rnd(_clip0(F.col("wma") * (1 + WMA_DRIFT)), 2).alias("next_wma"))


def growth_rate(features: DataFrame) -> DataFrame:
    f = model_inputs(features)
    return f.select("branch", F.col("n_rates").cast("bigint").alias("n_rates"),
                    rnd("growth_rate", 6).alias("growth_rate"), "last_value",
                    rnd(_clip0(F.col("last_value") * (1 + F.col("growth_rate"))), 2).alias("next_growth"))


# ---------------------------------------------------------------- DEM-7
def forecast(features: DataFrame, horizon: int = 3,
             weights: tuple[float, float, float] = ENSEMBLE_WEIGHTS, z: float = CI_Z) -> DataFrame:
    """Next ``horizon`` months per branch, plus the actual months (steps_ahead 0)."""
    f = model_inputs(features)
    h = F.col("steps_ahead")
    fut = f.withColumn("steps_ahead", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    ft = _clip0(_trend_at(F.col("last_idx") + h))
    fw = _clip0(F.col("wma") * (1 + WMA_DRIFT * h))
    fg = _clip0(F.col("last_value") * F.pow(1 + F.col("growth_rate"), h))
    wt, ww, wg = weights
    fut = fut.select("branch", "steps_ahead", "residual_std",
                     F.add_months("last_date", h).alias("date"),
                     ft.alias("_ft"), fw.alias("_fw"), fg.alias("_fg"))
    fc = F.lit(wt) * F.col("_ft") + F.lit(ww) * F.col("_fw") + F.lit(wg) * F.col("_fg")
    ci = F.lit(z) * F.sqrt(h.cast("double")) * F.col("residual_std")
    fut = fut.select(
        "branch", F.year("date").alias("year"), F.date_format("date", "MMMM").alias("month"),
        F.month("date").alias("month_num"), "date",
        rnd(fc, 2).alias("forecast"), rnd(_clip0(fc - ci), 2).alias("ci_lower"), rnd(fc + ci, 2).alias("ci_upper"),
        rnd("_ft", 2).alias("forecast_trend"), rnd("_fw", 2).alias("forecast_wma"),
        rnd("_fg", 2).alias("forecast_growth"), rnd("residual_std", 2).alias("residual_std"),
        F.col("steps_ahead").cast("int").alias("steps_ahead"))
    null = F.lit(None).cast("double")
    act = features.select(
        "branch", F.year("date").alias("year"), F.date_format("date", "MMMM").alias("month"),
        F.month("date").alias("month_num"), "date",
        rnd("total", 2).alias("forecast"), rnd("total", 2).alias("ci_lower"), rnd("total", 2).alias("ci_upper"),
        null.alias("forecast_trend"), null.alias("forecast_wma"), null.alias("forecast_growth"),
        null.alias("residual_std"), F.lit(0).alias("steps_ahead"))
    return fut.unionByName(act)


# ---------------------------------------------------------------- DEM-8
def forecast_summary(fc: DataFrame, profile: DataFrame) -> DataFrame:
    fut = fc.where(F.col("steps_ahead") > 0)
    per = fut.groupBy("branch").agg(
        F.max(F.when(F.col("steps_ahead") == 1, F.col("forecast"))).alias("first_forecast"),
        F.max(F.when(F.col("steps_ahead") == 1, F.col("ci_lower"))).alias("first_ci_lower"),
        F.max(F.when(F.col("steps_ahead") == 1, F.col("ci_upper"))).alias("first_ci_upper"),
        F.sum("forecast").alias("_tot"), F.avg("forecast").alias("_avg"))
    per = per.join(profile.select("branch", F.col("avg_monthly_revenue").alias("_hist")), "branch", "left")
    hist = F.coalesce("_hist", F.lit(0.0))
    per = per.select(
        "branch", "first_forecast", "first_ci_lower", "first_ci_upper",
        rnd("_tot", 2).alias("horizon_total_forecast"), rnd("_avg", 2).alias("avg_monthly_forecast"),
        rnd(hist, 2).alias("historical_avg_monthly"),
        rnd(F.when(hist > 0, (F.col("_avg") - hist) / hist), 4).alias("forecast_vs_historical"))
    by_month = fut.groupBy("steps_ahead").agg(F.sum("forecast").alias("_m"))
    net = by_month.agg(rnd(F.sum("_m"), 2).alias("network_horizon_total"),
                       rnd(F.avg("_m"), 2).alias("network_monthly_avg"))
    g = F.coalesce("forecast_vs_historical", F.lit(0.0))
    best = per.agg(F.min_by("branch", F.struct(-g, F.col("branch"))).alias("fastest_growing_branch"),
                   F.max(g).alias("fastest_growth_rate"))
    return per.crossJoin(F.broadcast(net)).crossJoin(F.broadcast(best))
