"""Category growth (the reference's coffee / milkshake / frappe strategy).

Classification is a ``when`` chain of keyword ``contains`` tests.  Summaries
are one ``groupBy`` per (branch, category) in which each beverage row also
emits an ``all_beverages`` copy (a generator, not a second scan).  Set
differences between branches are ``left_anti`` joins; lists of missing
products show the first ``LISTED``, and all come as rows from ``missing_products``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import dense_rank_by, global_rank
from ..functions.scalars import rnd, safe_div

# The reference's keyword lists (first match wins, in this
# order), its beverage divisions, and the strategy constants.
CATEGORY_RULES = [
    ("coffee", ["COFFEE", "ESPRESSO", "LATTE", "CAPPUCCINO", "MOCHA", "AMERICANO", "MACCHIATO", "FLAT WHITE",
                "AFFOGATO"]),
    ("milkshake", ["MILKSHAKE"]),
    ("frappe", ["FRAPPE"]),
]
BEVERAGE_DIVISIONS = ["Hot-Coffee Based", "Frappes", "Shakes", "Hot and Cold Drinks", "Bev Add-ons"]
SUMMARY_CATEGORIES = ["coffee", "milkshake", "frappe", "other_beverage"]
FOCUS_CATEGORIES = ["coffee", "milkshake", "frappe"]
TARGET_FRACTION = 0.75
PROMOTE_QTY_GAP = 20
BOOST_BELOW = -0.3
#: Names that a list of missing products shows.
LISTED = 50


def classify(desc: str = "description", division: str = "division",
             rules: Sequence[tuple[str, Sequence[str]]] = CATEGORY_RULES,
             divisions: Sequence[str] = BEVERAGE_DIVISIONS) -> F.Column:
    up = F.upper(F.col(desc))
    out = None
    for cat, kws in rules:
        cond = None
        for kw in kws:
            c = up.contains(kw)
            cond = c if cond is None else (cond | c)
        out = F.when(cond, cat) if out is None else out.when(cond, cat)
    other = F.col(division).isin(list(divisions))
    return (out.when(other, "other_beverage") if out is not None else F.when(other, "other_beverage")) \
        .otherwise("non_beverage")


# ---------------------------------------------------------------- CAT-1
def classify_items(items: DataFrame, rules=CATEGORY_RULES, divisions=BEVERAGE_DIVISIONS) -> DataFrame:
    return items.withColumn("bev_category", classify("description", "division", rules, divisions))


# ---------------------------------------------------------------- CAT-2
def category_summary(items: DataFrame, division: DataFrame) -> DataFrame:
    """items must carry ``bev_category``.  Every branch gets all five rows."""
    cats = SUMMARY_CATEGORIES + ["all_beverages"]
    tagged = items.select(
        "branch", "description", "qty", "total_amount",
        F.explode(F.when(F.col("bev_category") != "non_beverage",
                         F.array(F.col("bev_category"), F.lit("all_beverages")))
                  .otherwise(F.array(F.col("bev_category")))).alias("category"))
    # one pass over the items: a row per branch and category, all held by their branch
    agg = tagged.groupBy("branch", "category").agg(
        F.count_distinct(F.when(F.col("category").isin(cats), F.col("description"))).alias("_np"), F.sum("qty").alias("_q"), F.sum("total_amount").alias("_r"))
    figures = F.struct("category", "_np", "_q", "_r")
    held = agg.groupBy("branch").agg(
        F.collect_list(F.when(F.col("category").isin(cats), figures)).alias("_all"),
        F.sum(F.when(F.col("category") == "all_beverages", None).otherwise(F.col("_r"))).alias("_isum"))
    scaffold = held.select("branch", "_all", "_isum", F.explode(F.array(*[F.lit(c) for c in cats])).alias("category"))
    mine = F.get(F.filter("_all", lambda x: (x["category"] == F.col("category")) & F.col("branch").isNotNull()), 0)
    items_total = division.where(F.col("division") == "ITEMS").select("branch", F.col("total").alias("_it"))
    j = scaffold.select("branch", "category", F.when(F.col("branch").isNotNull(), F.col("_isum")).alias("_isum"), mine.alias("_m")).select(
        "*", "_m._np", "_m._q", "_m._r").join(items_total, "branch", "left")
    bt = F.coalesce("_it", "_isum")
    q, r, npd = F.coalesce("_q", F.lit(0.0)), F.coalesce("_r", F.lit(0.0)), F.coalesce("_np", F.lit(0))
    return j.select(
        "branch", "category", npd.cast("bigint").alias("num_products"), q.alias("total_qty"),
        rnd(r, 2).alias("total_revenue"), rnd(safe_div(r, q), 2).alias("avg_unit_price"),
        rnd(safe_div(r, bt), 6).alias("revenue_share"), rnd(safe_div(q, npd), 2).alias("qty_per_product"))


# ---------------------------------------------------------------- CAT-3
def product_performance(items: DataFrame) -> DataFrame:
    bev = items.where(F.col("bev_category").isin(FOCUS_CATEGORIES))
    bev = dense_rank_by(bev, "branch", "total_amount", "branch_rank")
    net = bev.groupBy("description").agg(
        F.sum("qty").alias("network_qty"), F.sum("total_amount").alias("_nr"),
        F.count_distinct("branch").alias("branches_sold"), F.avg("qty").alias("_aq"))
    nb = items.agg(F.count_distinct("branch").alias("_nb"))
    j = bev.join(net, "description", "left").crossJoin(F.broadcast(nb))
    return j.select(
        "branch", "description", "bev_category", "division", "grp", "qty", "total_amount",
        rnd("unit_price", 6).alias("unit_price"), "branch_rank", "network_qty", rnd("_nr", 2).alias("network_revenue"),
        F.col("branches_sold").cast("bigint").alias("branches_sold"),
        rnd(F.col("branches_sold") / F.col("_nb"), 4).alias("branch_penetration"),
        rnd(F.when(F.col("_aq") > 0, (F.col("qty") - F.col("_aq")) / F.col("_aq")).otherwise(0.0), 4)
        .alias("qty_vs_network_avg"))


# ---------------------------------------------------------------- CAT-4
def _gaps(items: DataFrame, summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gaps, missing): branch and category pairs under the average, and the products that the benchmark branch sells and they lack."""
    cs = summary.where(F.col("category").isin(FOCUS_CATEGORIES))
    stats = cs.groupBy("category").agg(
        F.avg("revenue_share").alias("_avs"), F.avg("total_qty").alias("_avq"),
        F.min_by("branch", F.struct(-F.col("revenue_share"), F.col("branch"))).alias("benchmark_branch"),
        F.max("revenue_share").alias("_best"))
    g = cs.join(F.broadcast(stats), "category")  # a row per focus category
    g = g.withColumn("_sg", F.col("_avs") - F.col("revenue_share")).withColumn("_qg", F.col("_avq") - F.col("total_qty"))
    g = g.where((F.col("_sg") > 0) | (F.col("_qg") > 0))
    have = (items.where(F.col("bev_category").isin(FOCUS_CATEGORIES))
            .select("branch", F.col("bev_category").alias("category"), "description").distinct())
    best_items = (have.join(F.broadcast(stats.select("category", "benchmark_branch")), "category")
                  .where(F.col("branch") == F.col("benchmark_branch")).select("category", "description"))
    cand = g.select("branch", "category", "benchmark_branch").join(best_items, "category")
    return g, cand.join(have, ["branch", "category", "description"], "left_anti")


def missing_products(items: DataFrame, summary: DataFrame) -> DataFrame:
    """CAT-4, a row per missing product: (branch, category, description, benchmark_branch)."""
    return _gaps(items, summary)[1].select("branch", "category", "description", "benchmark_branch")


def growth_gaps(items: DataFrame, summary: DataFrame, names: int = LISTED) -> DataFrame:
    """CAT-4.  ``missing_product_list`` has the first ``names`` missing products by name; ``missing_products`` gives all as rows."""
    g, missing = _gaps(items, summary)
    count = missing.groupBy("branch", "category").agg(F.count(F.lit(1)).alias("_m"))
    # each task keeps its first names only, and a list has at most ``names``
    first = missing.withColumn("_rn", F.row_number().over(Window.partitionBy("branch", "category").orderBy("description")))
    listed = first.where(F.col("_rn") <= names).groupBy("branch", "category").agg(
        F.array_join(F.array_sort(F.collect_list("description")), "; ").alias("_ml"))
    mc = count.join(listed, ["branch", "category"], "left")
    j = g.join(mc, ["branch", "category"], "left")
    return j.select(
        "branch", "category", rnd("revenue_share", 6).alias("current_revenue_share"),
        rnd("_avs", 6).alias("network_avg_share"), rnd("_best", 6).alias("best_branch_share"),
        rnd("_sg", 6).alias("share_gap_vs_avg"), rnd(F.col("_best") - F.col("revenue_share"), 6).alias("share_gap_vs_best"),
        F.col("total_qty").alias("current_qty"), rnd("_avq", 2).alias("network_avg_qty"), rnd("_qg", 2).alias("qty_gap"),
        "benchmark_branch", F.coalesce("_m", F.lit(0)).cast("bigint").alias("missing_products"),
        F.coalesce("_ml", F.lit("")).alias("missing_product_list"))


# ---------------------------------------------------------------- CAT-5
def strategy_actions(gaps: DataFrame, summary: DataFrame) -> DataFrame:
    s = summary.select("branch", "category", F.col("total_qty").alias("_cq"), F.col("avg_unit_price").alias("_ap"))
    j = gaps.join(s, ["branch", "category"], "left")
    j = global_rank(j, [F.desc("share_gap_vs_best"), F.asc("branch"), F.asc("category")], "priority",
                    [(F.col("share_gap_vs_best"), True), (F.col("branch"), False)])
    qg, m = F.col("qty_gap"), F.col("missing_products")
    gap_units = rnd(qg, 0).cast("bigint").cast("string")
    action = (F.when((m > 0) & (qg > PROMOTE_QTY_GAP), "INTRODUCE_AND_PROMOTE").when(m > 0, "INTRODUCE")
              .when(qg > PROMOTE_QTY_GAP, "PROMOTE").otherwise("OPTIMIZE"))
    lacks = F.concat(F.col("benchmark_branch"), F.lit(" sells "), m.cast("string"), F.lit(" kinds of "), F.col("category"),
                     F.lit(" that this branch lacks"))
    has = F.concat(F.lit("All kinds of "), F.col("category"), F.lit(" that "), F.col("benchmark_branch"), F.lit(" sells are here"))
    under = F.concat(F.lit("; the branch is "), gap_units, F.lit(" units under the average."))
    text = (F.when((m > 0) & (qg > PROMOTE_QTY_GAP), F.concat(lacks, under)).when(m > 0, F.concat(lacks, F.lit(".")))
            .when(qg > PROMOTE_QTY_GAP, F.concat(has, under)).otherwise(F.concat(has, F.lit(", near the average quantity."))))
    cq = F.coalesce("_cq", F.lit(0.0))
    return j.select(
        "priority", "branch", "category", action.alias("action_type"), text.alias("description"),
        "current_revenue_share", rnd(F.col("best_branch_share") * TARGET_FRACTION, 6).alias("target_revenue_share"),
        "share_gap_vs_best", cq.alias("current_qty"), rnd(cq + qg * TARGET_FRACTION, 0).alias("target_qty"),
        rnd(F.when(qg > 0, qg * TARGET_FRACTION * F.coalesce("_ap", F.lit(0.0))).otherwise(0.0), 2)
        .alias("estimated_revenue_uplift"),
        "missing_products", "benchmark_branch")


# ---------------------------------------------------------------- CAT-6
def product_opportunities(perf: DataFrame) -> DataFrame:
    boost = perf.where(F.col("qty_vs_network_avg") < BOOST_BELOW).select(
        "branch", F.col("bev_category").alias("category"), F.col("description").alias("product"),
        F.lit("BOOST_EXISTING").alias("opportunity_type"), F.col("qty").alias("current_qty"),
        rnd(F.col("network_qty") / F.col("branches_sold"), 1).alias("network_avg_qty"),
        rnd(F.col("qty_vs_network_avg") * 100, 1).alias("qty_gap_pct"),
        rnd("total_amount", 2).alias("current_revenue"), rnd("unit_price", 2).alias("unit_price"))
    # every catalogue product a branch lacks: per product, the branches that do
    # not sell it = all branches (one-row array, bounded by the branch count)
    # minus the product's sellers; exploded, so no branch x catalogue join
    catalogue = perf.groupBy(F.col("bev_category").alias("category"), F.col("description").alias("product")).agg(
        F.avg("qty").alias("_aq"), F.min_by("unit_price", F.struct("branch", "division", "unit_price")).alias("_up"),
        F.collect_set("branch").alias("_sold"))
    all_b = perf.agg(F.collect_set("branch").alias("_all"))
    add = catalogue.crossJoin(F.broadcast(all_b)).select(
        F.explode(F.array_except("_all", "_sold")).alias("branch"), "category", "product",
        F.lit("ADD_NEW").alias("opportunity_type"), F.lit(0.0).alias("current_qty"),
        rnd("_aq", 1).alias("network_avg_qty"), F.lit(-100.0).alias("qty_gap_pct"), F.lit(0.0).alias("current_revenue"),
        rnd("_up", 2).alias("unit_price"))
    return boost.unionByName(add)


# ---------------------------------------------------------------- CAT-7
def category_growth_summary(summary: DataFrame, actions: DataFrame, opps: DataFrame) -> DataFrame:
    allb = summary.where(F.col("category") == "all_beverages")
    net = allb.agg(
        F.min_by("branch", F.struct(-F.col("revenue_share"), F.col("branch"))).alias("best_beverage_branch"),
        rnd(F.max("revenue_share"), 4).alias("best_beverage_share"),
        F.min_by("branch", F.struct(F.col("revenue_share"), F.col("branch"))).alias("worst_beverage_branch"),
        rnd(F.min("revenue_share"), 4).alias("worst_beverage_share"),
        rnd(F.avg("revenue_share"), 4).alias("network_avg_beverage_share"))
    tot = actions.agg(F.count(F.lit(1)).alias("total_actions"),
                      rnd(F.coalesce(F.sum("estimated_revenue_uplift"), F.lit(0.0)), 2).alias("total_estimated_uplift"))
    tot_o = opps.agg(F.count(F.lit(1)).alias("total_product_opportunities"),
                     F.count_distinct(F.when(F.col("opportunity_type") == "ADD_NEW", F.col("product"))).alias("new_products"))

    def percent(share):
        return rnd(share * 100, 1).cast("decimal(9,1)").cast("string")

    gap = F.concat("branch", F.lit(": "), "category", F.lit(" earns "), percent(F.col("current_revenue_share")),
                   F.lit("% of revenue, against "), percent(F.col("current_revenue_share") + F.col("share_gap_vs_best")),
                   F.lit("% at "), "benchmark_branch", F.lit("."))
    widest = actions.agg(F.max(F.when(F.col("priority") == 1, gap)).alias("_gap"))
    per = actions.groupBy("branch").agg(
        F.count(F.lit(1)).alias("num_actions"), rnd(F.sum("estimated_revenue_uplift"), 2).alias("estimated_uplift"),
        F.min_by(F.struct("category", "action_type", "description"), "priority").alias("_top"))
    po = opps.groupBy("branch").agg(
        F.count(F.when(F.col("opportunity_type") == "ADD_NEW", 1)).alias("products_to_add"),
        F.count(F.when(F.col("opportunity_type") == "BOOST_EXISTING", 1)).alias("products_to_boost"))
    j = per.join(po, "branch", "left").crossJoin(F.broadcast(net)).crossJoin(tot).crossJoin(tot_o).crossJoin(widest)
    leader = F.concat("best_beverage_branch", F.lit(" leads with "), percent(F.col("best_beverage_share")),
                      F.lit("% of its revenue from beverages."))
    menu = F.when(F.col("new_products") > 0, F.concat(
        F.col("new_products").cast("string"), F.lit(" products are missing from some branch's menu.")))
    return j.select(
        "branch", F.col("num_actions").cast("bigint").alias("num_actions"), "estimated_uplift",
        F.coalesce("products_to_add", F.lit(0)).cast("bigint").alias("products_to_add"),
        F.coalesce("products_to_boost", F.lit(0)).cast("bigint").alias("products_to_boost"),
        F.col("_top.category").alias("top_priority_category"), F.col("_top.action_type").alias("top_priority_action"),
        F.col("_top.description").alias("top_priority_description"),
        "best_beverage_branch", "best_beverage_share", "worst_beverage_branch", "worst_beverage_share",
        "network_avg_beverage_share", F.col("total_actions").cast("bigint").alias("total_actions"),
        F.col("total_product_opportunities").cast("bigint").alias("total_product_opportunities"),
        "total_estimated_uplift", F.concat_ws(" ", "_gap", leader, menu).alias("key_insights"))
