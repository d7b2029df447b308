"""Registered queries: key -> callable(spark, sf_dir) -> DataFrame.

Each entry binds the driver's tables (``Bindings``) to one operator with the
parameters of ``params``; the operator itself is a plain DataFrame function.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import baskets as bsk
from ..operators import itemsets as its
from ..session import materialize
from ..sources.bindings import Bindings
from . import params as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ------------------------------------------------------------ shared pieces
# Baskets hold no cancelled lines, so every item of a modifier group that a line names is a sold one: the catalogue's
# groups serve as well as those of the sales, without a second pass over the lines.
# Modifiers are told by their description alone, so they leave the catalogue before it meets the lines.
def counted_lines(b: Bindings, by_order: bool = False) -> DataFrame:
    """Sales lines without those of modifiers."""
    return b.sales_lines(bsk.drop_modifiers(b.catalogue(), b.item_groups(), P.MOD_GROUPS, P.MOD_PATTERNS), by_order)


def order_baskets(b: Bindings) -> DataFrame:
    return bsk.baskets(counted_lines(b, by_order=True), P.BASKET_KEYS, P.BASKET_ITEM, patterns=())


def lifetime_baskets(b: Bindings) -> DataFrame:
    return bsk.baskets(counted_lines(b), P.LIFETIME_KEYS, P.LIFETIME_ITEM, patterns=())


def basket_blocks(b: Bindings, keys, item_col: str) -> DataFrame:
    """Baskets of any size, for pairs: a large one is cut into blocks."""
    kept = bsk.basket_lines(counted_lines(b, "order_id" in keys), keys, item_col, patterns=())
    return bsk.basket_blocks(kept, keys)


def brand_prices(b: Bindings) -> DataFrame:
    return materialize(bsk.price_table(b.sales_by_item(), P.BASKET_ITEM))  # a row per item, looked up per name column


def combos_of(b: Bindings) -> DataFrame:
    """Counts per branch of items, pairs and triples, for what ranks more than one of them: one pass over the baskets."""
    return b.kept("combo_counts", lambda: bsk.combo_counts(order_baskets(b)))


def two_item(b: Bindings, prices: DataFrame | None = None, combos: DataFrame | None = None) -> DataFrame:
    counts = materialize(bsk.pairs_of_combos(combos) if combos is not None else bsk.basket_counts(order_baskets(b)))
    rules = materialize(bsk.rules_of_counts(counts, P.MIN_SUPPORT, P.MIN_CONFIDENCE))
    return bsk.rank_pairs(rules, prices if prices is not None else brand_prices(b))


def three_item(b: Bindings, prices: DataFrame | None = None, combos: DataFrame | None = None) -> DataFrame:
    counts = materialize(bsk.triples_of_combos(combos, P.TRIPLE_MIN_COUNT) if combos is not None
                         else bsk.triple_counts(order_baskets(b), P.TRIPLE_MIN_COUNT))
    return bsk.rank_triples(counts, prices if prices is not None else brand_prices(b))


def per_branch_pairs(b: Bindings, prices: DataFrame | None = None, combos: DataFrame | None = None) -> DataFrame:
    prices = prices if prices is not None else brand_prices(b)
    if combos is not None:
        return bsk.branch_pairs_of_combos(combos, prices, P.BRANCH_TOP_K)
    return bsk.branch_pairs(order_baskets(b), prices, P.BRANCH_TOP_K)


# ------------------------------------------------------------ baskets
@register("baskets")
def q_baskets(spark, sf_dir):
    bk = lifetime_baskets(Bindings(spark, sf_dir))
    return bk.select(*P.LIFETIME_KEYS, F.array_join("items", "; ").alias("items"), "basket_size")


@register("copurchase_pairs")
def q_copurchase_pairs(spark, sf_dir):
    return bsk.copurchase_pairs(basket_blocks(Bindings(spark, sf_dir), P.LIFETIME_KEYS, P.LIFETIME_ITEM))


@register("association_rules")
def q_association_rules(spark, sf_dir):
    return bsk.association_rules(basket_blocks(Bindings(spark, sf_dir), P.BASKET_KEYS, P.BASKET_ITEM), P.MIN_SUPPORT, P.MIN_CONFIDENCE)


@register("itemset_rules")
def q_itemset_rules(spark, sf_dir):
    """BSK-3 with antecedents of one to three items."""
    return its.multi_item_rules(order_baskets(Bindings(spark, sf_dir)), P.BASKET_KEYS, P.ITEMSET_MIN_SUPPORT, P.ITEMSET_MIN_CONFIDENCE)


@register("item_affinity")
def q_item_affinity(spark, sf_dir):
    return bsk.item_affinity(order_baskets(Bindings(spark, sf_dir)))


@register("cancellation_split")
def q_cancellation_split(spark, sf_dir):
    return bsk.cancellation_split(Bindings(spark, sf_dir).sales_lines().drop("is_cancellation"))


@register("modifier_antijoin")
def q_modifier_antijoin(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    kept = bsk.drop_modifiers(b.sales_lines(), b.sales_by_item(), P.MOD_GROUPS, P.MOD_PATTERNS)
    return kept.groupBy("branch", "grp").agg(F.count(F.lit(1)).alias("lines"))


@register("price_lookup")
def q_price_lookup(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    p = b.table("part").select("p_brand", "p_name")
    names = p.select(F.inline(F.array(
        F.struct(F.upper(F.concat_ws(" ", "p_brand", "p_name")).alias("name")),
        F.struct(F.upper(F.concat_ws(" ", "p_name", "p_brand")).alias("name")),
        F.struct(F.upper(F.concat_ws(" ", F.lit("NO SUCH"), "p_name")).alias("name"))))).distinct()
    return bsk.price_lookup(names, b.sales_by_item(), "name", "description")


@register("rank_pairs")
def q_rank_pairs(spark, sf_dir):
    return two_item(Bindings(spark, sf_dir))


@register("triples")
def q_triples(spark, sf_dir):
    return three_item(Bindings(spark, sf_dir))


@register("branch_pairs")
def q_branch_pairs(spark, sf_dir):
    return per_branch_pairs(Bindings(spark, sf_dir))


@register("combo_summary")
def q_combo_summary(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    prices, combos = brand_prices(b), combos_of(b)
    # each read for its count and its top
    two, three = materialize(two_item(b, prices, combos)), materialize(three_item(b, prices, combos))
    return bsk.combo_summary(two, three, per_branch_pairs(b, prices, combos))


# ------------------------------------------------------------ demand
from ..operators import demand as dem  # noqa: E402


# What profiles, forecasts and scorecards share is rolled up once: rows per branch and month, channel or division, and a count
# per customer.
def monthly_of(b: Bindings) -> DataFrame:
    return b.kept("monthly_sales", b.monthly_sales)


def rollup_of(b: Bindings) -> DataFrame:
    return b.kept("sales_rollup", b.sales_rollup)


def avg_of(b: Bindings) -> DataFrame:
    return b.kept("avg_sales", b.avg_sales)


def orders_of(b: Bindings) -> DataFrame:
    return b.kept("customer_orders", lambda: b.customer_orders().select("branch", "customer", "num_orders"))


def features_of(b: Bindings) -> DataFrame:
    return dem.monthly_features(monthly_of(b))


def profile_of(b: Bindings) -> DataFrame:
    return dem.branch_profile(monthly_of(b), b.division_summary(rollup_of(b)), avg_of(b), orders_of(b))


def forecast_of(b: Bindings) -> DataFrame:
    return dem.forecast(features_of(b))


def forecast_summary_of(b: Bindings) -> DataFrame:
    return dem.forecast_summary(forecast_of(b), materialize(profile_of(b)))


@register("monthly_features")
def q_monthly_features(spark, sf_dir):
    return features_of(Bindings(spark, sf_dir))


@register("branch_profile")
def q_branch_profile(spark, sf_dir):
    return profile_of(Bindings(spark, sf_dir))


@register("forecast_dataset")
def q_forecast_dataset(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    return dem.forecast_dataset(features_of(b), profile_of(b))


@register("trend_fit")
def q_trend_fit(spark, sf_dir):
    return dem.trend_fit(features_of(Bindings(spark, sf_dir)))


@register("wma")
def q_wma(spark, sf_dir):
    return dem.wma(features_of(Bindings(spark, sf_dir)))


@register("growth_rate")
def q_growth_rate(spark, sf_dir):
    return dem.growth_rate(features_of(Bindings(spark, sf_dir)))


@register("forecast")
def q_forecast(spark, sf_dir):
    return forecast_of(Bindings(spark, sf_dir))


@register("forecast_summary")
def q_forecast_summary(spark, sf_dir):
    return forecast_summary_of(Bindings(spark, sf_dir))


# ------------------------------------------------------------ staffing
from ..operators import staffing as stf  # noqa: E402


def staff_profile_of(b: Bindings) -> DataFrame:
    return stf.staffing_profile(b.attendance(), monthly_of(b), P.ATTENDANCE_MONTH)


def shifts_of(b: Bindings) -> DataFrame:
    return stf.shift_patterns(b.attendance())


def recs_of(b: Bindings) -> DataFrame:
    return stf.shift_recommendations(shifts_of(b), forecast_summary_of(b))


def sched_of(b: Bindings) -> DataFrame:
    return stf.schedule_guidelines(stf.daily_coverage(b.attendance()), shifts_of(b))


@register("shift_patterns")
def q_shift_patterns(spark, sf_dir):
    return shifts_of(Bindings(spark, sf_dir))


@register("staffing_profile")
def q_staffing_profile(spark, sf_dir):
    return staff_profile_of(Bindings(spark, sf_dir))


@register("daily_coverage")
def q_daily_coverage(spark, sf_dir):
    return stf.daily_coverage(Bindings(spark, sf_dir).attendance())


@register("shift_recommendations")
def q_shift_recommendations(spark, sf_dir):
    return recs_of(Bindings(spark, sf_dir))


@register("schedule_guidelines")
def q_schedule_guidelines(spark, sf_dir):
    return sched_of(Bindings(spark, sf_dir))


@register("hiring_action")
def q_hiring_action(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    return stf.hiring_action(staff_profile_of(b), forecast_summary_of(b))


@register("staffing_summary")
def q_staffing_summary(spark, sf_dir):
    return staffing_summary_of(Bindings(spark, sf_dir))


def staffing_summary_of(b: Bindings, fsum: DataFrame | None = None) -> DataFrame:
    fsum = fsum if fsum is not None else materialize(forecast_summary_of(b))
    prof = materialize(staff_profile_of(b))
    shifts = shifts_of(b)
    recs = stf.shift_recommendations(shifts, fsum)
    sched = stf.schedule_guidelines(stf.daily_coverage(b.attendance()), shifts)
    return stf.staffing_summary(prof, recs, sched, fsum)


# ------------------------------------------------------------ expansion
from ..operators import expansion as exp  # noqa: E402


def card_of(b: Bindings) -> DataFrame:
    sums = rollup_of(b)  # branch x division x channel, feeds divisions and tax
    return exp.scorecard(monthly_of(b), b.division_summary(sums), avg_of(b), orders_of(b),
                         b.tax_report(sums), b.attendance(), P.CATEGORY_DIVISIONS)


def scored_of(b: Bindings) -> DataFrame:
    return exp.composite_score(materialize(card_of(b)))  # read for its bounds and its rows


def expansion_parts(b: Bindings, fsum: DataFrame | None = None):
    # one row per branch each, read by several branches of the plan below
    scored = materialize(scored_of(b))
    fsum = fsum if fsum is not None else materialize(forecast_summary_of(b))
    bench = exp.benchmarks(scored)
    health = exp.network_health(scored, fsum)
    ideal = exp.ideal_profile(scored, bench)
    risks = materialize(exp.risk_register(scored, fsum, exp.shortest_history(monthly_of(b))))
    verd = exp.verdict(health, risks)
    return scored, bench, health, ideal, risks, verd


@register("scorecard")
def q_scorecard(spark, sf_dir):
    return card_of(Bindings(spark, sf_dir))


@register("composite_score")
def q_composite_score(spark, sf_dir):
    return scored_of(Bindings(spark, sf_dir))


@register("benchmarks")
def q_benchmarks(spark, sf_dir):
    return exp.benchmarks(scored_of(Bindings(spark, sf_dir)))


@register("branch_comparison")
def q_branch_comparison(spark, sf_dir):
    return exp.branch_comparison(scored_of(Bindings(spark, sf_dir)))


@register("network_health")
def q_network_health(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    return exp.network_health(materialize(scored_of(b)), materialize(forecast_summary_of(b)))


@register("ideal_profile")
def q_ideal_profile(spark, sf_dir):
    scored = materialize(scored_of(Bindings(spark, sf_dir)))
    return exp.ideal_profile(scored, exp.benchmarks(scored))


@register("risk_register")
def q_risk_register(spark, sf_dir):
    return expansion_parts(Bindings(spark, sf_dir))[4]


@register("verdict")
def q_verdict(spark, sf_dir):
    return expansion_parts(Bindings(spark, sf_dir))[5]


@register("assessment_table")
def q_assessment_table(spark, sf_dir):
    scored, bench, health, ideal, risks, verd = expansion_parts(Bindings(spark, sf_dir))
    return exp.assessment_table(health, ideal, risks, verd)


@register("expansion_summary")
def q_expansion_summary(spark, sf_dir):
    scored, bench, health, ideal, risks, verd = expansion_parts(Bindings(spark, sf_dir))
    return exp.expansion_summary(scored, health, ideal, risks, verd)


# ------------------------------------------------------------ category growth
from ..operators import category as cat  # noqa: E402


def items_of(b: Bindings) -> DataFrame:
    return b.kept("sales_by_item", b.sales_by_item)


def items_c_of(b: Bindings, items: DataFrame | None = None) -> DataFrame:
    return cat.classify_items(items if items is not None else b.sales_by_item(), P.CATEGORY_RULES, P.CATEGORY_DIVISIONS)


def cat_summary_of(b: Bindings) -> DataFrame:
    return cat.category_summary(items_c_of(b), b.division_summary(rollup_of(b)))


def category_parts(b: Bindings):
    """(items, summary): read by several branches of the plans below, so each is computed once."""
    items = items_c_of(b, items_of(b))
    return items, materialize(cat.category_summary(items, b.division_summary(rollup_of(b))))


def actions_of(items: DataFrame, summary: DataFrame) -> DataFrame:
    # a row per branch and category, ranked over two passes
    return cat.strategy_actions(materialize(cat.growth_gaps(items, summary)), summary)


def opps_of(b: Bindings) -> DataFrame:
    return cat.product_opportunities(cat.product_performance(items_c_of(b)))


@register("classify_items")
def q_classify_items(spark, sf_dir):
    return items_c_of(Bindings(spark, sf_dir))


@register("category_summary")
def q_category_summary(spark, sf_dir):
    return cat_summary_of(Bindings(spark, sf_dir))


@register("product_performance")
def q_product_performance(spark, sf_dir):
    return cat.product_performance(items_c_of(Bindings(spark, sf_dir)))


@register("growth_gaps")
def q_growth_gaps(spark, sf_dir):
    return cat.growth_gaps(*category_parts(Bindings(spark, sf_dir)))


@register("missing_products")
def q_missing_products(spark, sf_dir):
    return cat.missing_products(*category_parts(Bindings(spark, sf_dir)))


@register("strategy_actions")
def q_strategy_actions(spark, sf_dir):
    return actions_of(*category_parts(Bindings(spark, sf_dir)))


@register("product_opportunities")
def q_product_opportunities(spark, sf_dir):
    return opps_of(Bindings(spark, sf_dir))


@register("category_growth_summary")
def q_category_growth_summary(spark, sf_dir):
    return growth_summary_of(*category_parts(Bindings(spark, sf_dir)))


def growth_summary_of(items: DataFrame, summary: DataFrame) -> DataFrame:
    actions = materialize(actions_of(items, summary))
    return cat.category_growth_summary(summary, actions, cat.product_opportunities(cat.product_performance(items)))


# ------------------------------------------------------------ report text (round trip)
from ..operators import parsers as prs  # noqa: E402
from ..sources import render as rnd_  # noqa: E402
from ..sources import reports as rep  # noqa: E402


def branch_names(b: Bindings) -> DataFrame:
    return b.table("region").select(F.col("r_name").alias("branch"))


@register("parse_tax_report")
def q_parse_tax_report(spark, sf_dir):
    return prs.parse_tax_report(rnd_.tax_report(Bindings(spark, sf_dir).tax_report()))


@register("parse_monthly_sales")
def q_parse_monthly_sales(spark, sf_dir):
    return prs.parse_monthly_sales(rnd_.monthly_sales(Bindings(spark, sf_dir).monthly_sales()))


@register("parse_avg_sales")
def q_parse_avg_sales(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    return prs.parse_avg_sales(rnd_.avg_sales(b.avg_sales()), branches=branch_names(b))


@register("parse_attendance")
def q_parse_attendance(spark, sf_dir):
    return prs.parse_attendance(rnd_.attendance(Bindings(spark, sf_dir).attendance()))


@register("parse_sales_by_item")
def q_parse_sales_by_item(spark, sf_dir):
    return prs.parse_sales_by_item(rnd_.sales_by_item(Bindings(spark, sf_dir).sales_by_item()))


@register("parse_sales_by_customer")
def q_parse_sales_by_customer(spark, sf_dir):
    return prs.parse_sales_by_customer(rnd_.sales_by_customer(Bindings(spark, sf_dir).sales_lines()))


@register("parse_customer_orders")
def q_parse_customer_orders(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    return prs.parse_customer_orders(rnd_.customer_orders(b.customer_orders()), branches=branch_names(b),
                                     customer_re=r"^Customer#\d+")


@register("parse_division_summary")
def q_parse_division_summary(spark, sf_dir):
    return prs.parse_division_summary(rnd_.division_summary(Bindings(spark, sf_dir).division_summary()))


@register("noise_filter")
def q_noise_filter(spark, sf_dir):
    """FIL-1/FIL-2 over the reports of all eight kinds; line numbers are not used, so none are computed."""
    b = Bindings(spark, sf_dir)
    lines = reduce(DataFrame.unionByName, [
        getattr(rnd_, printer)(getattr(b, table)()).select(F.concat(F.lit(f"{kind}:"), "report_id").alias("report_id"), "line")
        for kind, printer, table in REPORT_KINDS])
    noise = rep.is_noise("line") | rep.is_page_header("line")
    return lines.groupBy("report_id").agg(F.count(F.when(~noise, 1)).alias("kept_lines"),
                                          F.count(F.when(noise, 1)).alias("dropped_lines"))


@register("report_lines")
def q_report_lines(spark, sf_dir):
    """SRC-1/SRC-3: the lines of all document texts written as reports (one per language), read back in order."""
    import uuid
    from ..session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/retailops-reports/{uuid.uuid4().hex}"
    rep.write_report_text(text_lines(Bindings(spark, sf_dir)).withColumnRenamed("lang", "report_id"), path, ("doc_id", "at"))
    return rep.read_report_lines(spark, f"{path}/*/*.txt")


def text_lines(b: Bindings) -> DataFrame:
    """(doc_id, lang, at, line) for every line of every document text; NULL texts have none."""
    return b.table("documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("at", "line"))


@register("document_lines")
def q_document_lines(spark, sf_dir):
    """FIL-1, FIL-2, SCL-1 and SCL-2 over every line of the document texts, summed per document."""
    d = text_lines(Bindings(spark, sf_dir))
    noise = rep.is_noise("line") | rep.is_page_header("line")
    number = S.parse_number(F.regexp_extract("line", r"(\d[\d,]*(\.\d+)?)", 1))
    return d.groupBy("doc_id").agg(
        F.count(F.when(~noise, 1)).alias("kept_lines"), F.count(F.when(noise, 1)).alias("dropped_lines"),
        F.sum(F.when(~noise, F.length(S.clean_text("line")))).alias("clean_chars"),
        F.count(F.when(~noise, number)).alias("numbers"))


@register("dataset_catalog")
def q_dataset_catalog(spark, sf_dir):
    from ..sources.tables import dataset_catalog
    b = Bindings(spark, sf_dir)
    return dataset_catalog({n: getattr(b, n)() for n in TIDY})


#: kind, printer, tidy table
REPORT_KINDS = [("tax", "tax_report", "tax_report"), ("monthly", "monthly_sales", "monthly_sales"),
                ("avg", "avg_sales", "avg_sales"), ("attendance", "attendance", "attendance"),
                ("items", "sales_by_item", "sales_by_item"), ("customers", "sales_by_customer", "sales_lines"),
                ("orders", "customer_orders", "customer_orders"), ("divisions", "division_summary", "division_summary")]
TIDY = ["division_summary", "tax_report", "attendance", "sales_lines", "customer_orders", "sales_by_item",
        "monthly_sales", "avg_sales"]


# ------------------------------------------------------------ scalar functions over table text
from ..functions import scalars as S  # noqa: E402


@register("parse_number")
def q_parse_number(spark, sf_dir):
    li = Bindings(spark, sf_dir).table("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    t = F.format_number("l_extendedprice", 2)
    return li.select(
        "l_orderkey", "l_linenumber",
        S.parse_number(t).alias("plain"), S.parse_number(F.concat(F.lit(' "'), t, F.lit('" '))).alias("quoted"),
        S.parse_number(F.concat(F.lit("-"), t)).alias("negative"), S.parse_number(F.lit("-")).alias("dash"),
        S.parse_number(F.concat(F.lit("x"), t)).alias("junk"))


@register("clean_text")
def q_clean_text(spark, sf_dir):
    p = Bindings(spark, sf_dir).table("part").select("p_partkey", "p_name")
    messy = F.concat(F.lit('  "., '), F.replace(F.col("p_name"), F.lit(" "), F.lit("   ")), F.lit('.,"  '))
    return p.select("p_partkey", S.clean_text(messy).alias("cleaned"),
                    S.strip_description(F.concat(F.lit("  "), messy)).alias("stripped"))


@register("item_key")
def q_item_key(spark, sf_dir):
    s = Bindings(spark, sf_dir).sales_lines().select("description").distinct()
    return s.select("description", S.item_key(F.concat(F.lit(" "), F.lower("description"), F.lit(" ..,"))).alias("key"),
                    S.item_key(F.concat(F.col("description"), F.lit(" ."))).alias("key_blank"))


@register("word_set_key")
def q_word_set_key(spark, sf_dir):
    p = Bindings(spark, sf_dir).table("part").select("p_partkey", "p_name", "p_brand")
    return p.select("p_partkey",
                    S.word_set_key(F.concat_ws(" ", "p_brand", "p_name")).alias("ws"),
                    S.word_set_key(F.concat_ws("  ", "p_name", "p_brand", "p_name")).alias("ws_swapped"))


# ------------------------------------------------------------ stored results
from ..session import ensure_checkpoint_dir  # noqa: E402
from ..sources.store import ResultStore, fingerprint  # noqa: E402

#: Results that lookups, answers and summaries read; each is computed once per state of the input files.
RESULTS: dict[str, Callable[[Bindings], DataFrame]] = {
    "forecast_summary": lambda b: forecast_summary_of(b),
    "composite_score": lambda b: scored_of(b),
    "risk_register": lambda b: exp.risk_register(result(b, "composite_score"), result(b, "forecast_summary"),
                                                 exp.shortest_history(monthly_of(b))),
    "network_health": lambda b: exp.network_health(result(b, "composite_score"), result(b, "forecast_summary")),
    "verdict": lambda b: exp.verdict(result(b, "network_health"), result(b, "risk_register")),
    "staffing_summary": lambda b: staffing_summary_of(b, result(b, "forecast_summary")),
    "category_growth_summary": lambda b: growth_summary_of(*category_parts(b)),
    "prices": lambda b: bsk.price_table(items_of(b), P.BASKET_ITEM),
    "rank_pairs": lambda b: two_item(b, result(b, "prices"), combos_of(b)),
    "triples": lambda b: three_item(b, result(b, "prices"), combos_of(b)),
    "branch_pairs": lambda b: per_branch_pairs(b, result(b, "prices"), combos_of(b)),
    "headlines": lambda b: ans.headlines(*[result(b, n) for n in (
        "rank_pairs", "branch_pairs", "forecast_summary", "verdict", "network_health", "staffing_summary", "category_growth_summary")]),
}
SUMMARIES = {"verdict", "network_health"}  # documents of one row
SOURCES = ["region", "nation", "customer", "part", "orders", "lineitem", "events"]


def result(b: Bindings, name: str) -> DataFrame:
    if not hasattr(b, "store"):
        state = fingerprint(b.spark, [f"{b.sf_dir}/{t}.parquet" for t in SOURCES])
        params = {k: v for k, v in vars(P).items() if k.isupper()}
        b.store = ResultStore(b.spark, f"{ensure_checkpoint_dir(b.spark)}/retailops-results", state, params)
    return b.store.get(name, lambda: RESULTS[name](b), name in SUMMARIES)


# ------------------------------------------------------------ answers
from ..operators import answers as ans  # noqa: E402


def nation_branches(b: Bindings) -> DataFrame:
    """Link candidates in list order: longest names first (NATION_12 before NATION_1)."""
    n = b.table("nation").select(F.col("n_name").alias("branch"), "n_nationkey")
    w = Window.orderBy(F.desc(F.length("branch")), "n_nationkey")  # 25 rows by the schema
    return n.select("branch", F.row_number().over(w).alias("list_pos"))


def region_branches(b: Bindings) -> DataFrame:
    r = b.table("region").select(F.col("r_name").alias("branch"))
    return r.select("branch", F.row_number().over(Window.orderBy("branch")).alias("list_pos"))


@register("route_questions")
def q_route_questions(spark, sf_dir):
    return ans.route_questions(Bindings(spark, sf_dir).questions())


@register("extract_branch")
def q_extract_branch(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    return ans.extract_branch(b.questions(), nation_branches(b))


def link_names(b: Bindings) -> DataFrame:
    r = b.table("region").select("r_name")
    n = b.table("nation").select("n_name")
    return (r.select(F.lower("r_name").alias("name"))
            .unionByName(r.select(F.concat("r_name", F.lit(" store")).alias("name")))
            .unionByName(r.select(F.substring("r_name", 1, 3).alias("name")))
            .unionByName(n.select(F.col("n_name").alias("name"))))


@register("link_branch")
def q_link_branch(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    return ans.link_branch(link_names(b), region_branches(b))


@register("branch_lookup")
def q_branch_lookup(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    req = b.table("region").select(F.lower("r_name").alias("name"))
    return ans.branch_lookup(req, result(b, "branch_pairs"), 5)


def topic_lookup(b: Bindings, table: DataFrame) -> DataFrame:
    return ans.topic_lookup(link_names(b), table, region_branches(b))


@register("demand_lookup")
def q_demand_lookup(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    return topic_lookup(b, result(b, "forecast_summary"))


@register("staffing_lookup")
def q_staffing_lookup(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    return topic_lookup(b, result(b, "staffing_summary"))


@register("beverage_lookup")
def q_beverage_lookup(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    return topic_lookup(b, result(b, "category_growth_summary"))


@register("answer_questions")
def q_answer_questions(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    home = b.geo().select(F.col("n_name").alias("place"), "branch")  # a nation belongs to one region, the branch
    return ans.answer_questions(b.questions(), nation_branches(b), home, result(b, "headlines"))


@register("full_summary")
def q_full_summary(spark, sf_dir):
    b = Bindings(spark, sf_dir)
    return ans.full_summary(*[result(b, n) for n in (
        "rank_pairs", "triples", "forecast_summary", "verdict", "network_health", "staffing_summary", "category_growth_summary")])


@register("branch_list")
def q_branch_list(spark, sf_dir):
    return ans.branch_list(result(Bindings(spark, sf_dir), "forecast_summary"))
