"""Market-basket analytics: baskets, pairs, rules, affinity, prices, combos.

Plan shape.  Lines are filtered (cancellations, modifiers), normalised to an
item key and grouped once into a sorted distinct item array per basket; that
``groupBy`` has a map-side partial aggregate, so a hot basket key is combined
before the shuffle.  Pairs and triples are generated *inside* each basket row
with array higher-order functions (no self-join, no shuffle); only the pair /
triple counts are shuffled, again with partial aggregation.  For pairs, a basket
of more than ``BLOCK_ITEMS`` items is held in blocks, and every two of its
blocks meet in a task of their own.  Item and pair
count tables are bounded by the catalogue (distinct items), not by the number
of lines, so AQE is free to broadcast them at runtime.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import global_rank, minmax_scale
from ..functions.scalars import item_key, num_text, rnd, word_set_key

# Description patterns of modifiers, searched in the raw description ((?i) where case-insensitive).
# Modifier groups are the caller's own menu and have no default.
MODIFIER_PATTERNS = [
    r"^\[.*\]$",
    r"(?i)DELIVERY CHARGE",
    r"(?i)^NO\s",
    r"(?i)^PRESSED$",
    r"(?i)^REGULAR\.?$",
    r"(?i)WHIPPED CREAM\.\.\.",
    r"(?i)FULL FAT MILK$",
    r"(?i)^WATER$",
]
#: Items in one block of a large basket: two blocks that meet give at most some 25 million pairs to one task.
BLOCK_ITEMS = 5000
PARTS = 64  # parts in which the items of one basket meet its size
# Rule thresholds, combo-score weights, discount ladder.
MIN_SUPPORT = 0.02
MIN_CONFIDENCE = 0.1
SCORE_WEIGHTS = (0.45, 0.30, 0.25)  # lift, confidence, support


# ---------------------------------------------------------------- filters
def flag_cancellations(lines: DataFrame, qty_col: str = "qty") -> DataFrame:
    """FIL-5: ``is_cancellation`` = qty < 0."""
    return lines.withColumn("is_cancellation", F.col(qty_col) < 0)


def cancellation_split(lines: DataFrame, qty_col: str = "qty") -> DataFrame:
    """Rows and quantity per (branch, is_cancellation)."""
    f = flag_cancellations(lines, qty_col)
    return f.groupBy("branch", "is_cancellation").agg(
        F.count(F.lit(1)).alias("lines"), rnd(F.sum(qty_col), 2).alias("qty"))


def modifier_keys(item_meta: DataFrame, groups: Sequence[str] = (),
                  group_col: str = "grp", desc_col: str = "description") -> DataFrame:
    """Distinct upper/trimmed descriptions of items in a modifier group."""
    return (item_meta.where(F.col(group_col).isin(list(groups)))
            .select(F.upper(F.trim(desc_col)).alias("_mod_key")).distinct())


def drop_modifiers(lines: DataFrame, item_meta: DataFrame | None,
                   groups: Sequence[str] = (),
                   patterns: Sequence[str] = MODIFIER_PATTERNS,
                   desc_col: str = "description", group_col: str = "grp") -> DataFrame:
    """FIL-6: anti-join against the modifier set, then one OR-ed pattern test."""
    out = lines
    if item_meta is not None and groups:
        mods = modifier_keys(item_meta, groups, group_col, desc_col)
        out = out.join(mods, F.upper(F.trim(F.col(desc_col))) == F.col("_mod_key"), "left_anti")
    if patterns:
        out = out.where(~F.coalesce(F.col(desc_col).rlike("|".join(f"(?:{p})" for p in patterns)),
                                    F.lit(False)))
    return out


# ---------------------------------------------------------------- baskets
def basket_lines(lines: DataFrame, keys: Sequence[str], item_col: str = "description", item_meta: DataFrame | None = None,
                 groups: Sequence[str] = (), patterns: Sequence[str] = MODIFIER_PATTERNS,
                 desc_col: str = "description") -> DataFrame:
    """(keys..., item) of the lines that count: no cancellations, modifiers, empty items or NULL keys."""
    kept = drop_modifiers(lines.where(~F.col("is_cancellation")), item_meta, groups, patterns, desc_col)
    kept = kept.select(*keys, item_key(item_col).alias("item")).where(F.col("item").isNotNull() & (F.col("item") != ""))
    for k in keys:  # pandas groupby drops null keys
        kept = kept.where(F.col(k).isNotNull())
    return kept


def baskets(lines: DataFrame, keys: Sequence[str] = ("branch", "customer"),
            item_col: str = "description", item_meta: DataFrame | None = None,
            groups: Sequence[str] = (), patterns: Sequence[str] = MODIFIER_PATTERNS,
            desc_col: str = "description", min_size: int = 2) -> DataFrame:
    """BSK-1: (keys..., items ARRAY<STRING> sorted distinct, basket_size)."""
    kept = basket_lines(lines, list(keys), item_col, item_meta, groups, patterns, desc_col)
    b = kept.groupBy(*keys).agg(F.array_sort(F.collect_set("item")).alias("items"))
    b = b.withColumn("basket_size", F.size("items"))
    return b.where(F.col("basket_size") >= min_size)


def basket_blocks(kept: DataFrame, keys: Sequence[str], min_size: int = 2, block: int | None = None) -> DataFrame:
    """BSK-1 for baskets of any size: (keys..., items, basket_size, blocks, blk, lead) of ``basket_lines``.

    A basket of more than ``block`` items is cut into ``blocks`` rows of about that many items, by item hash, so that no row,
    buffer or task holds it whole.  ``lead`` marks the one block of each basket that holds its first item.
    """
    keys, block = list(keys), block or BLOCK_ITEMS
    items = kept.distinct()  # dealt by basket and item
    sizes = items.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("_size"), F.min("item").alias("_first"))
    large = sizes.where(F.col("_size") > block).withColumn("blocks", F.ceil(F.col("_size") / block).cast("int"))
    # the items of a large basket meet its size in parts: dealt by item too, its one row copied to each part
    large = large.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    placed = items.withColumn("_part", F.pmod(F.xxhash64("item"), F.lit(PARTS)).cast("int")).join(large, [*keys, "_part"], "left")
    placed = placed.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = placed.withColumn("blk", F.pmod(F.xxhash64("item"), "blocks").cast("int")).groupBy(*keys, "blocks", "blk").agg(
        F.array_sort(F.collect_list("item")).alias("items"), F.max("_size").alias("_size"), F.max("_first").alias("_first"))
    return cut.select(*keys, "items", F.coalesce("_size", F.size("items")).alias("basket_size"), "blocks", "blk",
                      ((F.col("blocks") == 1) | F.array_contains("items", F.col("_first"))).alias("lead")).where(
        F.col("basket_size") >= min_size)


def in_blocks(b: DataFrame) -> DataFrame:
    """Baskets held whole (``baskets``) in the form of ``basket_blocks``."""
    return b if "blocks" in b.columns else b.select("*", F.lit(1).alias("blocks"), F.lit(0).alias("blk"), F.lit(True).alias("lead"))


def block_keys(b: DataFrame) -> list[str]:
    return [c for c in b.columns if c not in ("items", "basket_size", "blocks", "blk", "lead")]


def pairs_inside(b: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Every unordered pair (item_a < item_b) of every row of ``b``, one row each."""
    first = b.select(*extra, "items", F.posexplode("items").alias("_i", "item_a"))
    return first.select(*extra, "item_a", F.explode(F.expr("slice(items, _i + 2, size(items))")).alias("item_b"))


def pairs_across(b: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Every pair of items in two blocks of one basket; each two blocks meet in a task of their own."""
    keys = block_keys(b)
    dealt = b.where(F.col("blocks") > 1).select(
        *keys, "blk", "items", F.explode(F.expr("sequence(0, blocks - 1)")).alias("_o")).where(F.col("_o") != F.col("blk"))
    side = F.struct("blk", "items")
    met = dealt.groupBy(*keys, F.least("blk", "_o").alias("_lo"), F.greatest("blk", "_o").alias("_hi")).agg(
        F.min(side).alias("_x"), F.max(side).alias("_y")).where(F.col("_x.blk") != F.col("_y.blk"))  # a block may be empty
    left = met.select(*extra, F.col("_y.items").alias("_ys"), F.explode("_x.items").alias("_a"))
    both = left.select(*extra, "_a", F.explode("_ys").alias("_b"))
    return both.select(*extra, F.least("_a", "_b").alias("item_a"), F.greatest("_a", "_b").alias("item_b"))


def basket_pairs(b: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Every unordered pair (item_a < item_b) of every basket, held whole or in blocks, one row each."""
    inside = pairs_inside(b, extra)
    return inside.unionByName(pairs_across(b, extra)) if "blocks" in b.columns else inside


def basket_triples(b: DataFrame) -> DataFrame:
    """Every combination item_1 < item_2 < item_3 of every basket, one row each.

    Each generator streams its rows; what it holds at once is one basket's items, never its combinations.
    """
    first = b.select("items", F.posexplode("items").alias("_i", "item_1"))
    second = first.select("items", "_i", "item_1", F.posexplode(F.expr("slice(items, _i + 2, size(items))")).alias("_j", "item_2"))
    return second.select("item_1", "item_2", F.explode(F.expr("slice(items, _i + _j + 3, size(items))")).alias("item_3"))


def combo_counts(b: DataFrame, extra: Sequence[str] = ("branch",)) -> DataFrame:
    """(extra..., item_1, item_2, item_3, n, heads): counts of items, pairs and triples in one pass over baskets held whole.

    A pair has NULL ``item_3``, an item NULL ``item_2`` as well; ``heads`` counts the baskets that the item stands first in.
    """
    extra, none = list(extra), "array(cast(null as string))"
    first = b.select(*extra, "items", F.posexplode("items").alias("_i", "item_1"))
    second = first.select(*extra, "items", "_i", "item_1", F.posexplode(F.expr(
        f"concat({none}, slice(items, _i + 2, size(items)))")).alias("_j", "item_2"))
    third = second.select(*extra, (F.col("_i") == 0).alias("_head"), "item_1", "item_2", F.explode(F.expr(
        f"if(_j = 0, {none}, concat({none}, slice(items, _i + _j + 2, size(items))))")).alias("item_3"))
    return third.groupBy(*extra, "item_1", "item_2", "item_3").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("item_2").isNull() & F.col("_head"), 1)).alias("heads"))


def pairs_of_combos(c: DataFrame) -> DataFrame:
    """``basket_counts`` of the baskets that ``combo_counts`` counted."""
    return c.where(F.col("item_3").isNull()).groupBy(F.col("item_1").alias("item_a"), F.col("item_2").alias("item_b")).agg(
        F.sum("n").alias("n"), F.sum("heads").alias("heads"))


def triples_of_combos(c: DataFrame, min_count: int = 2) -> DataFrame:
    """``triple_counts`` of the baskets that ``combo_counts`` counted."""
    t = (c.where(F.col("item_3").isNotNull()).groupBy("item_1", "item_2", "item_3").agg(F.sum("n").alias("co_occurrence"))
         .where(F.col("co_occurrence") >= min_count))
    return t.crossJoin(F.broadcast(c.agg(F.sum("heads").alias("n_baskets"))))


def branch_pairs_of_combos(c: DataFrame, prices: DataFrame, k: int = 10, branch_col: str = "branch") -> DataFrame:
    """``branch_pairs`` of the baskets that ``combo_counts`` counted per branch."""
    nb = c.groupBy(branch_col).agg(F.sum("heads").alias("_nb"))
    pc = c.where(F.col("item_2").isNotNull() & F.col("item_3").isNull()).select(
        branch_col, F.col("item_1").alias("item_a"), F.col("item_2").alias("item_b"), F.col("n").alias("co_purchase_count"))
    return rank_branch_pairs(pc, nb, prices, k, branch_col)


def basket_count(b: DataFrame) -> DataFrame:
    return in_blocks(b).agg(F.count(F.when(F.col("lead"), 1)).alias("n_baskets"))


def pair_counts(b: DataFrame) -> DataFrame:
    return basket_pairs(b).groupBy("item_a", "item_b").agg(
        F.count(F.lit(1)).alias("co_purchase_count"))


def copurchase_pairs(b: DataFrame) -> DataFrame:
    """BSK-2: pair counts and support = count / number of baskets (unrounded)."""
    n = F.broadcast(basket_count(b))
    return pair_counts(b).crossJoin(n).select(
        "item_a", "item_b", "co_purchase_count",
        (F.col("co_purchase_count") / F.col("n_baskets")).alias("support"))


def basket_counts(b: DataFrame) -> DataFrame:
    """(item_a, item_b, n, heads) in one pass over the baskets: pair counts; with NULL ``item_b`` the item's own count,
    where ``heads`` counts the baskets that the item stands first in (their sum is the number of baskets)."""
    first = in_blocks(b).select("items", "lead", F.posexplode("items").alias("_i", "item_a"))
    # the first item of the leading block is the first of the basket
    rows = first.select((F.col("lead") & (F.col("_i") == 0)).alias("_head"), "item_a", F.explode(F.expr(
        "concat(array(cast(null as string)), slice(items, _i + 2, size(items)))")).alias("item_b"))
    if "blocks" in b.columns:
        rows = rows.unionByName(pairs_across(b).withColumn("_head", F.lit(False)))
    return rows.groupBy("item_a", "item_b").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("item_b").isNull() & F.col("_head"), 1)).alias("heads"))


def association_rules(b: DataFrame, min_support: float = MIN_SUPPORT,
                      min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """BSK-3: A -> B in both directions, thresholds on unrounded values."""
    return rules_of_counts(basket_counts(b), min_support, min_confidence)


def rules_of_counts(counts: DataFrame, min_support: float = MIN_SUPPORT,
                    min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """BSK-3 over ``basket_counts``, which callers store: it is read for pairs, items and the number of baskets."""
    items = counts.where(F.col("item_b").isNull())
    n = F.broadcast(items.agg(F.sum("heads").alias("n_baskets")))
    freq = counts.where(F.col("item_b").isNotNull()).withColumnRenamed("n", "co_purchase_count").crossJoin(n).where(
        F.col("co_purchase_count") / F.col("n_baskets") >= min_support)
    # the two directions come from one row each: a generator, not a union/shuffle
    directed = freq.select(
        "co_purchase_count", "n_baskets",
        F.inline(F.array(
            F.struct(F.col("item_a").alias("antecedent"), F.col("item_b").alias("consequent")),
            F.struct(F.col("item_b").alias("antecedent"), F.col("item_a").alias("consequent")))))
    ic = items.select(F.col("item_a").alias("item"), F.col("n").alias("item_count"))
    r = (directed
         .join(ic.select(F.col("item").alias("antecedent"), F.col("item_count").alias("antecedent_count")),
               "antecedent")
         .join(ic.select(F.col("item").alias("consequent"), F.col("item_count").alias("consequent_count")),
               "consequent"))
    conf = F.col("co_purchase_count") / F.col("antecedent_count")
    cons_support = F.col("consequent_count") / F.col("n_baskets")
    r = r.where(conf >= min_confidence)
    return r.select(
        "antecedent", "consequent",
        rnd(F.col("co_purchase_count") / F.col("n_baskets"), 4).alias("support"),
        rnd(conf, 4).alias("confidence"),
        rnd(F.when(cons_support > 0, conf / cons_support).otherwise(0.0), 4).alias("lift"),
        F.col("co_purchase_count").alias("pair_count"),
        "antecedent_count", "consequent_count")


def item_affinity(b: DataFrame, k: int = 3) -> DataFrame:
    """BSK-4: appearances, mean basket size, distinct partners, top-k partners."""
    stats = (b.select(F.explode("items").alias("item"), "basket_size")
             .groupBy("item").agg(F.count(F.lit(1)).alias("basket_appearances"),
                                  rnd(F.avg("basket_size"), 2).alias("avg_basket_size")))
    pc = pair_counts(b)
    directed = pc.select(F.inline(F.array(
        F.struct(F.col("item_a").alias("item"), F.col("item_b").alias("partner"),
                 F.col("co_purchase_count").alias("n")),
        F.struct(F.col("item_b").alias("item"), F.col("item_a").alias("partner"),
                 F.col("co_purchase_count").alias("n")))))
    partners = directed.groupBy("item").agg(F.count(F.lit(1)).alias("unique_partners"))
    w = Window.partitionBy("item").orderBy(F.desc("n"), F.asc("partner"))
    top = directed.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    aggs = []
    for i in range(1, k + 1):
        aggs.append(F.max(F.when(F.col("_rn") == i, F.col("partner"))).alias(f"top_partner_{i}"))
        aggs.append(F.max(F.when(F.col("_rn") == i, F.col("n"))).alias(f"top_partner_{i}_count"))
    wide = top.groupBy("item").agg(*aggs)
    out = stats.join(partners, "item", "left").join(wide, "item", "left")
    cols = ["item", "basket_appearances", "avg_basket_size",
            F.coalesce("unique_partners", F.lit(0)).cast("bigint").alias("unique_partners")]
    for i in range(1, k + 1):
        cols += [f"top_partner_{i}",
                 F.coalesce(f"top_partner_{i}_count", F.lit(0)).cast("bigint").alias(f"top_partner_{i}_count")]
    return out.select(*cols)


# ---------------------------------------------------------------- prices
def price_table(items: DataFrame, name_col: str = "description",
                price_col: str = "unit_price") -> DataFrame:
    """BSK-5 index: mean positive unit price per item key, and per word set the
    price of the lexicographically last key (dict overwrite over sorted keys)."""
    exact = (items.where(F.col(price_col) > 0)
             .groupBy(item_key(name_col).alias("_pkey"))
             .agg(F.avg(price_col).alias("_price")))
    return exact.withColumn("_ws", word_set_key("_pkey"))


def attach_price(df: DataFrame, name_col: str, prices: DataFrame, out_col: str) -> DataFrame:
    """JON-3: exact key, else word-set key, else 0.0 (two left joins)."""
    exact = prices.select(F.col("_pkey").alias(f"_k_{out_col}"), F.col("_price").alias(f"_pe_{out_col}"))
    by_ws = (prices.groupBy("_ws")
             .agg(F.max_by("_price", "_pkey").alias(f"_pw_{out_col}"))
             .withColumnRenamed("_ws", f"_w_{out_col}"))
    j = (df.join(exact, F.col(name_col) == F.col(f"_k_{out_col}"), "left")
         .withColumn(f"_nw_{out_col}", word_set_key(name_col))
         .join(by_ws, F.col(f"_nw_{out_col}") == F.col(f"_w_{out_col}"), "left"))
    j = j.withColumn(out_col, F.coalesce(f"_pe_{out_col}", f"_pw_{out_col}", F.lit(0.0)))
    return j.drop(f"_k_{out_col}", f"_pe_{out_col}", f"_nw_{out_col}", f"_w_{out_col}", f"_pw_{out_col}")


def price_lookup(names: DataFrame, items: DataFrame, name_col: str = "name",
                 item_name_col: str = "description") -> DataFrame:
    """BSK-5: (name, price) for every name."""
    return attach_price(names, name_col, price_table(items, item_name_col), "price").select(
        name_col, rnd("price", 6).alias("price"))


# ---------------------------------------------------------------- combos
def discount_ladder(lift) -> F.Column:
    return (F.when(lift > 10, 5).when(lift > 5, 10).when(lift > 2, 15).otherwise(20)).cast("int")


def rank_pairs(rules: DataFrame, prices: DataFrame,
               weights: tuple[float, float, float] = SCORE_WEIGHTS) -> DataFrame:
    """BSK-6: one row per unordered pair (best confidence), scored and ranked."""
    w = Window.partitionBy(F.least("antecedent", "consequent"), F.greatest("antecedent", "consequent")) \
        .orderBy(F.desc("confidence"), F.asc("antecedent"))
    d = rules.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    d = attach_price(d, "antecedent", prices, "_pa")
    d = attach_price(d, "consequent", prices, "_pc")
    d = d.withColumn("combo_price", F.col("_pa") + F.col("_pc"))
    d = minmax_scale(d, ["lift", "support", "confidence"])
    wl, wc, ws = weights
    d = d.withColumn("combo_score", rnd(F.lit(wl) * F.col("lift_norm") + F.lit(wc) * F.col("confidence_norm")
                                        + F.lit(ws) * F.col("support_norm"), 4))
    d = d.select(
        F.concat_ws(" + ", "antecedent", "consequent").alias("combo_name"),
        "antecedent", "consequent", "support", "confidence", "lift", "pair_count",
        rnd("combo_price", 6).alias("combo_price"), "combo_score",
        rnd(F.col("combo_price") * F.col("pair_count"), 2).alias("estimated_revenue"),
        discount_ladder(F.col("lift")).alias("suggested_discount_pct"))
    return global_rank(d, [F.desc("combo_score"), F.asc("antecedent"), F.asc("consequent")], "rank",
                       lead=[(F.col("combo_score"), True), (F.substring("antecedent", 1, 4), False)])


def triple_counts(b: DataFrame, min_count: int = 2) -> DataFrame:
    """(item_1, item_2, item_3, co_occurrence, n_baskets) of the combinations in at least ``min_count`` baskets."""
    t = (b.where(F.col("basket_size") >= 3).transform(basket_triples)
         .groupBy("item_1", "item_2", "item_3").agg(F.count(F.lit(1)).alias("co_occurrence"))
         .where(F.col("co_occurrence") >= min_count))
    return t.crossJoin(F.broadcast(basket_count(b)))


def triples(b: DataFrame, prices: DataFrame, min_count: int = 2) -> DataFrame:
    """BSK-7: sorted 3-item combinations seen in at least ``min_count`` baskets."""
    return rank_triples(triple_counts(b, min_count), prices)


def rank_triples(t: DataFrame, prices: DataFrame) -> DataFrame:
    """BSK-7 over ``triple_counts``, which callers store: ranking reads it twice."""
    for i in (1, 2, 3):
        t = attach_price(t, f"item_{i}", prices, f"_p{i}")
    price = F.col("_p1") + F.col("_p2") + F.col("_p3")
    t = t.select(
        "item_1", "item_2", "item_3",
        F.concat_ws(" + ", "item_1", "item_2", "item_3").alias("combo_name"),
        "co_occurrence",
        rnd(F.col("co_occurrence") / F.col("n_baskets"), 4).alias("support"),
        rnd(price, 2).alias("combo_price"),
        rnd(price * F.col("co_occurrence"), 2).alias("estimated_revenue"),
        F.when(F.col("co_occurrence") >= 5, 10).otherwise(15).cast("int").alias("suggested_discount_pct"))
    return global_rank(t, [F.desc("co_occurrence"), F.asc("item_1"), F.asc("item_2"), F.asc("item_3")], "rank",
                       lead=[(F.col("co_occurrence"), True), (F.col("item_1"), False), (F.substring("item_2", 1, 4), False)])


def branch_pairs(b: DataFrame, prices: DataFrame, k: int = 10, branch_col: str = "branch") -> DataFrame:
    """BSK-8: top-k pairs per branch; branch_support = count / branch baskets.

    ``row_number() <= k`` is planned as a WindowGroupLimit, so each map task
    keeps only its local top-k per branch before the (few-keyed) shuffle."""
    nb = in_blocks(b).groupBy(branch_col).agg(F.count(F.when(F.col("lead"), 1)).alias("_nb"))
    pc = basket_pairs(b, [branch_col]).groupBy(branch_col, "item_a", "item_b").agg(
        F.count(F.lit(1)).alias("co_purchase_count"))
    return rank_branch_pairs(pc, nb, prices, k, branch_col)


def rank_branch_pairs(pc: DataFrame, nb: DataFrame, prices: DataFrame, k: int, branch_col: str) -> DataFrame:
    """BSK-8 over the pair counts ``pc`` and the basket counts ``nb`` (``_nb``) per branch."""
    w = Window.partitionBy(branch_col).orderBy(F.desc("co_purchase_count"), "item_a", "item_b")
    top = pc.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    top = top.join(nb, branch_col)
    top = attach_price(top, "item_a", prices, "_pa")
    top = attach_price(top, "item_b", prices, "_pb")
    price = F.col("_pa") + F.col("_pb")
    return top.select(
        branch_col, F.col("_rn").cast("int").alias("branch_rank"), "item_a", "item_b",
        F.concat_ws(" + ", "item_a", "item_b").alias("combo_name"), "co_purchase_count",
        rnd(F.col("co_purchase_count") / F.col("_nb"), 4).alias("branch_support"),
        rnd(price, 2).alias("combo_price"),
        rnd(price * F.col("co_purchase_count"), 2).alias("estimated_revenue"))


def combo_summary(two: DataFrame, three: DataFrame, by_branch: DataFrame,
                  top_pairs: int = 5, top_triples: int = 3) -> DataFrame:
    """BSK-9: one-row executive summary (flat columns; lists joined with '; ')."""
    def joined(df, n, expr):
        return (df.where(F.col("rank") <= n)
                .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", expr.alias("v")))),
                                              lambda x: x["v"]), "; ").alias("v")))

    c2 = two.agg(F.count(F.lit(1)).alias("total_2item_combos"))
    c3 = three.agg(F.count(F.lit(1)).alias("total_3item_combos"))
    top5 = joined(two, top_pairs, F.col("combo_name")).withColumnRenamed("v", "top_5_combos")
    top3 = joined(three, top_triples, F.col("combo_name")).withColumnRenamed("v", "top_3_triple_combos")
    rule = F.concat_ws(", ", F.concat(F.lit("lift "), num_text("lift", 4)),
                       F.concat(F.lit("confidence "), num_text("confidence", 4)),
                       F.concat(F.lit("support "), num_text("support", 4)),
                       F.concat(F.lit("price "), num_text("combo_price", 2)),
                       F.concat(F.lit("discount "), F.col("suggested_discount_pct").cast("string")))
    seen = F.concat_ws(", ", F.concat(F.lit("seen "), F.col("co_occurrence").cast("string")),
                       F.concat(F.lit("price "), num_text("combo_price", 2)))
    rules5 = joined(two, top_pairs, rule).withColumnRenamed("v", "top_5_rules")
    seen3 = joined(three, top_triples, seen).withColumnRenamed("v", "top_3_triple_figures")
    best = (by_branch.where(F.col("branch_rank") == 1)
            .agg(F.array_join(F.array_sort(F.collect_list(
                F.concat_ws(": ", "branch", "combo_name"))), "; ").alias("top_combo_per_branch")))
    lead = two.where(F.col("rank") == 1).select(F.concat(
        F.col("combo_name"), F.lit(" ranks first (lift "), num_text("lift", 1), F.lit("): baskets with "), F.col("antecedent"),
        F.lit(" hold "), F.col("consequent"), F.lit(" "), num_text("lift", 0), F.lit(" times as often as all baskets do. Bundle at "),
        F.col("suggested_discount_pct").cast("string"), F.lit("% off.")).alias("key_insight"))
    one = c2.crossJoin(c3).crossJoin(top5).crossJoin(rules5).crossJoin(top3).crossJoin(seen3).crossJoin(best)
    return one.join(lead, how="left")
