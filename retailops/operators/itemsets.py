"""Frequent itemsets of several items and the rules they give, by conditional prefix trees.

Every basket's frequent items, most frequent first, are a path.  A prefix tree is a table with a row per node: the path above it, its
item and the number of baskets that pass it; paths that begin alike share their nodes.  The conditional tree of an itemset holds, for
every node of its last item, the path above with that node's count, so a tree is derived from the one before it by cutting paths and
adding counts up.  Trees of all itemsets of one size stand in one table, keyed by the itemset, and an itemset is only
extended while it is frequent.  No task holds a tree: nodes are merged by a partially aggregated group-by, so an item that is
in every basket is dealt over all tasks like any other.

The frequent items are at most the sum of basket sizes divided by the least count, whatever the catalogue.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import rnd
from ..session import materialize

#: Items of the longest rule: antecedents of one to three items and a consequent.
MAX_ITEMS = 4


def frequent_paths(b: DataFrame, keys: Sequence[str], min_count: int) -> DataFrame:
    """(path ARRAY<STRING>): each basket's frequent items, the most frequent first (ties by item)."""
    held = b.select(*keys, F.explode("items").alias("item"))
    freq = held.groupBy("item").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_count)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col("item"))))
    return held.join(freq, "item").groupBy(*keys).agg(ordered.alias("_p")).select(F.col("_p.item").alias("path"))


def tree_nodes(paths: DataFrame) -> DataFrame:
    """Nodes (itemset, path, item, n) of the trees over ``paths`` (itemset, path, n)."""
    places = paths.select("itemset", "n", "path", F.posexplode("path").alias("_i", "item"))
    cut = places.select("itemset", F.expr("slice(path, 1, _i)").alias("path"), "item", "n")
    return cut.groupBy("itemset", "path", "item").agg(F.sum("n").alias("n"))


def frequent_itemsets(b: DataFrame, keys: Sequence[str], min_count: int, max_items: int = MAX_ITEMS) -> DataFrame:
    """(items ARRAY<STRING> sorted, size, n): all sets of one to ``max_items`` items in at least ``min_count`` baskets.

    ``b`` has one row per basket and distinct ``items``.  The trees of each size are stored, as the next size reads them twice.
    """
    none = F.array().cast("array<string>")
    nodes = materialize(tree_nodes(frequent_paths(b, keys, min_count).select(none.alias("itemset"), "path", F.lit(1).cast("bigint").alias("n"))))
    found = None
    for size in range(1, max_items + 1):
        grown = nodes.groupBy("itemset", "item").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
        sets = grown.select(F.array_sort(F.concat("itemset", F.array("item"))).alias("items"), F.lit(size).alias("size"), "n")
        found = sets if found is None else found.unionByName(sets)
        if size == max_items:
            break
        frequent = grown.select("itemset", "item")
        above = nodes.where(F.size("path") > 0).join(frequent, ["itemset", "item"], "left_semi").select(
            F.concat("itemset", F.array("item")).alias("itemset"), "path", "n")
        nodes = tree_nodes(above)
        nodes = materialize(nodes) if size < max_items - 1 else nodes
    return found


def itemset_rules(itemsets: DataFrame, n_baskets: int, min_confidence: float) -> DataFrame:
    """Rules {all items but one} -> {that item} of every itemset of two or more items (a stored table)."""
    rules = itemsets.where(F.col("size") >= 2).select("items", "n", F.explode("items").alias("consequent"))
    rules = rules.select(F.array_remove("items", F.col("consequent")).alias("antecedent"), "consequent", F.col("n").alias("itemset_count"))
    base = itemsets.select(F.col("items").alias("antecedent"), F.col("n").alias("antecedent_count"))
    single = itemsets.where(F.col("size") == 1).select(F.col("items")[0].alias("consequent"), F.col("n").alias("consequent_count"))
    r = rules.join(base, "antecedent").join(single, "consequent")
    conf = F.col("itemset_count") / F.col("antecedent_count")
    return r.where(conf >= min_confidence).select(
        F.array_join("antecedent", " + ").alias("antecedent"), "consequent", F.size("antecedent").alias("antecedent_size"),
        rnd(F.col("itemset_count") / F.lit(n_baskets), 4).alias("support"), rnd(conf, 4).alias("confidence"),
        rnd(conf / (F.col("consequent_count") / F.lit(n_baskets)), 4).alias("lift"),
        "itemset_count", "antecedent_count", "consequent_count")


def multi_item_rules(b: DataFrame, keys: Sequence[str], min_support: float, min_confidence: float,
                     max_items: int = MAX_ITEMS) -> DataFrame:
    """BSK-3 with antecedents of one to ``max_items - 1`` items; ``b`` is stored first, thresholds are on unrounded values."""
    b = materialize(b.select(*keys, "items"))
    n = b.count()
    least = max(1, next(k for k in range(int(min_support * n), int(min_support * n) + 3) if n == 0 or k / n >= min_support))
    return itemset_rules(materialize(frequent_itemsets(b, keys, least, max_items)), max(n, 1), min_confidence)
