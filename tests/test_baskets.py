"""Basket operators on hand-made micro tables."""

from pyspark.sql import functions as F

from retailops.functions.ranking import global_rank
from retailops.operators import baskets as B


def lines(spark, rows):
    return spark.createDataFrame(rows, "branch string, customer string, description string, qty double") \
        .withColumn("is_cancellation", F.col("qty") < 0)


def test_baskets_pairs_rules(spark):
    df = lines(spark, [
        ("N", "c1", "a", 1.0), ("N", "c1", "b", 1.0), ("N", "c1", "c", 1.0), ("N", "c1", "a.", 1.0),
        ("N", "c2", "a", 1.0), ("N", "c2", "b", 1.0),
        ("N", "c3", "a", 1.0), ("N", "c3", "b", -1.0),          # cancellation dropped -> size 1 -> no basket
        ("N", "c4", "water", 1.0), ("N", "c4", "c", 1.0),       # modifier pattern ^WATER$ removes one item
    ])
    bk = B.baskets(df, ["branch", "customer"], "description", None)
    got = {r["customer"]: r["items"] for r in bk.collect()}
    assert got == {"c1": ["A", "B", "C"], "c2": ["A", "B"]}
    pairs = {(r.item_a, r.item_b): (r.co_purchase_count, r.support) for r in B.copurchase_pairs(bk).collect()}
    assert pairs == {("A", "B"): (2, 1.0), ("A", "C"): (1, 0.5), ("B", "C"): (1, 0.5)}
    rules = B.association_rules(bk, 0.6, 0.1).collect()
    assert {(r.antecedent, r.consequent) for r in rules} == {("A", "B"), ("B", "A")}
    assert all(r.support <= 1 and r.lift == 1.0 for r in rules)


def test_triples_and_affinity(spark):
    df = lines(spark, [(None, str(i), x, 1.0) for i in range(3) for x in "abcd"])
    bk = B.baskets(df, ["customer"], "description", None)
    prices = spark.createDataFrame([("A", 1.0), ("b c", 2.0)], "description string, unit_price double")
    pt = B.price_table(prices)
    t = B.triples(bk, pt, 2).orderBy("rank").collect()
    assert len(t) == 4 and t[0].combo_name == "A + B + C" and t[0].co_occurrence == 3
    assert t[0].combo_price == 1.0  # B, C unknown -> 0.0 (word set "B C" is not a single item)
    aff = {r.item: r for r in B.item_affinity(bk).collect()}
    assert aff["A"].unique_partners == 3 and aff["A"].top_partner_1 == "B" and aff["A"].avg_basket_size == 4.0


def test_price_lookup_word_set(spark):
    items = spark.createDataFrame([("small ring", 2.0), ("small ring", 4.0), ("ring small x", 9.0)],
                                  "description string, unit_price double")
    names = spark.createDataFrame([("SMALL RING",), ("RING SMALL",), ("NOPE",)], "name string")
    got = {r.name: r.price for r in B.price_lookup(names, items).collect()}
    assert got == {"SMALL RING": 3.0, "RING SMALL": 3.0, "NOPE": 0.0}


def test_global_rank_is_dense_and_ordered(spark):
    df = spark.range(0, 5000).withColumn("v", F.when(F.col("id") % 50 > 0, (F.col("id") * 7919) % 1000))
    r = global_rank(df.repartition(7), [F.desc("v"), F.asc("id")], "rk", [(F.col("v"), True)]).orderBy("rk").collect()
    assert [x.rk for x in r] == list(range(1, 5001))
    assert all((a.v if a.v is not None else -1, -a.id) >= (b.v if b.v is not None else -1, -b.id) for a, b in zip(r, r[1:]))


def test_global_rank_keeps_every_row_with_many_partitions(spark):
    """2,000,000 rows, 200 shuffle partitions, default adaptive execution, wide and narrow use, heavy ties."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        n = 2_000_000
        df = spark.range(n).select("id", (F.col("id") % 3).alias("v"), F.format_string("%08d", F.col("id")).alias("name"),
                                   F.repeat(F.lit("w"), 60).alias("wide"))
        order = [F.desc("v"), F.asc("name")]
        lead = [(F.col("v"), True), (F.substring("name", 1, 5), False)]
        r = global_rank(df, order, "rk", lead)
        for x in (r, r.select("rk")):
            s = x.agg(F.count("*").alias("n"), F.count_distinct("rk").alias("d"), F.min("rk").alias("a"), F.max("rk").alias("b")).first()
            assert tuple(s) == (n, n, 1, n)
        assert [x.v for x in r.filter("rk in (1, 666666, 666667, 2000000)").orderBy("rk").collect()] == [2, 2, 1, 0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_large_basket_streams_its_pairs(spark):
    df = spark.range(2000).select(F.lit("c").alias("customer"), F.format_string("i%04d", F.col("id")).alias("item"))
    bk = df.groupBy("customer").agg(F.array_sort(F.collect_set("item")).alias("items"))
    assert B.basket_pairs(bk).count() == 2000 * 1999 // 2
    small = bk.select(F.slice("items", 1, 40).alias("items"))
    assert B.basket_triples(small).distinct().count() == 40 * 39 * 38 // 6


def test_itemsets_and_rules_equal_brute_force(spark):
    """All sets of up to four items, a hot item that is in every basket, ties, repeated and single-item baskets."""
    import random
    from itertools import combinations

    from retailops.operators import itemsets as I
    rng = random.Random(4)
    held = [["hot"] + sorted(rng.sample("abcdefgh", rng.randint(0, 6))) for _ in range(150)] + [["hot", "a", "b", "c", "d"]] * 20
    df = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(held)], "id int, items array<string>")
    counts = {}
    for x in held:
        for k in range(1, 5):
            for c in combinations(sorted(x), k):
                counts[c] = counts.get(c, 0) + 1
    want = {c: n for c, n in counts.items() if n >= 18}
    got = {tuple(r["items"]): r.n for r in I.frequent_itemsets(df, ["id"], 18).collect()}
    assert got == want and max(map(len, want)) == 4
    rules = I.multi_item_rules(df, ["id"], 18 / len(held), 0.3).collect()
    found = {(r.antecedent, r.consequent): (r.itemset_count, r.antecedent_count, r.consequent_count) for r in rules}
    assert found == {(" + ".join(x for x in c if x != y), y): (n, want[tuple(x for x in c if x != y)], want[(y,)])
                     for c, n in want.items() if len(c) > 1 for y in c if n / want[tuple(x for x in c if x != y)] >= 0.3}
    assert not I.multi_item_rules(df.limit(0), ["id"], 0.1, 0.1).count()


def test_large_baskets_in_blocks(spark):
    """Blocks give the pairs, counts, rules and affinities of whole baskets, and no block exceeds its bound by much."""
    rows = [("N", "big", f"i{i:03d}", 1.0) for i in range(60)] * 2 + [("S", "c", f"i{i:03d}", 1.0) for i in range(0, 60, 7)]
    rows += [("S", "d", "i003", 1.0), ("S", "e", "i001", 1.0), ("S", "e", "i002", 1.0), ("S", None, "i001", 1.0)]
    kept = B.basket_lines(lines(spark, rows), ["branch", "customer"])
    whole = B.baskets(lines(spark, rows), ["branch", "customer"])
    for block in (5, 9, 1000):
        cut = B.basket_blocks(kept, ["branch", "customer"], block=block)
        assert cut.agg(F.max(F.size("items"))).first()[0] <= max(3 * block, 3) and cut.where("lead").count() == 3
        assert B.basket_count(cut).first()[0] == 3
        for of in (B.copurchase_pairs, lambda b: B.basket_counts(b), lambda b: B.association_rules(b, 0.1, 0.1), B.item_affinity):
            assert sorted(map(str, of(cut).collect())) == sorted(map(str, of(whole).collect()))
        assert sorted(map(str, B.basket_pairs(cut, ["branch"]).collect())) == sorted(map(str, B.basket_pairs(whole, ["branch"]).collect()))


def test_a_basket_of_200000_items(spark):
    """The basket is dealt in blocks; its pairs are counted without ever being held (some of its block pairs here)."""
    df = spark.range(200_000).select(F.lit("N").alias("branch"), F.lit("x").alias("customer"), F.concat(F.lit("item"), "id").alias("item"))
    cut = B.basket_blocks(df, ["branch", "customer"])
    assert cut.agg(F.sum(F.size("items")), F.max(F.size("items")) < 6000, F.count("*")).first()[:] == (200_000, True, 40)
    two = cut.where("blk < 2")
    sizes = [r[0] for r in two.select(F.size("items")).collect()]
    assert B.pairs_across(two).count() == sizes[0] * sizes[1]
