"""Counts taken in one pass, fields cut in linear time and noise found by plain searches first: the same results as the plain forms."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from retailops.operators import baskets as B
from retailops.operators import parsers as PR
from retailops.sources import reports as R

BASKETS = [("N", 1, ["a", "b", "c", "d"]), ("N", 2, ["a", "c", "d"]), ("S", 3, ["b", "c"]), ("S", 4, ["a", "c", "d"]), ("S", 5, ["c", "d"])]


def baskets(spark):
    df = spark.createDataFrame(BASKETS, "branch string, order_id long, items array<string>")
    return df.withColumn("basket_size", F.size("items"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_one_pass_counts_items_pairs_and_triples(spark):
    want = {}
    for branch, _, items in BASKETS:
        for k in (1, 2, 3):
            for c in itertools.combinations(items, k):
                key = (branch, *c, *[None] * (3 - k))
                n, h = want.get(key, (0, 0))
                want[key] = (n + 1, h + (k == 1 and c[0] == items[0]))
    assert {tuple(r[:4]): tuple(r[4:]) for r in B.combo_counts(baskets(spark)).collect()} == want


def test_counts_of_one_pass_equal_those_of_their_own(spark):
    b, c = baskets(spark), B.combo_counts(baskets(spark))
    prices = spark.createDataFrame([("A", 2.0, "A")], "_pkey string, _price double, _ws string")
    assert rows(B.pairs_of_combos(c)) == rows(B.basket_counts(b))
    assert rows(B.triples_of_combos(c)) == rows(B.triple_counts(b))
    assert rows(B.branch_pairs_of_combos(c, prices, 2)) == rows(B.branch_pairs(b, prices, 2))


TEXTS = ["", ",", "a,b", 'x,"1,234.00",y', '"a""b,c",d,', 'a,"open,b', '"a,b","c,d"', 'a,"b"c",d,e"', "tail,,", 'mark\x01,"a,b",c', '"', None]


def test_fields_are_those_of_the_pattern(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = df.select("t", PR.csv_fields(F.col("t")).alias("f"), F.split("t", PR.CSV_SPLIT, -1).alias("want")).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert r.f == r.want, r.t


@pytest.mark.parametrize("text, noise, page", [
    ("WWW.Vendor.com", True, False), ("awww.x.com", False, False), ("copyright  ©", True, False), ("©", False, False), ("PAGE 1  of", False, True),
    ("pages of", False, False), (" ", True, False), (None, True, False), ("x", False, False)])
def test_noise_is_that_of_the_patterns(spark, text, noise, page):
    r = spark.createDataFrame([(text,)], "line string").select(R.is_noise("line").alias("n"), R.is_page_header("line").alias("p")).first()
    assert (r.n, r.p) == (noise, page)
