"""Scalar functions: expected values and edge cases of our own."""

import pytest
from pyspark.sql import functions as F

from retailops.functions import scalars as S


def one(spark, expr, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col(schema.split()[0])).alias("r")).first()["r"]


@pytest.mark.parametrize("text,expected", [
    ("7", 7.0), ("12,345,678.5", 12345678.5), ('"3,210.25"', 3210.25), ("-1,000.5", -1000.5), ("0", 0.0), ("", None),
    (None, None), ("seven", None), ("-", None), (" 8.25 ", 8.25), ("4f", None), ("NaN", None)])
def test_parse_number(spark, text, expected):
    assert one(spark, S.parse_number, text) == expected


@pytest.mark.parametrize("text,expected", [
    (" two words ", "two words"), ('"quoted"', "quoted"), ("p  q    r", "p q r"), ("MOCHA CUP.", "MOCHA CUP"),
    ("TEA,", "TEA"), (".,first", "first")])
def test_clean_text(spark, text, expected):
    assert one(spark, S.clean_text, text) == expected


@pytest.mark.parametrize("text,expected", [(" iced  mocha. ", "ICED MOCHA"), ("Q .", "Q "), ("c,d,,", "C,D")])
def test_item_key(spark, text, expected):
    assert one(spark, S.item_key, text) == expected


def test_word_set_key(spark):
    assert one(spark, S.word_set_key, "RING SMALL") == one(spark, S.word_set_key, "SMALL  RING")


@pytest.mark.parametrize("hour,label", [(0, "overnight"), (5, "overnight"), (6, "morning"), (12, "afternoon"),
                                        (17, "evening"), (22, "late_night"), (23, "late_night")])
def test_shift_type(spark, hour, label):
    assert one(spark, S.shift_type, hour, "h int") == label


@pytest.mark.parametrize("text,hours", [("08.30.00", 8.5), ("11:58:21", 11 + 58 / 60 + 21 / 3600), ("8:30", None),
                                        ("", None)])
def test_duration_hours(spark, text, hours):
    got = one(spark, S.duration_hours, text)
    assert (got is None and hours is None) or got == pytest.approx(hours)


def test_rnd_half_up(spark):
    assert one(spark, lambda c: S.rnd(c, 2), 1.005, "x double") == 1.01
    assert one(spark, lambda c: S.rnd(c, 0), 2.5, "x double") == 3.0


def test_safe_div_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(S.safe_div("a", "b")).collect()] == [0.0, 0.5]
