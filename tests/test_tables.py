"""Round trips of tables and summaries, on small rows of our own."""

import datetime as dt

import pytest

from retailops.sources import tables as T

SCHEMA = "branch string, month date, total double, orders long"
ROWS = [("North", dt.date(2025, 5, 1), 12.5, 3), ("South", None, None, 0), (None, dt.date(2025, 6, 1), -1.0, None)]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_table_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame(ROWS, SCHEMA)
    T.write_table(df, str(tmp_path), "monthly", fmt)
    T.write_table(df, str(tmp_path), "monthly", fmt)  # overwrites
    back = T.read_table(spark, str(tmp_path), "monthly", df.schema, fmt, {"monthly"})
    assert back.dtypes == df.dtypes
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_unknown_table_is_an_error(spark, tmp_path):
    with pytest.raises(KeyError):
        T.read_table(spark, str(tmp_path), "nothing", known={"monthly"})


def test_summary_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("North", {"a": 1.5}, [("x, \"y\"", 2)], None), ("Süd", {}, [], 1.0)],
        "branch string, shares map<string,double>, top array<struct<item:string,n:long>>, score double")
    T.write_summary(df, str(tmp_path), "combo")
    back = T.read_summary(spark, str(tmp_path), "combo", df.schema)
    assert back.dtypes == df.dtypes
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
