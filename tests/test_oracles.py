"""Every registered key with an oracle matches DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracles import TABLES, key, norm

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    scols = sdf.columns
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(scols) == sorted(ocols)
    order = sorted(scols)
    S = sorted((tuple(norm(r[scols.index(c)]) for c in order) for r in sdf.collect()), key=key)
    O = sorted((tuple(norm(r[ocols.index(c)]) for c in order) for r in res.fetchall()), key=key)
    assert S == O


def test_every_key_runs(spark):
    for name, fn in E.queries().items():
        assert fn(spark, SF).columns, name


def test_entry(spark):
    assert E.entry(spark).count() >= 0
