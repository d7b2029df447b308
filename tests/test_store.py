"""Stored results: computed once per state of the input files, never half visible."""

import os

import pytest
from pyspark.sql import functions as F

from retailops.sources.store import ResultStore, fingerprint


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def inputs(spark, tmp_path):
    path = f"{tmp_path}/in/a.parquet"
    spark.range(5).write.parquet(path)
    return path


def test_built_once_and_again_when_an_input_changes(spark, tmp_path, inputs):
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(inputs).agg(F.count("*").alias("n"), F.lit(None).cast("date").alias("day"), F.lit(0.1 + 0.2).alias("x"))

    def store():
        return ResultStore(spark, f"{tmp_path}/results", fingerprint(spark, [inputs]), {"a": 1})

    first = store().get("count", build)
    assert rows(first) == rows(store().get("count", build)) == [(5, None, 0.1 + 0.2)] and len(built) == 1
    assert store().get("count", build).dtypes == build().dtypes
    spark.range(2).write.mode("append").parquet(inputs)
    assert rows(store().get("count", build))[0][0] == 7 and len(built) == 3
    other = ResultStore(spark, f"{tmp_path}/results", fingerprint(spark, [inputs]), {"a": 2})
    assert other.find("count") is None and store().find("other") is None


def test_summaries_are_documents(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path), "s")
    df = spark.createDataFrame([(1, None, [1.5], "é\n")], "a long, b string, c array<double>, d string")
    got = store.get("one", lambda: df, summary=True)
    assert got.dtypes == df.dtypes and rows(got) == rows(df)
    text = [open(f"{d}/{f}").read() for d, _, fs in os.walk(f"{tmp_path}/one") for f in fs if f.endswith(".txt")]
    assert "".join(text) == '{"a":1,"b":null,"c":[1.5],"d":"é\\n"}\n'


def test_a_job_that_dies_leaves_no_result(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path), "s")
    with pytest.raises(Exception, match="no good"):
        store.get("r", lambda: spark.range(3).select(F.raise_error(F.concat(F.lit("no good"), F.col("id"))).cast("int").alias("x")))
    assert store.find("r") is None
    assert store.get("r", lambda: spark.range(3)).count() == 3


def test_the_first_of_two_equal_results_is_read(spark, tmp_path):
    a, b = (ResultStore(spark, str(tmp_path), "s") for _ in range(2))

    def late():  # another job names the same result while this one computes it
        b.get("r", lambda: spark.range(3))
        return spark.range(3)

    got = a.get("r", late)
    assert got.count() == 3 and a.index().count() == 2 and a.find("r") == b.find("r")


def test_fingerprint_reads_no_content(spark, inputs):
    files = spark.read.format("binaryFile").load(inputs).agg(F.sum("length"))
    assert "content" not in files._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    assert fingerprint(spark, [inputs]) == fingerprint(spark, [inputs])
