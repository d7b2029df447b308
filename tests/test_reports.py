"""Report text written and read back: order across many tasks, files and splits."""

from pyspark.sql import functions as F

from retailops.sources.reports import read_report_lines, write_report_text


def read_small_splits(spark, path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        return sorted(tuple(r) for r in read_report_lines(spark, path).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_order_survives_many_writers_and_splits(spark, tmp_path):
    lines = spark.range(0, 6000, 1, 16).select(
        F.when(F.col("id") % 3 == 0, "North").otherwise("100%+ a b").alias("report_id"), F.col("id").alias("pos"),
        F.concat(F.lit("line "), F.col("id").cast("string")).alias("line")).repartition(9)
    write_report_text(lines, f"{tmp_path}/w")
    got = read_small_splits(spark, f"{tmp_path}/w/*/*.txt")
    want = [("100%+ a b", k, f"line {i}") for k, i in enumerate(i for i in range(6000) if i % 3)]
    want += [("North", k, f"line {i}") for k, i in enumerate(range(0, 6000, 3))]
    assert got == want


def test_plain_file_in_several_splits(spark, tmp_path):
    (tmp_path / "tax.txt").write_text("".join(f"row {i}\n" if i % 7 else "\n" for i in range(5000)))
    got = read_small_splits(spark, f"{tmp_path}/tax.txt")
    assert got == [("tax", i, f"row {i}" if i % 7 else "") for i in range(5000)]


def test_null_and_broken_lines(spark, tmp_path):
    rows = [("r", 0, "a\r\nb"), ("r", 1, None), (None, 0, "c")]
    write_report_text(spark.createDataFrame(rows, "report_id string, pos long, line string"), f"{tmp_path}/n")
    got = sorted(tuple(r) for r in read_report_lines(spark, f"{tmp_path}/n/*/*.txt").collect())
    assert got == [("r", 0, "a  b"), ("r", 1, ""), ("unnamed", 0, "c")]


def test_empty_table(spark, tmp_path):
    (tmp_path / "empty.txt").write_text("")
    assert read_report_lines(spark, f"{tmp_path}/empty.txt").count() == 0
