"""Typed table read/write, JSON summaries and the dataset catalog (SRC-2 to SRC-5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, root: str, name: str, schema: StructType | None = None,
               fmt: str = "parquet", known: set[str] | None = None) -> DataFrame:
    """Typed scan of one dataset folder; an explicit schema avoids inference, a name outside ``known`` is an error."""
    if known is not None and name not in known:
        raise KeyError(f"unknown dataset {name!r}; known: {', '.join(sorted(known))}")
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", "true")
    return r.load(f"{root.rstrip('/')}/{name}")


def write_table(df: DataFrame, root: str, name: str, fmt: str = "parquet") -> str:
    """Overwrite one dataset folder (CSV with header when asked)."""
    path = f"{root.rstrip('/')}/{name}"
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    w.save(path)
    return path


def write_summary(df: DataFrame, root: str, name: str) -> str:
    """One JSON document per row, nested fields included, nulls kept."""
    path = f"{root.rstrip('/')}/{name}"
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
    return path


def read_summary(spark: SparkSession, root: str, name: str, schema: StructType) -> DataFrame:
    """The rows of a written summary under their schema."""
    return spark.read.text(f"{root.rstrip('/')}/{name}").select(F.from_json("value", schema).alias("r")).select("r.*")


def dataset_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per dataset: rows, column count, comma-joined column names."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("dataset"), "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.lit(", ".join(df.columns)).alias("column_names")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)
