"""Results kept between stages: computed once per state of the input files, read by everything that builds on them.

A result is named and keyed by the files it was computed from (path, size and time of change of each, read without their
content), the parameters and ``VERSION``.  It is written to a folder of its own and becomes visible by one row appended to the
table of results, which Spark commits as a whole: a job that dies leaves a folder nobody reads, and two jobs that compute
the same result leave two equal ones, of which the first named is read.  The schema stands in that row, so reading infers
nothing.  Small results that services read may be kept as JSON documents instead (``summary``).
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import read_summary, read_table, write_summary, write_table

#: Raise it when an operator gives other results from the same input.
VERSION = 1
INDEX = "name string, key string, folder string, form string, schema string, at timestamp"


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> str:
    """Digest of the Parquet files under the paths: their names, sizes and times of change."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(list(paths))
    row = files.agg(F.count("*").alias("n"), F.sum("length").alias("size"), F.sum(
        F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("h")).first()
    return f"{row.n}-{row.size}-{row.h}"


class ResultStore:
    """Named results under ``root``, of the input whose fingerprint is ``state``."""

    def __init__(self, spark: SparkSession, root: str, state: str, params: dict | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.state = hashlib.sha256(json.dumps([VERSION, state, params], sort_keys=True, default=str).encode()).hexdigest()

    def index(self) -> DataFrame:
        return read_table(self.spark, self.root, "index", StructType.fromDDL(INDEX))

    def find(self, name: str):
        """The row of the result, or None where there is none yet."""
        try:
            rows = self.index().where((F.col("name") == name) & (F.col("key") == self.state)).orderBy("at", "folder").limit(1).collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e.getCondition()):
                raise
            return None
        return rows[0] if rows else None

    def get(self, name: str, build: Callable[[], DataFrame], summary: bool = False) -> DataFrame:
        """The stored result ``name``; built, written and named first if this state of the input has none."""
        row = self.find(name)
        if row is None:
            df, folder = build(), f"{name}/{self.state[:16]}-{uuid.uuid4().hex}"
            (write_summary if summary else write_table)(df, self.root, folder)
            made = self.spark.createDataFrame([(name, self.state, folder, "json" if summary else "parquet", df.schema.json())],
                                              "name string, key string, folder string, form string, schema string")
            made.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/index")
            row = self.find(name)
        schema = StructType.fromJson(json.loads(row.schema))
        if row.form == "json":
            return read_summary(self.spark, self.root, row.folder, schema)
        return read_table(self.spark, self.root, row.folder, schema)
