"""Corpus pipeline: quality classifier, line dedup, SimHash near-dedup, decontamination, BPE round trip.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the columns of
``documents``.  ``run`` writes each stage's rows as Parquet into the shared checkpoint folder and reads them again, so a
lost executor never costs more than the stage that runs.  A stage's rows are deleted once the next stage's are written, so
at most two copies of the corpus are held.  Defined results for nulls, empty texts, repeated rows and extra
columns are those of the operators.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailops.llm import bpe, decontam, line_dedup, quality_cnn, simhash
from retailops.llm.common import ship
from retailops.session import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    ship(spark)
    return quality_cnn.keep(docs.select(*COLUMNS), _table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that spread over many sites go, but for copies of a spread text; ``n_chars`` follows the text where it changes."""
    done = line_dedup.clean(docs.select(*COLUMNS))
    return done.select(
        "row.doc_id", "text", "row.lang", "row.source",
        F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id."""
    ship(spark)
    return simhash.keep_one(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ship(spark)
    return decontam.keep_clean(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    ship(spark)
    return bpe.digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality", quality), ("line dedup", lines), ("near-dedup", near_duplicates),
          ("decontamination", decontaminate), ("encoding", encode)]

#: A trained network, sketches, links and merges are not SQL; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = _table(spark, sf_dir, "documents"), f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        if n:
            _drop(spark, f"{folder}/{n - 1}")
    return docs
