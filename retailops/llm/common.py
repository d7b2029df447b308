"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailops.session import ensure_checkpoint_dir

#: White space of the word definition ``[^\x20\x09-\x0D]+``.
SPACE = r"[\x20\x09-\x0D]+"
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to Python workers that cannot import it from their own path (once per application)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp()  # the driver serves the file from here while it runs
    with zipfile.ZipFile(f"{folder}/{root.name}.zip", "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(f"{folder}/{root.name}.zip")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_key(*names: str) -> Column:
    """A key that is a pure function of the row: equal rows share it, so a hot NULL id spreads by its text."""
    return F.xxhash64(*[F.col(n) for n in names])


def text_blocks(batch: pa.RecordBatch, column: int, max_bytes: int):
    """Cut a batch into row ranges of about ``max_bytes`` of text: yields (start, stop, texts); NULL is empty."""
    col = batch.column(column)
    texts, start, size = [], 0, 0
    for i in range(len(col)):
        t = col[i].as_py() or ""
        texts.append(t)
        size += len(t)
        if size >= max_bytes:
            yield start, i + 1, texts
            texts, start, size = [], i + 1, 0
    if texts:
        yield start, len(col), texts
