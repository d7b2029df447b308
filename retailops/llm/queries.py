"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (bpe, decontam, line_dedup, merkle, minhash, quality_cnn, quality_rules, secrets, shards, simhash, spelling,
               token_counts, toxicity)
from .common import documents
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_roundtrip": lambda s, d: bpe.digest(documents(s, d), public_tokenizers.path("byte_bpe_50k.tiktoken")),
    "op2_secret_scan": lambda s, d: secrets.report(documents(s, d)),
    "op3_simhash": lambda s, d: simhash.component_ids(documents(s, d)),
    "op4_line_dedup": lambda s, d: line_dedup.report(documents(s, d)),
    "op5_quality_cnn": lambda s, d: quality_cnn.report(documents(s, d), table(s, d, "labels")),
    "op6_toxicity": lambda s, d: toxicity.report(documents(s, d), table(s, d, "labels")),
    "op7_token_counts": lambda s, d: token_counts.token_counts(
        documents(s, d), public_tokenizers.path("byte_bpe_50k.json")),
    "op8_quality_rules": lambda s, d: quality_rules.verdicts(documents(s, d)),
    "op9_decontamination": lambda s, d: decontam.report(documents(s, d), table(s, d, "benchmark")),
    "op10_shards": lambda s, d: shards.shuffle_shards(documents(s, d)),
    "op11_spelling_variants": lambda s, d: spelling.variants(documents(s, d)),
    "op12_merkle_manifest": lambda s, d: merkle.report(documents(s, d)),
    "op13_minhash": lambda s, d: minhash.groups(documents(s, d)),
}
