"""The corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; :func:`run` writes a
stage's result to the shared folder and reads it again as the next one's documents.

1. quality: documents scored under 0.3 by the classifier go; it is fitted on this input and ``labels``.
2. near_duplicates: one document of each SimHash component stays, the one with the smallest id.
3. secrets: spans of secrets in the text are replaced.
4. mix: documents are taken not at all, once or twice, so that sources come to their target words.
5. tokens: token ids of every document taken (doc_id, n_tokens, ids as little-endian 32-bit integers).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrel.llm import bpe, mixture, quality, secret_scan, simhash
from spectrel.session import materialise, ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.one_of_each(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return secret_scan.redact(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixture.take(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    found = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("secrets", secret_stage),
    ("mix", mix_stage), ("tokens", token_stage),
]
ORACLE_SQL = None  # no stage can be stated in SQL; tests/llm compares every stage with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
