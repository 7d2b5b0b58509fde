"""Registered queries of the corpus operators; each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from . import bpe, embed_dedup, lexical, merkle, mixture, perm_index, quality, secret_scan, shard_tree, simhash, suffix_dedup, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHARDS = 24


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_suffix_dedup(spark, sf_dir):
    found = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_simhash_dedup(spark, sf_dir):
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op3_embedding_dedup(spark, sf_dir):
    return embed_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


@query
def op4_shard_tree(spark, sf_dir):
    tree = shard_tree.even_tree(SHARDS)
    found = shard_tree.place(_table(spark, sf_dir, "documents"), tree, shard_tree.grown(tree, SHARDS))
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


ORACLES["op4_shard_tree"] = shard_tree.place_sql(SHARDS)


@query
def op5_secret_scan(spark, sf_dir):
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, secret_scan.BASE), F.sha2(secret_scan.span_text(F.col("spans"), secret_scan.BASE), 256).alias("base_sha256"),
                        secret_scan.span_text(F.col("spans")).alias("spans"))


@query
def op6_source_mix(spark, sf_dir):
    found = mixture.mix(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query
def op7_quality_classifier(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    pools = materialise(quality.document_vectors(docs, quality.word_vectors(docs)), "vectors")
    found = quality.score(pools, quality.fit(pools, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op8_permutation_index(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return perm_index.search(vectors, vectors.where("vec_id % 20 = 0"))


@query
def op9_byte_bpe(spark, sf_dir):
    found = bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op10_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op11_lexical_search(spark, sf_dir):
    return lexical.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


ORACLES["op11_lexical_search"] = lexical.RANK_SQL


@query
def op12_merkle_manifest(spark, sf_dir):
    bare = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    found = merkle.manifest(_table(spark, sf_dir, "documents"), F.expr(merkle.TAMPERED), bare)
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


ORACLES["op12_merkle_manifest"] = merkle.MANIFEST_SQL
#: Fixed by the query's contract: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query
def op13_url_filter(spark, sf_dir):
    return url_filter.judge(_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


ORACLES["op13_url_filter"] = url_filter.judge_sql(URL_RULES)
