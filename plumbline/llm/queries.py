"""Registered queries of the operators, with the SQL that checks them where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import ann, audit, decontaminate, katz, langid, licenses, mixing, pii, quality, simhash, tokencount, toxicity, whitening
from plumbline.llm.common import crc_bucket, read


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_bucket(F.col("doc_id"), 4) == 2
    out = quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held_out, keep=["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_passages", "top_passage")


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.replace(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "text", "n_entities", F.array_join("kinds", ",").alias("kinds"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    out = toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held_out, keep=["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_bucket(F.col("doc_id"), 7) == 2
    out = katz.score(read(spark, sf_dir, "documents"), ~held_out, keep=["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_bucket(F.col("doc_id"), 4) == 2
    out = langid.identify(read(spark, sf_dir, "documents"), ~held_out, keep=["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache that outlives the call where the session names its folder in spark.plumbline.token.cache."""
    cache = spark.conf.get("spark.plumbline.token.cache", None)
    out = tokencount.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache_dir=cache, keep=["doc_id"])
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_words", *[c.alias(name) for name, c in licenses.digest(F.col("found")).items()])


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


_OPERATORS = [op1_quality, op2_pii_surrogates, op3_mixing, op4_toxicity, op5_katz_scores, op6_nearest_neighbours, op7_simhash_near_dedup, op8_language_id, op9_decontamination, op10_token_counts, op11_filter_audit, op12_license_scan, op13_embedding_whitening]
QUERIES = {f.__name__: f for f in _OPERATORS}
ORACLES: dict[str, str] = {"op11_filter_audit": audit.ORACLE_SQL, "op12_license_scan": licenses.oracle_sql()}
