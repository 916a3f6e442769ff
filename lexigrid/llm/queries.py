"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm import (
    backoff, bpe, dimension_scan, html_tree, language_id, merkle, mixing, multi_index, norm_buckets, quality_pu, quality_rules, sharding, simhash)
from lexigrid.llm.common import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page, with the markup's declaration and the page's address as evidence."""
    return language_id.identify_pages(table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return dimension_scan.search(vectors, vectors.where("vec_id % 20 = 0"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_with_file(table(spark, sf_dir, "documents"), TOKENIZER))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pu.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.manifest(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return norm_buckets.top_products(vectors, vectors.where("vec_id % 100 = 0"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return multi_index.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_lm_scoring, op2_html_extraction, op3_language_id, op4_mixing, op5_nearest, op6_bpe,
                            op7_quality_rules, op8_sharding, op9_simhash, op10_quality, op11_merkle,
                            op12_exact_topk, op13_hard_negatives, pages_language)}
# operators whose rows plain SQL can give; the others are tested against brute force in tests/llm
ORACLES: dict[str, str] = {"op4_mixing": mixing.sql(), "op7_quality_rules": quality_rules.sql(),
                           "op11_merkle": merkle.sql(),
                           "op12_exact_topk": norm_buckets.sql(),
                           "op13_hard_negatives": multi_index.sql()}
