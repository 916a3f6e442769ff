"""From raw documents to token ids: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigrid.llm import bpe, language_id, mixing, quality_rules, simhash
from lexigrid.llm.common import shared_folder
from lexigrid.llm.queries import TOKENIZER


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is of a known language; ``lang`` becomes the language found."""
    return language_id.keep_identified(docs)


def rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rule and the divergence rules keep."""
    return quality_rules.keep_sound(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn with the probabilities that bring sources, languages and topics to their target shares."""
    return mixing.sample(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, and digests of the ids and of the decoded text."""
    return bpe.digests(bpe.encode_with_file(docs, TOKENIZER))


STAGES = [("language ID", language_stage), ("quality rules", rule_stage), ("near duplicates", dedup_stage),
          ("mixing", mixing_stage), ("token ids", encode_stage)]
# XXH64 fingerprints and byte-pair encoding can't be expressed in SQL; the tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents; each stage is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "corpus-pipeline")
    for k, (_, stage) in enumerate(STAGES):
        step = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(step)
        docs = spark.read.parquet(step)
    return docs
