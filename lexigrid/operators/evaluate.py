"""Scoring encoders: does a symbol's vector lead back to its own domain?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.vectors import cosine_sim
from lexigrid.operators import similarity

SYMBOL = ["model", "true_domain", "symbol"]


def predictions(symbols: DataFrame, domains: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` domains nearest to each symbol under its own model.

    ``symbols``: model, true_domain, symbol, vec.  ``domains``: model, predicted_domain, vec.
    Returns model, true_domain, symbol, predicted_domain, score, rank.
    """
    found = similarity.nearest(symbols.select(*SYMBOL, "vec"), domains.select("model", "predicted_domain", "vec"), k,
                               SYMBOL, "predicted_domain", group=["model"])
    return found.select(*SYMBOL, "predicted_domain", "score", "rank")


def _pct(part: Column, whole: Column) -> Column:
    return F.round(part * 100.0 / whole, 1)


def accuracy(matches: DataFrame) -> DataFrame:
    """Per model: symbols, hits at rank 1 and within all ranks kept."""
    right = F.col("true_domain") == F.col("predicted_domain")
    per_symbol = matches.groupBy(*SYMBOL).agg(
        F.bool_or(right & (F.col("rank") == 1)).alias("_one"), F.bool_or(right).alias("_any"))
    return per_symbol.groupBy("model").agg(
        F.count("*").alias("total"), F.count_if("_one").alias("top1_correct"), F.count_if("_any").alias("topk_correct"),
        _pct(F.count_if("_one"), F.count("*")).alias("top1_pct"), _pct(F.count_if("_any"), F.count("*")).alias("topk_pct"))


def domain_accuracy(matches: DataFrame, models: list[str]) -> DataFrame:
    """Per true domain: correct first predictions, one column per model."""
    right = F.col("true_domain") == F.col("predicted_domain")
    return matches.where(F.col("rank") == 1).groupBy("true_domain").agg(
        *[F.count_if(right & (F.col("model") == m)).alias(f"{m}_correct") for m in models],
        F.count_distinct("symbol").alias("out_of"))


def score_gap(matches: DataFrame) -> DataFrame:
    """Per model: mean best and second-best score and their distance."""
    one, two = F.avg(F.when(F.col("rank") == 1, F.col("score"))), F.avg(F.when(F.col("rank") == 2, F.col("score")))
    return matches.groupBy("model").agg(
        F.round(one, 3).alias("avg_top1_score"), F.round(two, 3).alias("avg_top2_score"), F.round(one - two, 3).alias("avg_gap"))


def misclassified(matches: DataFrame) -> DataFrame:
    return matches.where((F.col("rank") == 1) & (F.col("true_domain") != F.col("predicted_domain"))).select(
        *SYMBOL, "predicted_domain", F.round("score", 3).alias("score"))


def spread(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """Smallest, 10/25/50/75 % and largest score per group, exact.

    Scores have ``DIGITS`` places, so a group has at most two million different ones; they
    are counted first, and the percentiles work on the counts.
    """
    at = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75}
    counted = values.where(F.col(value).isNotNull()).groupBy(
        *group, F.round(value, similarity.DIGITS).alias("_v")).agg(F.count("*").alias("_n"))
    return counted.groupBy(*group).agg(
        F.round(F.min("_v"), 3).alias("p_min"),
        *[F.round(F.percentile("_v", F.lit(p), F.col("_n")), 3).alias(n) for n, p in at.items()],
        F.round(F.max("_v"), 3).alias("p_max"))


def side_by_side(scored: DataFrame, key: list[str], models: list[str], value: str = "avg_sim") -> DataFrame:
    """One row per key with one column per model."""
    return scored.groupBy(*key).agg(*[F.max(F.when(F.col("model") == m, F.col(value))).alias(m) for m in models])


def pair_grid(pairs: DataFrame, a: str, b: str, keep_cols: list[str]) -> DataFrame:
    """Similarity of two vector columns on each row."""
    return pairs.select(*keep_cols, F.round(cosine_sim(F.col(a), F.col(b)), 6).alias("sim"))
