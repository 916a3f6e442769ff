"""First rows per group, reproducible samples, and joins of group lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int,
                  rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group.  ``order`` must end in a key, so ranks are total.

    Spark trims each partition to ``n`` rows per group before the shuffle.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    name = rank or "_rank"
    top = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return top if rank else top.drop(name)


def draw(key: list[str], seed: int = 0) -> Column:
    """A value that orders rows at random but the same way on every run."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))


def stratified_sample(df: DataFrame, group: list[str], key: list[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows per group, drawn by hash of their key."""
    return top_per_group(df, group, [draw(key, seed), *[F.col(k) for k in key]], n)


def sample_rows(df: DataFrame, key: list[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows drawn by hash of their key."""
    return df.orderBy(draw(key, seed), *key).limit(n)


def joined_list(value: Column, order: list[Column], sep: str = ", ") -> Column:
    """Aggregate: the values of a group, ordered and joined (NULLs left out)."""
    cells = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(
        *[o.alias(f"o{i}") for i, o in enumerate(order)], value.cast("string").alias("v")))))
    return F.array_join(F.transform(cells, lambda c: c["v"]), sep)
