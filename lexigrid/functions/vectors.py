"""Vector arithmetic on ``array<float>`` columns, inside Catalyst.

For single pairs and small lists; searches and joins use ``operators.similarity``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dot_product(a: Column, b: Column) -> Column:
    """Sum of products, added up in double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda acc, p: acc + p)


def norm(a: Column) -> Column:
    return F.sqrt(dot_product(a, a))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` loops over a list."""
    return F.transform(F.array(value), use)[0]


def cosine_sim(a: Column, b: Column) -> Column:
    """Cosine in double.  NULL in, NULL out; zero norm 0.0; unequal or empty lists NaN."""
    cosine = let(norm(a) * norm(b), lambda s: F.when(s == 0.0, F.lit(0.0)).otherwise(dot_product(a, b) / s))
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when((F.size(a) != F.size(b)) | (F.size(a) == 0), F.lit(float("nan")))
        .otherwise(cosine)
    )


def cosine_distance(a: Column, b: Column) -> Column:
    return (F.lit(1.0) - cosine_sim(a, b)).cast("float")


def unit(a: Column) -> Column:
    """Unit length in double; a zero vector stays as it is."""
    return let(norm(a), lambda n: F.transform(a, lambda x: F.when(n > 0.0, x / n).otherwise(x.cast("double"))))


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return F.transform(unit(a), lambda x: x.cast("float"))


PART = 32  # places summed up side by side in one row


def mean_vector(df: DataFrame, group: list[str], vec: str = "vec", out: str = "vec", count: str | None = None) -> DataFrame:
    """Element-wise mean per group; ``count`` names a column for the number of its vectors.

    Vectors are cut into parts of ``PART`` places, and a part is one row with a sum per place.  Parts are added up before
    the shuffle, so a group of any size reaches it as a few rows per partition.
    """
    n, v = F.size(vec), F.col(vec)
    last = F.greatest(F.floor((n - 1) / PART).cast("int"), F.lit(0))
    parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(v, k * PART + 1, PART))
    flat = df.where(v.isNotNull()).select(*group, F.posexplode(parts).alias("_part", "_val"))
    sums = flat.groupBy(*group, "_part").agg(
        F.count("*").alias("_n"), F.max(F.size("_val")).alias("_w"), *[F.avg(F.get("_val", F.lit(i))).alias(f"_{i}") for i in range(PART)])
    means = F.slice(F.array(*[f"_{i}" for i in range(PART)]), F.lit(1), F.col("_w"))
    cells = F.array_sort(F.collect_list(F.struct("_part", means.alias("_m"))))
    whole = F.flatten(F.transform(cells, lambda c: c["_m"])).alias(out)
    number = [F.max("_n").alias(count)] if count else []  # every vector has a first part
    return sums.where(F.col("_w") > 0).groupBy(*group).agg(whole, *number)


def register(spark: SparkSession) -> None:
    vec = "ARRAY<DOUBLE>"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION dot_product(a {vec}, b {vec}) RETURNS DOUBLE RETURN "
        "aggregate(zip_with(a, b, (x, y) -> x * y), 0.0D, (s, p) -> s + p)")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION cosine_sim(a {vec}, b {vec}) RETURNS DOUBLE RETURN "
        "CASE WHEN a IS NULL OR b IS NULL THEN NULL "
        "WHEN size(a) <> size(b) OR size(a) = 0 THEN double('NaN') "
        "WHEN dot_product(a, a) = 0.0D OR dot_product(b, b) = 0.0D THEN 0.0D "
        "ELSE dot_product(a, b) / (sqrt(dot_product(a, a)) * sqrt(dot_product(b, b))) END")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION cosine_distance(a {vec}, b {vec}) RETURNS FLOAT RETURN "
        "float(1.0D - cosine_sim(a, b))")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION l2_normalize(a {vec}) RETURNS ARRAY<FLOAT> RETURN "
        "transform(array(sqrt(dot_product(a, a))), n -> "
        "transform(a, x -> float(CASE WHEN n > 0.0D THEN x / n ELSE x END)))[0]")
