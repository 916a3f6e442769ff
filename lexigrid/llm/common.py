"""What several operators of this package share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# the characters that part words, as a trim set and as a pattern
WHITE = " \t\n\x0b\f\r"
GAP = "[\\x20\\x09-\\x0D]+"
# a lookup side is broadcast only when its rows times their width stay under this
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; a null or blank text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def small(df: DataFrame, row_bytes: int) -> bool:
    """True when ``df`` (of rows about ``row_bytes`` wide) is counted to fit into a broadcast."""
    most = BROADCAST_BYTES // row_bytes
    return df.limit(most + 1).count() <= most


def lookup(rows: DataFrame, side: DataFrame, on: list[str], row_bytes: int, how: str = "left") -> DataFrame:
    """Join a side with unique keys: broadcast when its counted size allows, else left to skew-aware joins."""
    return rows.join(F.broadcast(side) if small(side, row_bytes) else side, on, how)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS_PER_BATCH = 1_000


def short_batches(df: DataFrame) -> None:
    """Have Python tasks take texts in smaller batches, unless the session has a setting of its own.

    Spark's 10,000 rows are no bound when a row may be a text of any length: a worker holds a whole batch.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH, "10000") == "10000":
        conf.set(_BATCH, str(ROWS_PER_BATCH))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have yet, so that helper columns clash with none of its own."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under ``spark.checkpoint.dir``, which all machines of a cluster share.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="shared-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """``df`` written as a table in the shared folder and read again: what follows starts from files of known size."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ranked(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``at`` (place within its group from 0, in the given order) and ``n`` (size of the group).

    ``group`` is a column without nulls.  Rows are sorted in ranges, and the rows of the ranges before are added up, so
    that no group and no repeated key meets in one task.
    """
    keys = [F.col(group), *order, F.monotonically_increasing_id()]   # the last parts repeated keys
    laid = stored(rows.repartitionByRange(*keys).sortWithinPartitions(group, *order)
                  .withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "ranked")
    sizes = laid.groupBy(group, "_part").agg(F.count("*").alias("_rows"), F.min("_row").alias("_first"))
    whole = Window.partitionBy(group)   # a row for each range that holds rows of the group
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(group, "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
                         F.sum("_rows").over(whole).alias("n"))
    out = lookup(laid, sizes, [group, "_part"], row_bytes=256, how="inner")
    return out.withColumn("at", F.col("_row") - F.col("_first") + F.col("_before")).drop("_part", "_row", "_first", "_before")
