"""Stored tables: databases, catalogs to append to, and the vector store."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.operators.encode import once, to_lists
from lexigrid.operators.sets import insert_if_absent


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              bounds: tuple[int, int] | None = None, partitions: int = 32, **options: str) -> DataFrame:
    """A database table, read over several connections when a numeric column is named."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column:
        if bounds is None:
            raise ValueError("bounds are needed with partition_column")
        reader = reader.options(partitionColumn=partition_column, lowerBound=str(bounds[0]),
                                upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load()


def publish_jdbc(tables: dict[str, DataFrame], urls: list[str], batch_rows: int = 10_000,
                 connections: int = 8, **options: str) -> None:
    """Clear and reload each table in each database; rows go straight from the executors."""
    for url in urls:
        for name, df in tables.items():
            (df.coalesce(connections).write.mode("overwrite").format("jdbc")
             .options(url=url, dbtable=name, truncate="true", batchsize=str(batch_rows), **options).save())


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table afresh and read it back."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def append_rows(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_if_absent(df: DataFrame, path: str, key: list[str]) -> None:
    """Append the rows whose key the stored table lacks (one per key)."""
    stored = df.sparkSession.read.parquet(path)
    append_rows(insert_if_absent(stored, df, key), path)


def backfill(df: DataFrame, column: str, value: Column) -> DataFrame:
    """Add a column, or fill in its NULLs."""
    return df.withColumn(column, F.coalesce(F.col(column), value) if column in df.columns else value)


# ---------------------------------------------------------------- vectors as text


def pack(vec: Column) -> Column:
    """float32 vector as base64 of its little-endian bytes."""

    @F.arrow_udf("binary")
    def to_bytes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            offsets = batch.offsets.to_numpy()
            data = np.ascontiguousarray(batch.values.to_numpy(zero_copy_only=False), dtype="<f4").tobytes()
            ok = batch.is_valid().to_pylist()
            yield pa.array([data[4 * a:4 * b] if v else None for a, b, v in zip(offsets[:-1], offsets[1:], ok)], pa.binary())

    return F.base64(once(to_bytes)(vec))


def unpack(packed: Column, dim: int) -> Column:
    """The vector of :func:`pack`; raises unless it has ``dim`` numbers."""

    @F.arrow_udf("array<float>")
    def from_bytes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            valid = batch.is_valid().to_numpy(zero_copy_only=False)
            kept = [v for v in batch.to_pylist() if v is not None]
            if any(len(v) != 4 * dim for v in kept):
                raise ValueError(f"a stored vector does not have {dim} numbers")
            out = np.zeros((len(batch), dim), dtype=np.float32)
            out[valid] = np.frombuffer(b"".join(kept), dtype="<f4").reshape(-1, dim)
            yield to_lists(out, valid)

    return once(from_bytes)(F.unbase64(packed))


STORE_KEY = ["geonameid", "model_id"]


def store_rows(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """Rows of the vector store: one per (geonameid, model_id), vectors packed."""
    rows = vectors.dropDuplicates(STORE_KEY)
    return rows.select("geonameid", "model_id", "feature_code", "feature_name", pack(F.col(vec)).alias("embedding_b64"),
                       F.current_timestamp().alias("created_at"))


def write_store(vectors: DataFrame, path: str, vec: str = "vec") -> DataFrame:
    """Write the store, one folder per model."""
    return replace_table(store_rows(vectors, vec), path, ["model_id"])
