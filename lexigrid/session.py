"""Session helpers: local sessions for tests and benches, and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows and bytes a lookup side may have before it is no longer broadcast or collected.
SMALL_SIDE_ROWS = 100_000
SMALL_SIDE_BYTES = 64 << 20


def local_session(app: str = "lexigrid", cpus: int | str = "*", memory: str = "8g",
                  shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session; on a cluster the submitter brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back.

    The folder comes from ``spark.checkpoint.dir``.  Only a local session without that
    setting gets a folder of its own; a cluster without it is an error, because files on
    one machine are lost with that machine.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        configured = sc.getConf().get("spark.checkpoint.dir")
        if configured:
            sc.setCheckpointDir(configured)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return df.checkpoint(eager=True)


_kept: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Persist a frame that several branches of one plan read; lost parts are recomputed."""
    _kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return _kept[-1]


def release() -> None:
    """Drop every frame kept so far; for long sessions, once results have been written."""
    while _kept:
        _kept.pop().unpersist()


def shared_folder(spark: SparkSession, name: str) -> str:
    """Path of a new folder under ``spark.checkpoint.dir``, which all machines of a cluster share.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="shared-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: lists and texts by their length, all else eight."""
    out = F.lit(16)
    for field in df.schema.fields:
        col, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            out = out + F.coalesce(F.octet_length(col), F.lit(0))
        elif isinstance(kind, T.ArrayType):
            each = 8 if isinstance(kind.elementType, T.NumericType) else 64
            out = out + F.greatest(F.coalesce(F.size(col), F.lit(0)), F.lit(0)) * each
        else:
            out = out + F.lit(8 if isinstance(kind, T.AtomicType) else 64)
    return out.cast("long")


def fits(df: DataFrame, max_rows: int = SMALL_SIDE_ROWS, max_bytes: int = SMALL_SIDE_BYTES) -> bool:
    """True when ``df`` has at most so many rows and bytes; looks at one row more, never at all."""
    head = df.limit(max_rows + 1)
    seen = head.agg(F.count("*").alias("n"), F.sum(row_bytes(head)).alias("b")).first()
    return seen["n"] <= max_rows and (seen["b"] or 0) <= max_bytes
