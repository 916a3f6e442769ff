"""Sharding by sampled splitters.

Records are ordered by a key.  A sample drawn with chances in proportion to size gives splitters at quantiles of the
bytes, and every record goes to the range between two splitters.  Ranges that turn out overfull are subdivided by
splitters of their own.  The key ends in a hash of the record's identity, so a key value that holds a third of all
records is divided like any other stretch.  Exact byte offsets of the ranges then place every record in a shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.session import cut_lineage

SHARDS = 24
RANGE_BYTES = 8 << 30     # of texts in a range at most; one task sorts its narrow rows, a few dozen bytes each
MIN_RANGES_PER_SHARD = 4
OVERSAMPLE = 40           # sampled keys for every range wanted
OVERFULL = 1.5            # times the wanted size from which a range is subdivided
MAX_PASSES = 6            # of subdivision; what is still overfull then is a single long record or rows alike in all
SEED = 17
LAW = "bytes"


def _key(text: Column, key: Column) -> list[Column]:
    """Order of records: equal texts side by side, then by a hash of the key, then the key."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(SEED), key).alias("k2")]


def measured(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One narrow row per record: key, size (UTF-8 bytes plus 8), text_crc32 and the two parts of the sort key."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("key"), (F.octet_length(body) + 8).cast("long").alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"), *_key(body, F.col(key)))


def _splitters(rows: DataFrame, wanted: DataFrame | None, size: int) -> list[tuple[int, int]]:
    """Quantiles of a sample in which each record is drawn with a chance in proportion to its size.

    The sample is of about ``OVERSAMPLE`` keys per range, so it and the splitters grow with the number of ranges only:
    a few dozen bytes for every ``RANGE_BYTES`` of records.
    """
    step = size / OVERSAMPLE
    u = F.pmod(F.xxhash64(F.lit(SEED + 1), "k1", "k2"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # a record of several steps is drawn that often, so weights are right for long ones too
    drawn = F.floor(F.col("size") / step + u).cast("int")
    sample = rows if wanted is None else rows.join(F.broadcast(wanted), "range", "left_semi")
    got = sample.select("k1", "k2", drawn.alias("n")).where("n > 0").toArrow()
    k1, k2, n = (np.array(got.column(c)) for c in ("k1", "k2", "n"))
    order = np.lexsort((k2, k1))
    ends = np.cumsum(n[order])
    at = np.searchsorted(ends, np.arange(OVERSAMPLE, ends[-1] if len(ends) else 0, OVERSAMPLE))
    return sorted({(int(k1[order[i]]), int(k2[order[i]])) for i in at})


def _assign(rows: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """Adds ``range``: how many splitters are at or before the record's key."""
    first = np.array([a for a, _ in splitters], np.int64)
    second = np.array([b for _, b in splitters], np.int64)
    sent = rows.sparkSession.sparkContext.broadcast((first, second))

    @F.arrow_udf("int")
    def place(k1: pa.Array, k2: pa.Array) -> pa.Array:
        first, second = sent.value
        a, b = np.array(k1), np.array(k2)
        low, high = np.searchsorted(first, a, "left"), np.searchsorted(first, a, "right")
        for value in np.unique(low[low < high]):  # keys that share the first part with splitters
            rows = (low == value) & (low < high)
            stop = high[rows][0]
            low[rows] = value + np.searchsorted(second[value:stop], b[rows], "right")
        return pa.array(low.astype(np.int32))

    return rows.withColumn("range", place("k1", "k2"))


def ranges(rows: DataFrame, total: int, shards: int) -> DataFrame:
    """``rows`` with the range of each; overfull ranges have been subdivided by splitters drawn within them."""
    size = max(1, min(RANGE_BYTES, total // (shards * MIN_RANGES_PER_SHARD)))
    splitters = _splitters(rows, None, size)
    out = cut_lineage(_assign(rows, splitters))
    for _ in range(MAX_PASSES):
        heavy = (out.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
                 .where((F.col("bytes") > OVERFULL * size) & (F.col("n") > 1)).select("range"))
        finer = set(_splitters(out, heavy, max(1, size // 2))) - set(splitters)
        if not finer:
            break
        splitters = sorted({*splitters, *finer})
        out = cut_lineage(_assign(out.drop("range"), splitters))
    return out


def _placed(rows: DataFrame, total: int, shards: int) -> DataFrame:
    """Adds shard and slot to rows with ranges, from the ranges' exact offsets."""
    per_range = rows.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).toArrow()  # a row per range
    order = np.argsort(np.array(per_range.column("range")))
    names = np.array(per_range.column("range"))[order]
    ahead = {c: np.concatenate([[0], np.cumsum(np.array(per_range.column(c))[order])[:-1]]) for c in ("bytes", "n")}
    offsets = rows.sparkSession.createDataFrame(
        [(int(r), int(b), int(n)) for r, b, n in zip(names, ahead["bytes"], ahead["n"])], "range int, bytes_ahead long, rows_ahead long")
    within = Window.partitionBy("range").orderBy("k1", "k2", F.col("key").asc_nulls_first(), "text_crc32", "size")
    out = (rows.withColumns({"_bytes": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)),
                             "_rows": F.row_number().over(within) - 1})
           .join(F.broadcast(offsets), "range"))  # a row per range
    middle = F.col("bytes_ahead") + F.coalesce("_bytes", F.lit(0)) + F.col("size") / 2
    shard = F.least(F.floor(middle * shards / total), F.lit(shards - 1)).cast("int")
    out = cut_lineage(out.select("key", "size", "text_crc32", shard.alias("shard"),
                                 (F.col("rows_ahead") + F.col("_rows")).cast("long").alias("_at")))
    starts = out.groupBy("shard").agg(F.min("_at").alias("_start"))  # a row per shard
    return out.join(F.broadcast(starts), "shard").withColumn("slot", F.col("_at") - F.col("_start"))


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard of every row, under the law ``bytes``.

    Shards are stretches of the key order whose bytes differ by no more than two records.  Slots count from 0 in that
    order.  Null texts count as empty.  Rows equal in all columns get places of their own; an empty table gives no rows;
    only the two named columns are read.  With fewer rows than shards some shards stay empty.
    """
    rows = cut_lineage(measured(docs, key, text))
    total = rows.agg(F.sum("size")).first()[0] or 0
    placed = _placed(ranges(rows, total, shards), max(total, 1), shards)
    return placed.select(F.col("key").alias(key), "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
