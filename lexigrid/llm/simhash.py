"""SimHash near-duplicates found by covering locality-sensitive hashing.

A structured family of bit masks (one for every non-zero vector of a binary space with ``radius + 1``
dimensions) replaces random bit samples.  Each bit position gets a code from that space, and a mask keeps
the positions whose code is not orthogonal to its own vector.  The codes of at most ``radius`` positions
never span the space, so some mask leaves all of them out: any two fingerprints within the radius agree
on all that this mask keeps.  No pair is missed, whatever the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.llm.common import free_name, short_batches, small
from lexigrid.operators.components import connected_components
from lexigrid.session import cut_lineage

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
MAX_BUCKET = 512
_ALL = (1 << BITS) - 1
_BLOCK = 1 << 16  # shingles whose bits are counted at once


def fingerprint_of(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint of one text: bit majority over the hashes of its word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space parts
    if not words:
        return 0
    if len(words) < size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - size + 1
    ones = np.zeros(BITS, np.int64)
    for start in range(0, n, _BLOCK):
        part = words[start : start + _BLOCK + size - 1]
        shingles = zip(*(part[k:] for k in range(size)))
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def _fingerprint(texts: pa.Array) -> pa.Array:
    values = np.fromiter((fingerprint_of(t.as_py()) for t in texts), np.uint64, len(texts))
    return pa.array(values.view(np.int64))


def fingerprint(text: Column) -> Column:
    """64-bit fingerprint of a text as a signed long; null and blank texts give 0."""
    return _fingerprint(text)


def covering_masks(free: int = _ALL, radius: int = RADIUS) -> list[int]:
    """Masks over the set bits of ``free``: any ``radius`` of these bits are all left out by one of them."""
    vectors = range(1, 2 ** (radius + 1))
    places = [b for b in range(BITS) if free >> b & 1]
    codes = {b: vectors[k % len(vectors)] for k, b in enumerate(places)}
    return [sum(1 << b for b in places if (codes[b] & v).bit_count() % 2) for v in vectors]


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def _finer(spark: SparkSession, paths: list[tuple[int, int]], radius: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Masks for the bits that each path of masks has left free, as (path, next path, all kept bits)."""
    width = 2 ** (radius + 1)
    rows, following = [], []
    for path, kept in paths:
        for v, mask in enumerate(covering_masks(_ALL & ~kept, radius), 1):
            rows.append((path, path * width + v, _signed(kept | mask)))
            following.append((path * width + v, kept | mask))
    return spark.createDataFrame(rows, "path long, next long, kept long"), following


def _spanning(radius: int):
    @F.arrow_udf("array<struct<a: bigint, b: bigint>>")
    def edges(buckets: pa.Array) -> pa.Array:
        """Of each bucket, edges that connect what links within the radius connect: no more than its members."""
        out = []
        for bucket in buckets:
            prints = np.unique(np.array(bucket.as_py(), np.int64))
            bits = prints.view(np.uint64)
            near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
            label = np.arange(len(prints))
            while True:
                lower = np.where(near, label[None, :], len(prints)).min(axis=1)
                if (lower == label).all():
                    break
                label = lower
            out.append([{"a": int(prints[k]), "b": int(prints[i])} for i, k in enumerate(label) if i != k])
        return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    return edges


def links(prints: DataFrame, radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Edges (a, b) that connect the same distinct fingerprints ``fp`` as all links within ``radius`` do.

    Fingerprints that agree under a mask share a bucket.  Buckets up to ``max_bucket`` are compared in place
    and give a spanning set of edges, never all pairs.  Larger ones are dealt again, exactly, by masks over the
    bits that are still free; these halve at each step, so buckets shrink below any bound however alike the
    fingerprints are.
    """
    spark = prints.sparkSession
    rows = prints.select("fp", F.lit(0).cast("long").alias("path"))
    paths = [(0, 0)]
    found = None
    while paths:
        masks, paths = _finer(spark, paths, radius)
        buckets = (rows.join(F.broadcast(masks), "path")  # (2^(radius+1) - 1)^depth rows, by construction
                   .select(F.col("next").alias("path"), F.col("fp").bitwiseAND(F.col("kept")).alias("key"), "fp"))
        hot = cut_lineage(buckets.groupBy("path", "key").count().where(F.col("count") > max_bucket).select("path", "key"))
        some_hot = not hot.isEmpty()
        cold = buckets.join(hot, ["path", "key"], "left_anti") if some_hot else buckets
        edges = (cold.groupBy("path", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
                 .select(F.explode(_spanning(radius)("fps")).alias("e")).select("e.a", "e.b"))
        found = edges if found is None else found.unionByName(edges)
        if not some_hot:
            break
        rows = cut_lineage(buckets.join(hot, ["path", "key"], "left_semi").select("fp", "path"))
    return found.distinct()


def components(rows: DataFrame, key: str = "doc_id", fp: str = "fp", radius: int = RADIUS,
               max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(fp, component_id) for every distinct fingerprint: the smallest key that its chain of links reaches.

    Rows with a null key are linked like any other; a component of such rows alone has a null id.
    """
    prints = cut_lineage(rows.select(F.col(fp).alias("fp"), F.col(key).alias("key"))
                         .groupBy("fp").agg(F.min("key").alias("least")))
    joined = connected_components(links(prints.select("fp"), radius, max_bucket))
    named = prints.join(joined, prints["fp"] == joined["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("part"))
    ids = named.groupBy("part").agg(F.min("least").alias("component_id"))
    return named.join(ids, "part").select("fp", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id of every row.

    Null and blank texts have fingerprint zero and link like any other; repeated rows stay; an empty table gives
    none.  Only the two named columns are read, so other columns may have any names.
    """
    short_batches(docs)
    rows = cut_lineage(docs.select(F.col(key).alias("key"), fingerprint(F.col(text)).alias("fp")))
    parts = components(rows, "key", "fp", radius)
    return rows.join(parts, "fp").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each near-duplicate group: the smallest key (nulls last), then the smallest row hash.

    Returns the input's columns.  Of rows equal in all columns one stays.  What is joined to the texts is the list of
    the rows to drop, so they aren't shuffled while that list fits into a broadcast; only rows that occur twice are.
    """
    short_batches(docs)
    row_hash, own_key = free_name(docs, "_row_hash"), free_name(docs, "_own_key")
    plain = [c for c, kind in docs.dtypes if "map<" not in kind]
    hashed = docs.withColumn(row_hash, F.xxhash64(*plain))
    rows = cut_lineage(hashed.select(F.col(key).alias("key"), F.col(row_hash).alias("row"),
                                     fingerprint(F.col(text)).alias("fp")))
    parts = components(rows, "key", "fp", radius).withColumnRenamed("component_id", "part")
    # components of null keys alone have a null id, so such a group is told apart by its fingerprint as well
    first = (rows.join(parts, "fp")
             .groupBy("part", F.when(F.col("part").isNull(), F.col("fp")).alias("alone"))
             .agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("m"))
             .select(F.col("m.key").alias(own_key), F.col("m.row").alias(row_hash)).distinct())
    times = rows.groupBy(F.col("key").alias("k"), F.col("row").alias("r")).agg(F.count("*").alias("n"))
    told = times.join(first, (times["r"] == first[row_hash]) & times["k"].eqNullSafe(first[own_key]), "left")
    told = cut_lineage(told.select(F.col("k").alias(own_key), F.col("r").alias(row_hash), "n", first[row_hash].isNotNull().alias("first"))
                       .where("not first or n > 1"))

    def among(texts: DataFrame, listed: DataFrame, how: str) -> DataFrame:
        side = listed.select(F.col(own_key), F.col(row_hash).alias("_r"))
        side = F.broadcast(side) if small(side, 64) else side
        return texts.join(side, (texts[row_hash] == side["_r"]) & texts[key].eqNullSafe(side[own_key]), how)

    kept = among(hashed, told, "left_anti")    # rows that occur once and are the first of their group
    twins = told.where("first")
    if not twins.isEmpty():
        kept = kept.unionByName(among(hashed, twins, "left_semi").dropDuplicates([row_hash, key]))
    return kept.select(*docs.columns)
