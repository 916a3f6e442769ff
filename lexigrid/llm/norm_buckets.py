"""Exact search for the largest inner products, over buckets of vectors of like length.

Vectors are sorted by length, longest first, and cut into buckets.  A query goes through the buckets in that order, in
waves that double.  Its k-th best score so far, over its own length and that of the bucket's longest vector, is the
cosine that a vector of the bucket must reach at least: above 1 the query is done with this bucket and all later ones.
Below, the local threshold chooses the pruning.  Where it confines some coordinate of the unit vectors to a narrow
interval, only the vectors in that interval are looked at; else those that are long enough.  Inner products of what
remains are computed exactly.

Components are integers: floor(scale * x).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.llm.common import ranked, short_batches, stored

BUCKET_NUMBERS = 1 << 21   # components in a bucket, at most
BLOCK_NUMBERS = 1 << 20    # components in a block of queries, at most
NARROW = 1 / 16            # share of the long enough vectors that an interval may hold to be worth its look-ups
FOCUS = 4                  # of a query's largest coordinates, how many are tried
WIDE = 2.0                 # half the width of an interval, in deviations of a coordinate, from which on none is tried
CHUNK = 1 << 22            # products held at once
_SLACK = 1e-9              # bounds are floating-point numbers; products are exact
EXACT = float(1 << 53)     # products up to here are exact in double precision


def usable(vec: Column) -> Column:
    """True for vectors without null or non-finite components."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine, F.lit(False))


def whole_numbers(vec: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as doubles that hold whole numbers."""
    return F.transform(vec.cast("array<double>"), lambda x: F.floor(F.lit(float(scale)) * x).cast("double"))


def matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    whole = vectors.combine_chunks()
    return np.asarray(whole.flatten(), np.float64).reshape(len(whole), width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows; an error where they don't fit into a long."""
    most = np.sqrt((a * a).sum(axis=1).max(initial=0.0) * (b * b).sum(axis=1).max(initial=0.0))
    if most < EXACT:
        return a @ b.T
    if most >= 2.0 ** 62:
        raise OverflowError("inner products don't fit into a long")
    return a.astype(np.int64) @ b.astype(np.int64).T


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.nonzero(scores >= edge)[0]
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


class Bucket:
    """Vectors of like length, longest first, with their unit vectors sorted by a coordinate where that is asked for."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.lengths = np.sqrt((vectors * vectors).sum(axis=1))
        order = np.lexsort((ids, -self.lengths))
        self.ids, self.vectors, self.lengths = ids[order], vectors[order], self.lengths[order]
        self.unit = self.vectors / np.maximum(self.lengths, 1e-300)[:, None]
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def long_enough(self, least: float) -> int:
        """How many vectors have at least this length; they are the first."""
        return int(np.searchsorted(-self.lengths, -least * (1 - _SLACK), "right"))

    def interval(self, coordinate: int, low: float, high: float) -> np.ndarray:
        """Places of the vectors whose unit coordinate is from low to high."""
        if coordinate not in self._sorted:
            order = np.argsort(self.unit[:, coordinate], kind="stable")
            self._sorted[coordinate] = order, self.unit[order, coordinate]
        order, values = self._sorted[coordinate]
        return order[np.searchsorted(values, low - _SLACK, "left") : np.searchsorted(values, high + _SLACK, "right")]

    def candidates(self, query: np.ndarray, length: float, floor: float) -> np.ndarray | int:
        """Places of the vectors that may reach ``floor``, or how many of the first ones may.

        The unit vectors within the angle of the local threshold have coordinates in an interval around the query's.
        """
        if floor <= 0 or length == 0:
            return len(self.ids)
        local = floor / (length * self.lengths[0]) if len(self.ids) and self.lengths[0] else np.inf
        if local > 1 + _SLACK:
            return 0
        local = min(local, 1.0)
        first = self.long_enough(floor / length)
        unit = query / length
        reach = np.sqrt(1 - local * local)
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        # an interval of the largest coordinate as wide as most of the sphere isn't worth a sort
        if reach * np.sqrt(max(0.0, 1 - unit[focus[0]] ** 2)) * np.sqrt(len(unit)) > WIDE:
            return first
        tried = []
        for c in focus:
            wide = reach * np.sqrt(max(0.0, 1 - unit[c] ** 2))
            tried.append(self.interval(int(c), -1.0 if unit[c] <= -local else unit[c] * local - wide,
                                       1.0 if unit[c] >= local else unit[c] * local + wide))
        narrow = min(tried, key=len)
        if len(narrow) > NARROW * first:
            return first
        return narrow[narrow < first]


def search_bucket(bucket: Bucket, own: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int):
    """(query place, vector place, score) of each query's k best of a bucket, none under its floor."""
    lengths = np.sqrt((queries * queries).sum(axis=1))
    looked = [bucket.candidates(q, length, floor) for q, length, floor in zip(queries, lengths, floors)]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def keep(q: int, places: np.ndarray, scores: np.ndarray) -> None:
        stay = (bucket.ids[places] != own[q]) & (scores >= floors[q])
        places, scores = places[stay], scores[stay]
        top = best_of(scores, bucket.ids[places], k)
        found.append((np.full(len(top), q), places[top], scores[top].astype(np.int64)))

    by_length = np.array([q for q, c in enumerate(looked) if isinstance(c, int) and c], np.int64)
    by_length = by_length[np.argsort([-looked[q] for q in by_length], kind="stable")] if len(by_length) else by_length
    at = 0
    while at < len(by_length):   # queries that need about as many of the longest vectors are multiplied together
        first = looked[by_length[at]]
        part = by_length[at : at + max(1, CHUNK // first)]
        scores = products(queries[part], bucket.vectors[:first])
        for q, row in zip(part, scores):
            keep(int(q), np.arange(looked[q]), row[: looked[q]])
        at += len(part)
    for q, places in enumerate(looked):
        if not isinstance(places, int) and len(places):
            keep(q, places, products(queries[q : q + 1], bucket.vectors[places])[0])
    return tuple(np.concatenate(c) for c in zip(*found))


def _stretch(numbers: int) -> Column:
    """Which run of rows, of at most so many components together, a row's place belongs to."""
    rows = F.greatest(F.lit(1), F.floor(F.lit(numbers) / F.greatest(F.col("width"), F.lit(1))))
    return F.floor(F.col("at") / rows).cast("long")


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, key: str = "vec_id", vec: str = "embedding",
                 bucket_numbers: int = BUCKET_NUMBERS, block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """query_id, rank (from 1), key and score of the k largest integer inner products of every query.

    Candidates are all rows of other ids; ties go to the smaller id.  Vectors that are null or hold null or non-finite
    components take no part, nor do null ids.  All-zero vectors do.  Repeated rows (one id, one vector) count once.
    Vectors of different dimensions don't meet.  Ids are integers.  Scores beyond a long are an error.  Without
    candidates there are no rows; other columns are not read.
    """
    short_batches(vectors)
    rows = lambda df: (df.select(F.col(key).cast("long").alias("id"), F.col(vec).alias("_v"))
                       .where(F.col("id").isNotNull() & usable(F.col("_v"))).distinct()
                       .select("id", F.size("_v").alias("width"), whole_numbers(F.col("_v"), scale).alias("vec")))
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    held = ranked(rows(vectors).withColumn("length", length), "width", [F.col("length").desc(), F.col("id")])
    held = held.withColumn("bucket", _stretch(bucket_numbers)).select("width", "bucket", "id", "length", "vec")
    asked = ranked(rows(queries).withColumn("length", length), "width", [F.col("id")])
    asked = stored(asked.withColumn("block", _stretch(block_numbers))
                   .select("width", "block", F.col("at").alias("qid"), F.col("id").alias("query_id"), "length", "vec"), "queries")
    # a row for each bucket: how long its longest vector is
    heads = stored(held.groupBy("width", "bucket").agg(F.max("length").alias("longest")), "heads")
    last = heads.agg(F.max("bucket")).first()[0]
    best = asked.select("width", "qid", "query_id", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("score")).limit(0)
    start, wave = 0, 1
    while last is not None and start <= last:
        # the k-th best so far; -inf while there are fewer
        floors = best.groupBy("width", "qid").agg(F.count("*").alias("_n"), F.min("score").alias("_floor"))
        open_ = (asked.join(floors, ["width", "qid"], "left")
                 .withColumn("floor", F.when(F.col("_n") >= k, F.col("_floor").cast("double")).otherwise(F.lit(float("-inf")))).drop("_n", "_floor"))
        these = heads.where(F.col("bucket").between(start, start + wave - 1))
        reach = (F.col("floor") <= 0) | (F.col("floor") <= F.col("length") * F.col("longest") * (1 + _SLACK))
        sent = stored(open_.join(these, "width").where(reach).drop("length", "longest"), "sent")
        if start and sent.isEmpty():
            break
        found = _wave(held, sent, k)
        both = best.unionByName(found)
        place = F.row_number().over(Window.partitionBy("width", "qid").orderBy(F.desc("score"), "id"))
        best = stored(both.withColumn("_r", place).where(F.col("_r") <= k).drop("_r"), "best")
        start, wave = start + wave, 2 * wave
    place = F.row_number().over(Window.partitionBy("width", "qid").orderBy(F.desc("score"), "id"))
    return best.select("query_id", place.alias("rank"), F.col("id").alias(key), "score")


def _wave(held: DataFrame, sent: DataFrame, k: int) -> DataFrame:
    """The k best of every query in each bucket that it is sent to."""
    blocks = sent.select("width", "bucket", F.col("block").alias("part")).distinct()
    right = held.join(blocks, ["width", "bucket"]).select("width", "bucket", "part", "id", "vec")

    def compare(asked: pa.Table, candidates: pa.Table) -> pa.Table:
        empty = {"width": pa.array([], pa.int32()), **{c: pa.array([], pa.int64()) for c in ("qid", "query_id", "id", "score")}}
        if not asked.num_rows or not candidates.num_rows:
            return pa.table(empty)
        width = asked.column("width")[0].as_py()
        bucket = Bucket(np.asarray(candidates.column("id")), matrix(candidates.column("vec"), width))
        q, x, scores = search_bucket(bucket, np.asarray(asked.column("query_id")), matrix(asked.column("vec"), width),
                                     np.asarray(asked.column("floor")), k)
        return pa.table({"width": pa.array([width] * len(q), pa.int32()), "qid": pa.array(np.asarray(asked.column("qid"))[q], pa.int64()),
                         "query_id": pa.array(np.asarray(asked.column("query_id"))[q], pa.int64()),
                         "id": pa.array(bucket.ids[x], pa.int64()), "score": pa.array(scores, pa.int64())})

    pairs = sent.groupBy("width", "bucket", "block").cogroup(right.groupBy("width", "bucket", "part"))
    return pairs.applyInArrow(compare, "width int, qid long, query_id long, id long, score long")


def sql(k: int = 10, scale: int = 1024, every: int = 100) -> str:
    """DuckDB SQL for the rows of ``top_products`` over embeddings, queries being the ids divisible by ``every``."""
    return f"""WITH v AS MATERIALIZED (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS e FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % {every} = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY rank <= {k}"""
