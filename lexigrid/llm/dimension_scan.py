"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors are dealt to lists around centres, and a query probes the lists nearest to it.  Within a list, rotated
vectors are read in blocks of columns.  After each block the partial distance, scaled up to all columns, is tested
against the distance to beat: a candidate that is too far with high confidence is given up before its other columns
are looked at.  What survives all blocks gets its exact inner product.

Largest inner products become smallest distances by one more component that brings every vector to the same length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.session import cut_lineage

SAMPLE = 20_000        # vectors that centres are fitted on, in the order of a hash; every row is indexed
VECTORS_PER_LIST = 8   # of the sample, at least
ROUNDS = 8             # of k-means
TRIALS = 256           # sampled vectors whose exact neighbours set the number of lists to probe
TARGET_RECALL = 0.97   # among the sample; neighbours in all rows are nearer, so theirs is higher
BLOCK_COLUMNS = 16
CONFIDENCE = 2.1       # a candidate is given up when its scaled distance is off by so many over sqrt(columns seen)
LIST_PART = 2048       # vectors and queries that one comparison takes; longer lists are split
QUERY_PART = 512
DENSE = 0.1            # share of pairs left from which on columns are added for the pairs left only
PAIRS = 1 << 18        # pairs whose columns are gathered at once
SEED = 11


def usable(vec: Column) -> Column:
    """True for vectors without null or non-finite components that are not all zero."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def _rows(table: DataFrame, key: str, vec: str) -> DataFrame:
    return table.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("vec")) \
        .where(F.col("id").isNotNull() & usable(F.col("vec"))).distinct()


@dataclass
class Index:
    """Rotation, centres of the lists in rotated space, the longest length, and how many lists a query probes."""

    rotation: np.ndarray
    centres: np.ndarray
    longest: float
    probes: int

    def stored(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest ** 2 - (x * x).sum(axis=1), 0))
        return np.hstack([x, rest[:, None]]) @ self.rotation

    def asked(self, q: np.ndarray) -> np.ndarray:
        scale = self.longest / np.sqrt((q * q).sum(axis=1))
        return np.hstack([q * scale[:, None], np.zeros((len(q), 1))]) @ self.rotation

    def order(self, rotated: np.ndarray) -> np.ndarray:
        return _distances(rotated, self.centres)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0)


def fit(sample: np.ndarray, rows: int, longest: float, k: int) -> Index:
    """Centres by k-means on the sample, and the number of probes that reaches TARGET_RECALL among it."""
    rng = np.random.default_rng(SEED)
    width = sample.shape[1] + 1
    rotation, _ = np.linalg.qr(rng.normal(size=(width, width)))
    lists = int(np.clip(np.sqrt(rows), 1, max(1, len(sample) // VECTORS_PER_LIST)))
    index = Index(rotation, np.zeros((lists, width)), longest, 1)
    x = index.stored(sample)
    index.centres = x[rng.permutation(len(x))[:lists]].copy()
    for _ in range(ROUNDS):
        near = _distances(x, index.centres).argmin(axis=1)
        sums = np.zeros_like(index.centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=lists)
        index.centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], index.centres)
    near = _distances(x, index.centres).argmin(axis=1)
    trial = rng.permutation(len(x))[:TRIALS]
    scores = sample[trial] @ sample.T
    scores[np.arange(len(trial)), trial] = -np.inf
    best = np.argsort(-scores, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(index.order(index.asked(sample[trial])), axis=1), axis=1)  # of each list, by nearness
    needed = np.sort(np.take_along_axis(place, near[best], axis=1).ravel()) + 1
    index.probes = int(needed[int(np.ceil(TARGET_RECALL * len(needed))) - 1]) if len(needed) else 1
    return index


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    whole = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = np.asarray(whole.flatten(), np.float64)
    return flat.reshape(len(whole), -1) if len(whole) else np.zeros((0, 0))


def scan(index: Index, queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query row, vector row) that may be among the k nearest of their query in this list part."""
    q, x = index.asked(queries), index.stored(vectors)
    width = x.shape[1]
    partial = _distances(q[:, :BLOCK_COLUMNS], x[:, :BLOCK_COLUMNS])
    take = min(k, len(x))
    first = np.argpartition(partial, take - 1, axis=1)[:, :take]
    full = ((x[first] - q[:, None, :]) ** 2).sum(axis=2)
    beat = full.max(axis=1) * (1 + 1e-9) + 1e-12   # k vectors are this near already

    def limit(seen):
        """Partial distance over ``seen`` columns above which a candidate of each query is given up."""
        slack = 1.0 if seen >= width else (1 + CONFIDENCE / np.sqrt(seen)) ** 2
        return beat * slack * (seen / width)

    seen = min(BLOCK_COLUMNS, width)
    alive = partial <= limit(seen)[:, None]
    while seen < width and alive.mean() > DENSE:   # many pairs left: the next columns of all at once
        stop = min(seen + BLOCK_COLUMNS, width)
        partial += _distances(q[:, seen:stop], x[:, seen:stop])
        seen = stop
        alive &= partial <= limit(seen)[:, None]
    qi, xi = np.nonzero(alive)
    distance = partial[qi, xi]
    while seen < width:
        stop = min(seen + BLOCK_COLUMNS, width)
        for a in range(0, len(qi), PAIRS):
            part = slice(a, a + PAIRS)
            distance[part] += ((q[qi[part], seen:stop] - x[xi[part], seen:stop]) ** 2).sum(axis=1)
        seen = stop
        stay = distance <= limit(seen)[qi]
        qi, xi, distance = qi[stay], xi[stay], distance[stay]
    return qi, xi


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found of every query, its own id left out.

    Score is the inner product of the original vectors in double precision; ties go to the smaller id.  Unusable
    vectors (null, all zero, with null or non-finite components, of another length than most) and null ids take no part.
    Repeated rows count once; equal vectors are compared once, and each stands for its k + 1 smallest ids, which is all
    that any query can need.  Without candidates there are no rows.  Other columns are not read.
    """
    everything = _rows(vectors, key, vec)
    sizes = everything.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return _empty(vectors, key)
    width = sizes["n"]
    everything = everything.where(F.size("vec") == width)
    by_vector = Window.partitionBy("vec").orderBy("id")
    classes = cut_lineage(everything.withColumn("_r", F.row_number().over(by_vector)).where(F.col("_r") <= k + 1)
                          .groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # k + 1 at most
                          .withColumn("cid", F.col("ids")[0]).withColumn("cid", F.xxhash64("cid", "vec")))
    asked = cut_lineage(_rows(queries, key, vec).where(F.size("vec") == width)
                        .select(F.col("id").alias("query_id"), "vec", F.xxhash64("vec").alias("qid")))
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))
    facts = classes.agg(F.count("*").alias("n"), F.max(length).alias("longest")).first()
    sample = _matrix(classes.orderBy(F.xxhash64(F.lit(SEED), "vec")).limit(SAMPLE).select("vec").toArrow().column(0))
    index = fit(sample, facts["n"], facts["longest"], k)
    best = _best(classes, asked.groupBy("qid").agg(F.first("vec").alias("vec")), index, k)
    # (k + 1) classes of k + 1 ids at most for each distinct query vector
    found = (best.join(classes.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("id"))
             .groupBy("qid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "id", "score"))).alias("near"))
             .select("qid", F.slice("near", 1, k + 1).alias("near")))
    own = F.slice(F.filter("near", lambda c: c["id"] != F.col("query_id")), 1, k)
    ranked = asked.select("query_id", "qid").join(found, "qid").select("query_id", F.posexplode(own).alias("rank", "c"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("c.id").alias(key), F.col("c.score").alias("score"))


def _best(classes: DataFrame, asked: DataFrame, index: Index, k: int) -> DataFrame:
    """qid, cid and score of the k + 1 best classes for every distinct query vector."""
    spark = classes.sparkSession
    sent = spark.sparkContext.broadcast(index)   # SAMPLE / VECTORS_PER_LIST centres at most

    @F.arrow_udf("int")
    def list_of(vecs: pa.Array) -> pa.Array:
        ix = sent.value
        x = _matrix(vecs)
        return pa.array(ix.order(ix.stored(x)).argmin(axis=1).astype(np.int32) if len(x) else np.zeros(0, np.int32))

    @F.arrow_udf("array<int>")
    def lists_of(vecs: pa.Array) -> pa.Array:
        ix = sent.value
        x = _matrix(vecs)
        near = np.argsort(ix.order(ix.asked(x)), axis=1)[:, : ix.probes] if len(x) else []
        return pa.array([[int(c) for c in row] for row in near], pa.list_(pa.int32()))

    held = cut_lineage(classes.select("cid", "vec", list_of("vec").alias("cell")))
    probed = cut_lineage(asked.select("qid", "vec", F.explode(lists_of("vec")).alias("cell")))
    parts = lambda df, n, name: df.groupBy("cell").agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    # a row for each list, bounded like the centres
    plan = cut_lineage(parts(held, LIST_PART, "x_parts").join(parts(probed, QUERY_PART, "q_parts"), "cell"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = (held.join(F.broadcast(plan), "cell").withColumn("x_part", F.pmod(F.col("cid"), F.col("x_parts")).cast("int"))
             .withColumn("q_part", spread("q_parts")).select("cell", "x_part", "q_part", "cid", "vec"))
    left = (probed.join(F.broadcast(plan), "cell").withColumn("q_part", F.pmod(F.col("qid"), F.col("q_parts")).cast("int"))
            .withColumn("x_part", spread("x_parts")).select("cell", "x_part", "q_part", "qid", "vec"))

    def compare(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        q, x = _matrix(queries.column("vec")), _matrix(candidates.column("vec"))
        qids, cids = np.asarray(queries.column("qid")), np.asarray(candidates.column("cid"))
        if len(q) and len(x):
            qi, xi = scan(sent.value, q, x, k + 1)
            score = np.concatenate([(q[qi[a : a + PAIRS]] * x[xi[a : a + PAIRS]]).sum(axis=1) for a in range(0, max(len(qi), 1), PAIRS)])
            order = np.lexsort((cids[xi], -score, qi))
            qi, xi, score = qi[order], xi[order], score[order]
            starts = np.searchsorted(qi, qi, "left")
            top = np.arange(len(qi)) - starts <= k
            # classes that tie with the last one stay, since any of them may hold the smaller id
            edge = np.minimum(starts + k, np.searchsorted(qi, qi, "right") - 1)
            top |= score == score[edge] if len(score) else top
            qi, xi, score = qi[top], xi[top], score[top]
        else:
            qi = xi = np.zeros(0, np.int64)
            score = np.zeros(0)
        return pa.table({"qid": pa.array(qids[qi], pa.int64()), "cid": pa.array(cids[xi], pa.int64()), "score": pa.array(score, pa.float64())})

    keys = ["cell", "x_part", "q_part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "qid long, cid long, score double")
    # distinct vectors seldom tie; where they do, rank keeps all that share the last place
    place = F.rank().over(Window.partitionBy("qid").orderBy(F.desc("score")))
    return found.withColumn("_r", place).where(F.col("_r") <= k + 1).drop("_r")


def _empty(vectors: DataFrame, key: str) -> DataFrame:
    kind = vectors.schema[key].dataType.simpleString()
    return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, {key} {kind}, score double")
