"""Approximate nearest neighbours by cells, for a corpus too large to compare in full.

The corpus is dealt to the nearest of about sqrt(n) centres, fitted on a bounded sample; a probe looks only into the
few cells whose centres are nearest to it, and scores there are exact.  How many cells it takes is read off trials: a
bounded sample of the probes gets its exact neighbours in the whole corpus, and the cells these lie in are ranked.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.operators import encode, similarity
from lexigrid.session import cut_lineage

N_LOOK = 8             # cells looked into at least
SAMPLE = 20_000        # rows that centres are fitted on, in the order of a hash; every row is placed
ROWS_PER_CELL = 8      # of the sample, at least
ROUNDS = 8             # of k-means
TRIALS = 256           # probes whose exact neighbours set the number of looks
TARGET_RECALL = 0.95   # among the trials, so that 0.9 is met beyond them too


def cell_search(corpus: DataFrame, probes: DataFrame, k: int, probe_key: str, corpus_key: str,
                n_cells: int | None = None, n_look: int | None = None, vec: str = "vec", same_keys: bool = False) -> DataFrame:
    """Approximate ``k`` nearest: probe_key, corpus_key, score, rank.

    Without ``n_look``, so many cells are searched as find TARGET_RECALL of the trials' true neighbours.  With
    ``same_keys`` both sides are rows of one table, and a probe is not its own neighbour.
    """
    corpus = cut_lineage(corpus.select(corpus_key, vec).where(F.col(vec).isNotNull()))
    probes = probes.select(probe_key, vec).where(F.col(vec).isNotNull())
    centres = _fit(corpus, corpus_key, vec, n_cells)
    table = pa.table({"cell": pa.array(range(len(centres)), pa.int32()), vec: pa.array(list(centres), pa.list_(pa.float64()))})
    middle = corpus.sparkSession.createDataFrame(table)
    placed = cut_lineage(similarity.nearest(corpus, middle, 1, [corpus_key], "cell", vec).drop("score", "rank"))
    n_look = n_look or _looks(placed, probes, centres, k, probe_key, corpus_key, vec, same_keys)
    looks = similarity.nearest(probes, middle, n_look, [probe_key], "cell", vec).drop("score", "rank")
    found = similarity.cross_blocks(looks, placed, k + same_keys, [probe_key], corpus_key, [], ["cell"], vec, "score", "rank")
    if same_keys:
        found = found.where(F.col(probe_key) != F.col(corpus_key))
    w = Window.partitionBy(probe_key).orderBy(F.desc("score"), F.asc(corpus_key))
    return (found.select(probe_key, corpus_key, "score").withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


def certified_search(corpus: DataFrame, probes: DataFrame, k: int, probe_key: str, corpus_key: str, n_cells: int | None = None,
                     width: int = N_LOOK, vec: str = "vec", same_keys: bool = False) -> DataFrame:
    """Exact ``k`` nearest by cells: probe_key, corpus_key, score, rank, and cells_read (of each probe).

    No row of a cell is nearer to a probe than the angle to its centre less the cell's widest angle.  A probe looks into
    the cells in the order of that bound, in two rounds, and is done once the next bound is under its k-th score.  Probes
    still open get the rest of the cells that may hold a nearer row: one by one if that are few, else in a fixed number of
    blocks of cells, so that a probe is sent a bounded number of times where bounds tell little.  ``cells_read`` counts
    the cells whose bound asked for them.  Rows of one key are told apart only as rows; vectors have one width.
    """
    corpus = cut_lineage(corpus.select(corpus_key, vec).where(F.col(vec).isNotNull()))
    centres = _fit(corpus, corpus_key, vec, n_cells)
    table = pa.table({"cell": pa.array(range(len(centres)), pa.int32()), vec: pa.array(list(centres), pa.list_(pa.float64()))})
    placed = similarity.nearest(corpus, corpus.sparkSession.createDataFrame(table), 1, [corpus_key], "cell", vec).drop("score", "rank")
    sent = corpus.sparkSession.sparkContext.broadcast(centres)   # sqrt(n) of them, bounded by the sample
    unit, tile = similarity.matrix_of, similarity.ROWS_PER_BLOCK

    @F.arrow_udf("double")
    def angle(vecs: pa.Array, cell: pa.Array) -> pa.Array:
        x = unit(vecs)
        out = np.arccos(np.clip((x * sent.value[np.asarray(cell)]).sum(axis=1), -1, 1)) if len(x) else np.zeros(0)
        return pa.array(np.where((x * x).sum(axis=1) > 0, out, np.pi) if len(x) else out)   # a zero vector has no angle

    placed = cut_lineage(placed.withColumn("_angle", angle(vec, "cell")))
    held = placed.groupBy("cell").agg(F.max("_angle").alias("r"), F.count("*").alias("n")).orderBy("cell").toArrow()   # a row for each cell
    cells, widest, sizes = (np.asarray(held.column(c)) for c in ("cell", "r", "n"))
    per_block = max(similarity.ROWS_PER_BLOCK, min(-(-int(sizes.sum()) // similarity.CROSS_BLOCKS), similarity.BLOCK_CELLS // max(centres.shape[1], 1)))
    blocks = (np.cumsum(sizes) - sizes) // per_block
    radii = corpus.sparkSession.sparkContext.broadcast((cells, widest))

    def asked_cells(vecs: pa.Array, floor: pa.Array, start: pa.Array, stop: pa.Array):
        """Per probe the cells from place ``start`` to ``stop`` of its order that may hold a row over its floor."""
        cells, widest = radii.value
        floor = np.asarray(floor)
        for s in range(0, len(vecs) if len(cells) else 0, tile):
            x = unit(vecs.slice(s, tile))
            bound = np.cos(np.maximum(np.arccos(np.clip(x @ sent.value[cells].T, -1, 1)) - widest, 0)) + 1e-6   # scores have six places
            bound[~x.any(axis=1)] = 1.0
            order = np.argsort(-bound, axis=1, kind="stable")[:, start[0].as_py():stop[0].as_py()]
            ok = np.take_along_axis(bound, order, axis=1) >= floor[s:s + len(x), None]
            yield from (cells[o[k]] for o, k in zip(order, ok))
        yield from (cells for _ in range(0 if len(cells) else len(vecs)))

    @F.arrow_udf("array<int>")
    def look(vecs: pa.Array, floor: pa.Array, start: pa.Array, stop: pa.Array) -> pa.Array:
        return pa.array(list(asked_cells(vecs, floor, start, stop)), pa.list_(pa.int32()))

    asked = cut_lineage(probes.select(probe_key, vec).where(F.col(vec).isNotNull()).withColumn("_p", F.monotonically_increasing_id()))
    best = counts = None
    n_cells, start = len(cells), 0
    open_ = asked.withColumn("_floor", F.lit(-2.0))
    w = Window.partitionBy(probe_key).orderBy(F.desc("score"), F.asc(corpus_key))

    def of_cells(looks: DataFrame) -> DataFrame:
        found = similarity.cross_blocks(looks, placed.drop("_angle"), k + same_keys, [probe_key], corpus_key, [], ["cell"], vec, "score", "rank")
        return found.select(probe_key, corpus_key, "score")

    def of_blocks(told: DataFrame) -> DataFrame:
        """The open probes against all rows of the blocks of cells that may hold one over their floor."""
        spark = corpus.sparkSession
        rows = cut_lineage(placed.select(corpus_key, vec, "cell").orderBy(corpus_key).withColumn("_c", F.monotonically_increasing_id()))
        parts = max(1, -(-told.count() // per_block))
        table = spark.createDataFrame(pa.table({"cell": pa.array(cells, pa.int32()), "_bc": pa.array(blocks.tolist(), pa.int32())}))
        left = told.select("_p", F.col(vec).alias("_pv"), F.explode("_blocks").alias("_bc")).withColumn("_bp", F.expr(f"pmod(xxhash64(_p), {parts})"))
        right = rows.join(F.broadcast(table), "cell").select("_c", F.col(vec).alias("_cv"), "_bc")
        right = right.withColumn("_bp", F.explode(F.expr(f"sequence(0L, {parts - 1}L)")))
        found = similarity.best_of_blocks(left, right, ["_bc", "_bp"], k + same_keys)
        return (found.join(asked.select("_p", probe_key), "_p").join(rows.select("_c", corpus_key), "_c")
                .select(probe_key, corpus_key, F.col("_score").alias("score")))

    for stop in (width, 3 * width, n_cells):
        if open_.isEmpty() or start >= max(n_cells, 1):
            break
        step = encode.once(look)(vec, "_floor", F.lit(start), F.lit(stop))
        told = None
        if start >= 3 * width:
            block_of = dict(zip(cells.tolist(), blocks.tolist()))
            listed = F.array(*[F.lit(block_of.get(c, -1)) for c in range(len(centres))])
            all_cells = encode.once(look)(vec, "_floor", F.lit(0), F.lit(n_cells))
            told = cut_lineage(open_.withColumn("_cells", all_cells).select(
                *open_.columns, (F.size("_cells") - start).cast("long").alias("_n"),
                F.array_distinct(F.transform("_cells", lambda c: F.get(listed, c))).alias("_blocks")).where(F.col("_n") > 0))
            if told.isEmpty():
                break
        if told is not None and told.agg(F.avg("_n")).first()[0] > 2 * similarity.CROSS_BLOCKS:
            found, read = of_blocks(told), told.select(probe_key, "_n")
            # blocks hold what earlier rounds found for these probes
            again = told.select(F.col(probe_key).alias("_again")).distinct()
            best = best.join(again, F.col(probe_key).eqNullSafe(F.col("_again")), "left_anti")
        else:
            looks = cut_lineage((told if told is not None else open_).select(probe_key, vec, F.explode(step).alias("cell")))
            found, read = of_cells(looks), looks.groupBy(probe_key).agg(F.count("*").alias("_n"))
        if same_keys:
            found = found.where(F.col(probe_key) != F.col(corpus_key))
        if best is not None:
            found = best.select(probe_key, corpus_key, "score").unionByName(found)
            read = counts.unionByName(read).groupBy(probe_key).agg(F.sum("_n").alias("_n"))
        best = cut_lineage(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
        counts = cut_lineage(read)
        start = stop
        floors = best.where(F.col("rank") == k).select(probe_key, F.col("score").alias("_floor"))
        open_ = asked.join(floors, probe_key, "left").withColumn("_floor", F.coalesce("_floor", F.lit(-2.0)))
    if best is None:
        return (asked.select(probe_key).join(corpus.select(F.col(corpus_key)), F.lit(False))
                .withColumns({"score": F.lit(0.0), "rank": F.lit(1), "cells_read": F.lit(0).cast("long")}))
    return best.join(counts, probe_key).select(probe_key, corpus_key, "score", "rank", F.col("_n").alias("cells_read"))


def _drawn(rows: DataFrame, key: str, vec: str, n: int) -> DataFrame:
    """``n`` rows in the order of a hash of their key."""
    return rows.orderBy(F.md5(F.col(key).cast("string")), key, vec).limit(n)


def _fit(corpus: DataFrame, key: str, vec: str, n_cells: int | None) -> np.ndarray:
    """Unit centres by k-means on the sample, which is bounded in rows and in numbers."""
    first = corpus.select(F.size(vec).alias("w")).first()
    if first is None:
        return np.zeros((0, 0))
    most = min(SAMPLE, max(1, similarity.SMALL_MATRIX_CELLS // max(first["w"], 1)))
    x = similarity.matrix_of(_drawn(corpus, key, vec, most).select(vec).toArrow().column(vec))
    cells = n_cells or min(math.ceil(math.sqrt(corpus.count())), max(1, math.ceil(len(x) / ROWS_PER_CELL)))
    centres = x[:cells].copy()
    for _ in range(ROUNDS):
        parts = range(0, len(x), similarity.ROWS_PER_BLOCK)
        near = np.concatenate([(x[a : a + similarity.ROWS_PER_BLOCK] @ centres.T).argmax(axis=1) for a in parts])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def _looks(placed: DataFrame, probes: DataFrame, centres: np.ndarray, k: int, probe_key: str, corpus_key: str,
           vec: str, same_keys: bool) -> int:
    """How many of the nearest cells hold TARGET_RECALL of the true neighbours of the trials; N_LOOK at least."""
    trials = _drawn(probes, probe_key, vec, TRIALS).toArrow()
    if not len(centres) or not trials.num_rows:
        return N_LOOK
    trials = trials.append_column("_trial", pa.array(range(trials.num_rows), pa.int32()))
    asked = probes.sparkSession.createDataFrame(trials)
    # rows get numbers of their own, since keys may repeat
    rows = cut_lineage(placed.withColumn("_row", F.monotonically_increasing_id()))
    true = similarity.search(rows.select("_row", vec), asked.select("_trial", vec), k + same_keys, "_trial", "_row", vec)
    true = true.join(rows.select("_row", corpus_key, "cell"), "_row")
    if same_keys:
        true = true.join(asked.select("_trial", probe_key), "_trial").where(F.col(probe_key) != F.col(corpus_key))
    best = true.withColumn("_n", F.row_number().over(Window.partitionBy("_trial").orderBy(F.desc("score"), corpus_key)))
    links = best.where(F.col("_n") <= k).select("_trial", "cell").toArrow()   # k for each trial
    if not links.num_rows:
        return N_LOOK
    scores = np.round(similarity.matrix_of(trials.column(vec)) @ centres.T, similarity.DIGITS)
    place = np.argsort(np.argsort(-scores, axis=1, kind="stable"), axis=1)    # of each cell, by nearness
    needed = np.sort(place[np.asarray(links.column("_trial")), np.asarray(links.column("cell"))]) + 1
    return max(N_LOOK, int(needed[math.ceil(TARGET_RECALL * len(needed)) - 1]))
