"""Searches and joins by cosine similarity.

Scores are rounded to ``DIGITS`` places before they are compared with a threshold or
ranked, and ties go to the smaller key: sums of products differ in their last bits with the
order of addition, and a result must not depend on how rows were partitioned.

Two shapes of work:

* one side is small (checked): its matrix is broadcast and the other side streams past it;
* neither is: rows are cut into blocks, each pair of blocks is one task, and a task gives back
  only what survives in it (best k, pairs over the threshold, or a spanning set of links), never
  all its pairs.  A row is sent once per block it meets, so blocks grow with their table and their
  number stays the same, as long as a block is within ``BLOCK_CELLS``; a task works in tiles of
  ``ROWS_PER_BLOCK`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions.vectors import dot_product, let, mean_vector, norm, unit
from lexigrid.operators.encode import once
from lexigrid.session import cut_lineage, fits, keep

DIGITS = 6
ROWS_PER_BLOCK = 2048
# a matrix is collected and broadcast only within both bounds
SMALL_MATRIX_ROWS = 50_000
SMALL_MATRIX_CELLS = 16_000_000
PIVOTS = 16
TILE_ROWS = 512  # of a tile that is left out as a whole where a threshold rules it out
NEXT = 4  # neighbours along a line that tell how good the best pairs are at least
# blocks that a large group is cut into, and the numbers that one block's vectors may have
BLOCKS = 16
CROSS_BLOCKS = 8
BLOCK_CELLS = 16_000_000
FOLD_ROWS = 1_000_000
LARGE_GROUP_ROWS = 100_000


def _rows_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The lists of an Arrow column as rows of a matrix; lists must have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros((0, 0))
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != lengths[0]).any():
        raise ValueError("vectors of one column must have one length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _unit_rows(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def matrix_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit rows, in double, of an Arrow list column whose lists have one length."""
    return _unit_rows(_rows_of(column))


# Rounding moves a score by at most half of this, so a screen that is looser by the whole
# of it keeps everything that can pass once rounded; only what it keeps gets rounded.
SLACK = 10.0 ** -DIGITS


def _best(raw: np.ndarray, order: np.ndarray, k: int, floor: float = -2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k best per row, scores rounded, at or over ``floor``.

    Ties go to the smaller ``order``, the place of each column's key.
    """
    k = min(k, raw.shape[1])
    if not raw.size:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    least = raw.max(axis=1) if k == 1 else np.partition(raw, raw.shape[1] - k, axis=1)[:, raw.shape[1] - k]
    r, c = np.nonzero(raw >= np.maximum(least, floor)[:, None] - SLACK)
    v = np.round(raw[r, c], DIGITS)
    ok = v >= floor
    r, c, v = r[ok], c[ok], v[ok]
    first = np.lexsort((order[c], -v, r))
    r, c, v = r[first], c[first], v[first]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], c[place < k], v[place < k]


def _screen(unit: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit rows in single precision, and how far a product of two may be from that in double."""
    return np.nan_to_num(unit).astype(np.float32), (unit.shape[1] + 8) * 2.0 ** -24


def _scores(a: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Rounded products, in double, of the rows ``r`` of ``a`` with the rows ``c`` of ``b``."""
    if len(r) * 16 > len(a) * len(b):
        return np.round((a @ b.T)[r, c], DIGITS)
    parts = [np.einsum("ij,ij->i", a[r[s:s + 100_000]], b[c[s:s + 100_000]]) for s in range(0, len(r), 100_000)]
    return np.round(np.concatenate(parts), DIGITS) if parts else np.zeros(0)


def _best_in_tiles(a: np.ndarray, b: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_best`` of raw vectors ``a`` against ``b``, of which only a tile of scores is held at a time.

    Products in single precision tell which rows of a tile may have a better one; those are scored in double.
    """
    found = []
    b32 = np.concatenate([_screen(_unit_rows(b[e:e + ROWS_PER_BLOCK]))[0] for e in range(0, len(b), ROWS_PER_BLOCK)]) if len(b) else None
    for s in range(0, len(a), ROWS_PER_BLOCK):
        ours = _unit_rows(a[s:s + ROWS_PER_BLOCK])
        a32, off = _screen(ours)
        r = c = np.zeros(0, dtype=np.int64)
        v = np.zeros(0)
        least = np.full(len(ours), -2.0)
        for e in range(0, len(b), ROWS_PER_BLOCK):
            raw = a32 @ b32[e:e + ROWS_PER_BLOCK].T
            top = raw.max(axis=1).astype(np.float64)
            floor = least - off - SLACK
            if k == 1 or not e:
                kth = top if k == 1 else np.partition(raw, raw.shape[1] - min(k, raw.shape[1]), axis=1)[:, raw.shape[1] - min(k, raw.shape[1])]
                floor = np.maximum(floor, kth - 2 * off - SLACK)
            some = np.flatnonzero(top >= floor)
            x, y = np.nonzero(raw[some] >= floor[some, None])
            if not len(x):
                continue
            x = some[x]
            new = x, y + e, _scores(ours, _unit_rows(b[e:e + ROWS_PER_BLOCK]), x, y)
            new = tuple(p[~np.isnan(new[2])] for p in new)
            r, c, v = (np.concatenate(p) for p in zip((r, c, v), new))
            first = np.lexsort((order[c], -v, r))
            r, c, v = r[first], c[first], v[first]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            r, c, v, place = (p[place < k] for p in (r, c, v, place))
            least[r[place == k - 1]] = v[place == k - 1]
        found.append((r + s, c, v))
    return tuple(np.concatenate(p) for p in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


# ---------------------------------------------------------------- one small side


def _collect_matrix(df: DataFrame, vec: str) -> pa.Table | None:
    """The rows of ``df`` if their number and matrix are within bounds, else None.

    The first row's vector tells how many rows are within the bound of cells, so no more are collected.
    """
    first = df.select(F.size(vec).alias("w")).first()
    most = SMALL_MATRIX_ROWS if first is None else min(SMALL_MATRIX_ROWS, SMALL_MATRIX_CELLS // max(first["w"], 1))
    table = df.limit(most + 1).toArrow()
    return table if table.num_rows <= most else None


def nearest(probes: DataFrame, corpus: DataFrame, k: int, probe_key: list[str], corpus_key: str,
            vec: str = "vec", score: str = "score", rank: str = "rank",
            corpus_cols: list[str] | None = None, group: list[str] | None = None) -> DataFrame:
    """The ``k`` corpus rows most similar to each probe row.

    Probe columns, then ``corpus_key`` and ``corpus_cols``, the score and the rank.  Ties go to
    the smaller key, then to the smaller other columns.  With ``group``, a probe sees only corpus
    rows of its own group (columns of the same names on both sides); NULL groups see nothing.
    Rows with one key, or with a NULL key, are rows of their own on both sides.  The size of the
    corpus decides how the work is laid out, never what comes out.
    """
    extra = corpus_cols or []
    group = group or []
    if set(probes.columns) & {corpus_key, *extra}:
        raise ValueError("probe and corpus columns must differ in name")
    small = _collect_matrix(corpus.select(*group, corpus_key, *extra, vec).where(F.col(vec).isNotNull()), vec)
    kept = probes.where(F.col(vec).isNotNull())
    if small is not None:
        return _stream_probes(kept, small, k, corpus_key, extra, group, vec, score, rank)
    return cross_blocks(kept, corpus.where(F.col(vec).isNotNull()), k, probe_key, corpus_key, extra, group, vec, score, rank)


def _stream_probes(probes, table, k, corpus_key, extra, group, vec, score, rank) -> DataFrame:
    spark = probes.sparkSession
    table = table.sort_by([(c, "ascending") for c in [*group, corpus_key, *extra]])
    attrs = table.select([corpus_key, *extra])
    keys = list(zip(*[table.column(c).to_pylist() for c in group])) if group else [()] * table.num_rows
    spans: dict[tuple, list[int]] = {}
    for i, key in enumerate(keys):
        spans.setdefault(key, [i, i])[1] = i + 1
    # one matrix per group: groups may hold vectors of different length
    shared = spark.sparkContext.broadcast(
        {key: (lo, matrix_of(table.column(vec).slice(lo, hi - lo))) for key, (lo, hi) in spans.items()})

    @F.arrow_udf("array<struct<at:int,score:double>>")
    def hits(vectors: pa.Array, *own: pa.Array) -> pa.Array:
        found = np.full((len(vectors), k), -1, dtype=np.int32)
        value = np.zeros((len(vectors), k))
        rows_of: dict[tuple, list[int]] = {}
        if own:
            for i, key in enumerate(zip(*[c.to_pylist() for c in own])):
                rows_of.setdefault(key, []).append(i)
        elif len(vectors):
            rows_of[()] = list(range(len(vectors)))
        for key, rows in rows_of.items():
            if key not in shared.value or None in key:
                continue
            lo, matrix = shared.value[key]
            for s in range(0, len(rows), ROWS_PER_BLOCK):
                part = np.array(rows[s:s + ROWS_PER_BLOCK])
                ours = matrix_of(vectors.take(pa.array(part)))
                r, c, v = _best(ours @ matrix.T, np.arange(len(matrix)), k)
                slot = np.arange(len(r)) - np.searchsorted(r, r)
                found[part[r], slot] = c + lo
                value[part[r], slot] = v
        ok = found.ravel() >= 0
        sizes = np.concatenate([[0], np.cumsum((found >= 0).sum(axis=1))]).astype(np.int32)
        cells = pa.StructArray.from_arrays(
            [pa.array(found.ravel()[ok]), pa.array(value.ravel()[ok])], names=["at", "score"])
        return pa.ListArray.from_arrays(pa.array(sizes), cells)

    cols = probes.columns
    found = probes.withColumn("_hits", once(hits)(vec, *group))
    found = found.select(*cols, F.posexplode("_hits").alias("_pos", "_hit"))
    # a local relation, so its size is known and the planner picks the join
    labels = spark.createDataFrame(attrs.append_column("_at", pa.array(np.arange(attrs.num_rows, dtype=np.int32))))
    return (found.withColumn("_at", F.col("_hit.at")).join(labels, "_at")
            .select(*cols, corpus_key, *extra, F.col("_hit.score").alias(score), (F.col("_pos") + 1).alias(rank)))


def cross_blocks(probes, corpus, k, probe_key, corpus_key, extra, group, vec, score, rank) -> DataFrame:
    """Blocks of probes against blocks of the corpus; each task keeps k per probe.

    Both sides get row ids of their own, so keys need not be unique; corpus ids follow the order in
    which ties are settled.
    """
    cols = probes.columns
    probes = cut_lineage(probes.withColumn("_p", F.monotonically_increasing_id()))
    by_key = [F.col(c).asc_nulls_last() for c in [*group, corpus_key, *extra]]
    corpus = cut_lineage(corpus.select(*group, corpus_key, *extra, vec).orderBy(*by_key).withColumn("_c", F.monotonically_increasing_id()))
    probe_blocks = probes.select(*group, "_p", F.col(vec).alias("_pv"))
    corpus_blocks = corpus.select(*group, "_c", F.col(vec).alias("_cv"))
    n_p, n_c = _block_counts(probe_blocks, group, "_pv"), _block_counts(corpus_blocks, group, "_cv")
    counts = _both(n_p.withColumnRenamed("_nb", "_np"), n_c.withColumnRenamed("_nb", "_nc"), group)
    left = _by_group(probe_blocks, counts, group).withColumn("_bp", F.expr("pmod(xxhash64(_p), _np)")) \
        .withColumn("_bc", F.explode(F.expr("sequence(0L, _nc - 1)")))
    right = _by_group(corpus_blocks, counts, group).withColumn("_bc", F.expr("pmod(xxhash64(_c), _nc)")) \
        .withColumn("_bp", F.explode(F.expr("sequence(0L, _np - 1)")))

    found = best_of_blocks(left, right, [*group, "_bp", "_bc"], k)
    w = Window.partitionBy("_p").orderBy(F.desc("_score"), F.asc("_c"))
    top = found.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
    top = top.select("_p", "_c", F.col("_score").alias(score), F.col("_rank").alias(rank))
    return (probes.join(top, "_p").join(corpus.select("_c", corpus_key, *extra), "_c")
            .select(*cols, corpus_key, *extra, score, rank))


def best_of_blocks(left: DataFrame, right: DataFrame, by: list[str], k: int) -> DataFrame:
    """The ``k`` best rows (_c, _cv) of a block's right side for each of its left side's (_p, _pv): _p, _c, _score."""

    def task(a: pa.Table, b: pa.Table) -> pa.Table:
        places = b.column("_c").combine_chunks()
        r, c, v = _best_in_tiles(_rows_of(a.column("_pv")), _rows_of(b.column("_cv")), places.to_numpy(), k)
        return pa.table({"_p": a.column("_p").combine_chunks().take(pa.array(r)), "_c": places.take(pa.array(c)),
                         "_score": pa.array(v, pa.float64())})

    # both sides may stem from one table: give the right one columns of its own
    right = right.select(*by, "_c", "_cv").toDF(*by, "_c", "_cv")
    return (left.select(*by, "_p", "_pv").groupBy(*by).cogroup(right.groupBy(*by))
            .applyInArrow(task, "_p long, _c long, _score double"))


def _ranks(keys: pa.Array) -> np.ndarray:
    """Place of each key in ascending order; equal keys share a place."""
    return pa.compute.rank(keys, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)


def search(corpus: DataFrame, probes: DataFrame, k: int, probe_key: str, corpus_key: str,
           vec: str = "vec", score: str = "score", rank: str = "rank") -> DataFrame:
    """The ``k`` corpus rows nearest to each of a few probes, over a corpus of any size.

    Each task keeps k per probe while its partition streams by, so the shuffle carries
    k rows per probe and partition.  Returns probe_key, corpus_key, score, rank.
    """
    probes = probes.where(F.col(vec).isNotNull())
    corpus = corpus.where(F.col(vec).isNotNull())
    small = _collect_matrix(probes.select(probe_key, vec), vec)
    if small is None or small.num_rows * k > SMALL_MATRIX_ROWS:
        found = cross_blocks(probes.select(probe_key, vec), corpus.select(corpus_key, vec), k,
                              [probe_key], corpus_key, [], [], vec, score, rank)
        return found.select(probe_key, corpus_key, score, rank)
    spark = corpus.sparkSession
    shared = spark.sparkContext.broadcast(matrix_of(small.column(vec)))
    kind = corpus.schema[corpus_key].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        held_p = np.zeros(0, dtype=np.int64)
        held_v = np.zeros(0)
        held_k: pa.Array | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0)
            if isinstance(keys, pa.ChunkedArray):
                keys = keys.combine_chunks()
            r, c, v = _best(matrix @ matrix_of(batch.column(1)).T, _ranks(keys), k)
            new_k = keys.take(pa.array(c))
            all_p, all_v = np.concatenate([held_p, r]), np.concatenate([held_v, v])
            all_k = new_k if held_k is None else pa.concat_arrays([held_k, new_k])
            order = np.lexsort((_ranks(all_k), -all_v, all_p))
            p = all_p[order]
            place = np.arange(len(p)) - np.searchsorted(p, p)
            keep_at = order[place < k]
            held_p, held_v, held_k = all_p[keep_at], all_v[keep_at], all_k.take(pa.array(keep_at))
        if held_k is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(held_p, pa.int64()), held_k, pa.array(held_v)], names=["_at", corpus_key, score])

    found = corpus.select(corpus_key, vec).mapInArrow(task, f"_at long, `{corpus_key}` {kind}, `{score}` double")
    w = Window.partitionBy("_at").orderBy(F.desc(score), F.col(corpus_key).asc_nulls_last())
    top = found.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
    # probes by their place, since keys may repeat; a local relation, so its size is known
    asked = spark.createDataFrame(small.select([probe_key]).append_column("_at", pa.array(np.arange(small.num_rows, dtype=np.int64))))
    return top.join(asked, "_at").select(probe_key, corpus_key, score, rank)


# ---------------------------------------------------------------- block joins of one table


def block_rows(n: Column, width: Column, blocks: int, least: int) -> Column:
    """Rows of a block: ``least``, or so many that the group's ``n`` rows make ``blocks``, but no more than ``BLOCK_CELLS`` numbers."""
    most = F.floor(F.lit(BLOCK_CELLS) / F.greatest(width, F.lit(1)))
    return F.greatest(F.lit(least).cast("long"), F.least(F.ceil(n / F.lit(blocks)), most))


def _block_counts(df: DataFrame, group: list[str], vec: str) -> DataFrame:
    sizes = df.groupBy(*group).agg(F.count("*").alias("_n"), F.coalesce(F.max(F.size(vec)), F.lit(1)).alias("_w"))
    rows = block_rows(F.col("_n"), F.col("_w"), CROSS_BLOCKS, ROWS_PER_BLOCK)
    return sizes.select(*group, F.ceil(F.col("_n") / rows).cast("long").alias("_nb"))


def _both(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    if group:
        return a.join(b, group)
    # two single rows: read them rather than join them
    n_a, n_b = a.first()["_np"], b.first()["_nc"]
    return a.sparkSession.createDataFrame([(n_a, n_b)], "_np long, _nc long")


def _by_group(df: DataFrame, counts: DataFrame, group: list[str]) -> DataFrame:
    if group:
        return join_groups(df, counts, group)
    row = counts.first()
    for name in counts.columns:
        df = df.withColumn(name, F.lit(row[name]))
    return df


def _pair_tasks(df: DataFrame, key: str, vec: str, group: list[str], threshold: float | None,
                rows_per_block: int, raised=None) -> DataFrame:
    """Rows sent to the block pairs they take part in: group, _lo, _hi, _mine, _key, _vec.

    Where a group is large, ``raised(rows)`` may find a higher threshold first.

    A group within ``rows_per_block`` is one task.  A larger one is cut into cells around
    pivots and cells into hash blocks, about ``BLOCKS`` of them; with a threshold, cell pairs that
    the triangle inequality rules out are never formed.
    """
    rows = keep(df.where(F.col(vec).isNotNull()).select(*group, F.col(key).alias("_key"), F.col(vec).alias("_vec")))
    sizes = keep(rows.groupBy(*group).agg(F.count("*").alias("_n")))
    any_large = sizes.where(F.col("_n") > rows_per_block).limit(1).count() > 0
    one = F.lit(0).cast("long")
    solo = [*group, one.alias("_lo"), one.alias("_hi"), one.alias("_mine"), "_key", "_vec"]
    if not any_large:
        return rows.select(*solo)
    threshold = raised(rows) if raised else threshold
    if not group:
        return _cells(rows, group, threshold, rows_per_block)
    marked = join_groups(rows, sizes, group)
    small = marked.where(F.col("_n") <= rows_per_block).select(*solo)
    large = marked.where(F.col("_n") > rows_per_block).drop("_n")
    return small.unionByName(_cells(large, group, threshold, rows_per_block))


def draw_vectors(df: DataFrame, n: int, vec: str = "vec") -> DataFrame:
    """``n`` different vectors picked by a hash of their value: the same ones on every run.

    Only hashes are shuffled to pick; the vectors picked are fetched afterwards.
    Columns: ``vec`` and ``_h``, the hash.
    """
    hashed = df.where(F.col(vec).isNotNull()).select(F.col(vec), F.xxhash64(vec).alias("_h"))
    picked = hashed.select("_h").distinct().orderBy(F.hash("_h"), "_h").limit(n)
    # at most n rows, so the broadcast is bounded
    return hashed.join(F.broadcast(picked), "_h").groupBy("_h").agg(F.min(vec).alias(vec))


def _cells(rows: DataFrame, group: list[str], threshold: float | None, rows_per_block: int) -> DataFrame:
    spark = rows.sparkSession
    rows = rows.where(F.size("_vec") > 0)
    shared = spark.sparkContext.broadcast(matrix_of(draw_vectors(rows, PIVOTS, "_vec").toArrow().column("_vec")))

    @F.arrow_udf("array<double>")
    def angles(vectors: pa.Array) -> pa.Array:
        turn = np.arccos(np.clip(matrix_of(vectors) @ shared.value.T, -1.0, 1.0))
        offsets = np.arange(len(turn) + 1, dtype=np.int32) * turn.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(turn.ravel()))

    placed = rows.withColumn("_ang", once(angles)("_vec"))
    placed = placed.withColumn("_cell", F.expr("cast(array_position(_ang, array_min(_ang)) as int)"))
    n_pivots = len(shared.value)
    bounds = placed.groupBy(*group, "_cell").agg(
        F.count("*").alias("_n"),
        F.array(*[F.min(F.col("_ang")[i]) for i in range(n_pivots)]).alias("_min"),
        F.array(*[F.max(F.col("_ang")[i]) for i in range(n_pivots)]).alias("_max"))
    # at most PIVOTS cells per group: number their blocks through, then pair the cells up
    cells = F.array_sort(F.collect_list(F.struct("_cell", "_n", "_min", "_max")))
    grouped = bounds.groupBy(*group).agg(cells.alias("_cells"), F.sum("_n").alias("_all"))
    size = block_rows(F.col("_all"), F.lit(shared.value.shape[1]), BLOCKS, rows_per_block)
    grouped = grouped.withColumn("_size", size).withColumn("_cells", F.expr(
        "transform(_cells, c -> struct(c._cell, cast(ceil(c._n / _size) as bigint) as _nb, c._min, c._max))"))
    grouped = grouped.withColumn("_first", F.expr(
        "transform(_cells, (c, i) -> aggregate(slice(_cells, 1, i), 0L, (s, x) -> s + x._nb))"))
    own = grouped.select(*group, "_cells", "_first", F.posexplode("_cells").alias("_i", "_c"))
    limit = np.pi if threshold is None else _angle_limit(threshold)
    gap = ("array_max(zip_with(zip_with(_c._min, o._max, (x, y) -> x - y), "
           "zip_with(o._min, _c._max, (x, y) -> x - y), (x, y) -> greatest(x, y)))")
    partners = F.expr(
        f"flatten(transform(_cells, (o, j) -> if({gap} <= {limit!r}D, "
        "sequence(_first[j], _first[j] + o._nb - 1), cast(array() as array<bigint>))))")
    plan = own.select(*group, F.col("_c._cell").alias("_cell"), F.col("_c._nb").alias("_nb"),
                      F.expr("_first[_i]").alias("_base"), partners.alias("_partners"))
    if not group:
        joined = placed.join(F.broadcast(plan), "_cell")  # at most PIVOTS rows
    else:
        joined = join_groups(placed, plan, [*group, "_cell"])
    blocks = joined.withColumn("_mine", F.expr("_base + pmod(xxhash64(_key), _nb)"))
    sent = blocks.select(*group, "_mine", F.explode("_partners").alias("_o"), "_key", "_vec")
    return sent.select(*group, F.least("_mine", "_o").alias("_lo"), F.greatest("_mine", "_o").alias("_hi"),
                       "_mine", "_key", "_vec")


def _angle_limit(threshold: float) -> float:
    """The angle that vectors may be apart whose rounded cosine reaches the threshold."""
    return float(np.arccos(np.clip(threshold - SLACK, -1.0, 1.0))) + 1e-9


def _near_tiles(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: int, limit: float) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs of tiles, (places, places, is it one tile?), between the places ``lo`` and ``hi`` that may hold rows ``limit`` apart.

    Places are laid out so that a tile's angles to some pivots span little; by the triangle inequality tiles whose spans are
    further apart than the limit hold no pair.
    """
    if not len(lo) or not len(hi):
        return []
    spread = rows[np.linspace(0, len(rows) - 1, min(len(rows), PIVOTS)).astype(np.int64)]
    pivots = _unit_rows(spread).T

    def tiles(at):
        turn = np.concatenate([np.arccos(np.clip(_unit_rows(rows[at[s:s + size]]) @ pivots, -1.0, 1.0)) for s in range(0, len(at), size)])
        done, left = [], [np.arange(len(at))]
        while left:
            part = left.pop()
            if len(part) <= size:
                done.append(part)
                continue
            widest = turn[part, np.argmax(np.ptp(turn[part], axis=0))]
            half = -(-len(part) // (2 * size)) * size
            cut = part[np.argpartition(widest, min(half, len(part) - 1))]
            left += [cut[:half], cut[half:]]
        done = [p for p in done if len(p)]
        return [at[p] for p in done], np.array([turn[p].min(axis=0) for p in done]), np.array([turn[p].max(axis=0) for p in done])

    same = lo is hi
    ours, low, high = tiles(lo)
    theirs, low_b, high_b = (ours, low, high) if same else tiles(hi)
    met = []
    for i in range(len(ours)):
        gap = np.maximum(low_b - high[i], low[i] - high_b).max(axis=1)
        met += [(ours[i], theirs[j], same and i == j) for j in np.flatnonzero(~(gap > limit)).tolist() if not same or j >= i]
    return met


def _in_tasks(df: DataFrame, key: str, vec: str, group: list[str], threshold: float | None, rows_per_block: int,
              inner, finish, out: str, fold=None, raised=None, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Run ``inner(a, at_a, b, at_b, same, order, held) -> rows`` on each tile of each block pair, but those that the threshold rules out.

    Rows are (place, place, value) arrays; places count the task's rows, and ``order`` ranks their keys.  Whenever
    ``fold_rows`` new rows have come together, ``fold(rows, order)`` cuts them down, and ``inner`` sees them as ``held``.
    ``finish(rows, order, keys)`` gives the Arrow columns of ``out``.
    """
    floors = [threshold]
    sent = _pair_tasks(df, key, vec, group, threshold, rows_per_block, raised and (lambda rows: floors.append(raised(rows)) or floors[-1]))
    limit = None if floors[-1] is None else _angle_limit(floors[-1])
    fields = [f"`{g}` {sent.schema[g].dataType.simpleString()}" for g in group]
    names = [f.split()[0] for f in out.split(", ")]

    def task(t: pa.Table) -> pa.Table:
        first, last = t.column("_lo")[0].as_py(), t.column("_hi")[0].as_py()
        keys = t.column("_key").combine_chunks()
        rows, order = _rows_of(t.column("_vec")), _ranks(keys)
        at = np.arange(len(keys))
        mine = t.column("_mine").to_numpy() == first
        lo, hi = (at, at) if first == last else (at[mine], at[~mine])
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        held, new = none, []

        def folded():
            done = tuple(np.concatenate(p) for p in zip(held, *new))
            return fold(done, order) if fold else done

        if limit is None:
            met = [(lo[s:s + rows_per_block], hi[e:e + rows_per_block], first == last and s == e) for s in range(0, len(lo), rows_per_block)
                   for e in range(s if first == last else 0, len(hi), rows_per_block)]
        else:
            met = _near_tiles(rows, lo, hi, min(rows_per_block, TILE_ROWS), limit)
        for x, y, same in met:
            a = _unit_rows(rows[x])
            new.append(inner(a, x, a if same else _unit_rows(rows[y]), y, same, order, held))
            if fold and sum(len(p[0]) for p in new) > max(fold_rows, len(held[0])):
                held, new = folded(), []
        cols = finish(folded(), order, keys)
        n = len(cols[0])
        head = [t.column(g).combine_chunks().take(pa.array(np.zeros(n, dtype=np.int64))) for g in group]
        return pa.Table.from_arrays([*head, *cols], names=[*group, *names])

    return sent.groupBy(*group, "_lo", "_hi").applyInArrow(task, ", ".join([*fields, out]))


def _above(a: np.ndarray, b: np.ndarray, same: bool, threshold: float, strict: bool):
    raw = a @ b.T
    if same:
        raw[np.tril_indices(len(raw))] = -np.inf
    r, c = np.nonzero(raw >= threshold - SLACK)
    v = np.round(raw[r, c], DIGITS)
    ok = v > threshold if strict else v >= threshold
    return r[ok], c[ok], v[ok]


def _ordered(i: np.ndarray, j: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of each pair, the one with the smaller key first."""
    swap = order[i] > order[j]
    return np.where(swap, j, i), np.where(swap, i, j)


def _pair_columns(rows, order: np.ndarray, keys: pa.Array) -> list[pa.Array]:
    one, two = _ordered(rows[0], rows[1], order)
    return [keys.take(pa.array(one)), keys.take(pa.array(two)), pa.array(rows[2])]


def pairs_above(df: DataFrame, key: str, threshold: float, group: list[str] | None = None, vec: str = "vec",
                strict: bool = False, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Every pair of distinct vectors (in one group) whose similarity reaches the threshold.

    Exact copies of a vector are one entry, named by their smallest key, with their number:
    a pair (a, b) with n_a and n_b copies stands for n_a * n_b row pairs, and the pair (a, a)
    for those among the copies of a.  Returns group, key_a, key_b, n_a, n_b, score.
    """
    group = group or []
    distinct = df.where(F.col(vec).isNotNull()).groupBy(*group, vec).agg(
        F.min(key).alias("_rep"), F.count("*").alias("_copies"))
    distinct = keep(distinct.select(*group, "_rep", "_copies", F.col(vec).alias("_v")))
    k_type = distinct.schema["_rep"].dataType.simpleString()

    def inner(a, at_a, b, at_b, same, order, held):
        r, c, v = _above(a, b, same, threshold, strict)
        return at_a[r], at_b[c], v

    pairs = _in_tasks(distinct, "_rep", "_v", group, threshold, rows_per_block, inner, _pair_columns,
                      f"key_a {k_type}, key_b {k_type}, score double")
    copies = distinct.select(*group, "_rep", "_copies").where(F.col("_copies") > 1)
    n_a = copies.select(*group, F.col("_rep").alias("key_a"), F.col("_copies").alias("n_a"))
    n_b = copies.select(*group, F.col("_rep").alias("key_b"), F.col("_copies").alias("n_b"))
    one = F.lit(1).cast("long")
    counted = pairs.join(n_a, [*group, "key_a"], "left").join(n_b, [*group, "key_b"], "left")
    counted = counted.select(*group, "key_a", "key_b", F.coalesce("n_a", one).alias("n_a"),
                             F.coalesce("n_b", one).alias("n_b"), "score")
    same = copies.select(*group, F.col("_rep").alias("key_a"), F.col("_rep").alias("key_b"),
                         F.col("_copies").alias("n_a"), F.col("_copies").alias("n_b"), F.lit(1.0).alias("score"))
    nonzero = distinct.where(F.exists("_v", lambda x: x != 0.0)).select(*group, F.col("_rep").alias("key_a"))
    if (threshold < 1.0) or (not strict and threshold <= 1.0):
        counted = counted.unionByName(same.join(nonzero, [*group, "key_a"], "left_semi"))
    return counted


def top_pairs(df: DataFrame, key: str, n: int, group: list[str] | None = None, vec: str = "vec",
              above: float | None = None, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """The ``n`` most similar pairs over all groups; each task gives back its own best n.

    Where a group is large, some pairs are scored first (``_sure_floor``): what their nth best has is the threshold by which
    blocks and tiles are left out.
    """
    group = group or []
    k_type = df.schema[key].dataType.simpleString()
    floor = -2.0 if above is None else above

    def best(rows, order):
        i, j, v = rows
        one, two = _ordered(i, j, order)
        if len(v) > n:
            # of many equal scores only those of the smallest keys are sorted
            cut = np.partition(v, len(v) - n)[len(v) - n]
            over, tied = np.flatnonzero(v > cut), np.flatnonzero(v == cut)
            place = order[one[tied]] * (len(order) + 1) + order[two[tied]]
            more = n - len(over)
            at = np.concatenate([over, tied[np.argpartition(place, more - 1)[:more]] if len(tied) > more else tied])
            one, two, v = one[at], two[at], v[at]
        at = np.lexsort((order[two], order[one], -v))
        return one[at], two[at], v[at]

    def inner(a, at_a, b, at_b, same, order, held):
        (x, off), (y, _) = _screen(a), _screen(b)
        raw = x @ y.T
        if same:
            raw[np.tril_indices(len(raw))] = -np.inf
        least = max([sure[-1], *([held[2].min()] if len(held[2]) >= n else [])])
        if raw.size > n and len(held[2]) < n and least <= floor:
            least = max(least, np.partition(raw, raw.size - n, axis=None)[raw.size - n] - off)
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if not raw.max(initial=-np.inf) >= least - SLACK - off:
            return none
        r, c = np.nonzero(raw >= max(least - SLACK - off, -3.0))
        v = _scores(a, b, r, c)
        ok = v > floor
        return best((at_a[r[ok]], at_b[c[ok]], v[ok]), order)

    sure = [floor]

    def raised(rows):
        sure.append(max(floor, _sure_floor(rows, n, group)))
        return None if sure[-1] <= -1.0 else sure[-1]

    found = _in_tasks(df, key, vec, group, above, rows_per_block, inner, _pair_columns,
                      f"key_a {k_type}, key_b {k_type}, score double", best, raised, n)
    return found.orderBy(F.desc("score"), *group, "key_a", "key_b").limit(n)


def _sure_floor(rows: DataFrame, n: int, group: list[str]) -> float:
    """A score that at least ``n`` pairs of rows (_vec) have: the nth best among neighbours along a line, -2 if there are not so many.

    Rows are put in order of their groups and their angles to a few pivots, where copies and near copies lie side by side.
    """
    rows = rows.where(F.size("_vec") > 0)
    shared = rows.sparkSession.sparkContext.broadcast(matrix_of(draw_vectors(rows, 3, "_vec").toArrow().column("_vec")))

    @F.arrow_udf("array<double>")
    def along(vectors: pa.Array) -> pa.Array:
        near = np.round(matrix_of(vectors) @ shared.value.T, DIGITS)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, last = np.zeros(0), None
        for batch in batches:
            t = pa.Table.from_batches([batch] if last is None else [last, batch])
            vecs = matrix_of(t.column("_vec"))
            heads = t.column("_of").to_numpy()
            for d in range(1, min(NEXT + 1, len(vecs))):
                # what came with the batch before was compared with its own there
                first = max(0, (len(last) if last is not None else 0) - d)
                score = np.einsum("ij,ij->i", vecs[first:-d], vecs[first + d:])[heads[first:-d] == heads[first + d:]]
                top = np.sort(np.concatenate([top, np.round(score[~np.isnan(score)], DIGITS)]))[-n:]
            t = t.slice(max(0, len(vecs) - NEXT)).combine_chunks()
            last = t.to_batches()[0] if t.num_rows else last
        yield pa.RecordBatch.from_arrays([pa.array(top)], names=["score"])

    laid = rows.select(F.xxhash64(*group) if group else F.lit(0).cast("long"), "_vec").toDF("_of", "_vec").withColumn("_at", once(along)("_vec"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = laid.repartitionByRange(tasks, "_of", "_at").sortWithinPartitions("_of", "_at").select("_of", "_vec")
    top = line.mapInArrow(task, "score double").orderBy(F.desc("score")).limit(n).collect()
    return top[-1]["score"] if len(top) == n else -2.0


def best_neighbour(df: DataFrame, key: str, group: list[str] | None = None, vec: str = "vec",
                   at_least: float | None = None, rows_per_block: int = ROWS_PER_BLOCK, k: int = 1) -> DataFrame:
    """For each row its ``k`` most similar other rows of its group: group, key, neighbour, score, rank.

    Rows without another row (at or over ``at_least``) do not appear.
    """
    group = group or []
    k_type = df.schema[key].dataType.simpleString()
    floor = -2.0 if at_least is None else at_least

    def inner(a, at_a, b, at_b, same, order, held):
        raw = a @ b.T
        if same:
            np.fill_diagonal(raw, -np.inf)
        r, c, v = _best(raw, order[at_b], k, floor)
        if same:
            return at_a[r], at_b[c], v
        r2, c2, v2 = _best(raw.T, order[at_a], k, floor)
        return np.concatenate([at_a[r], at_b[r2]]), np.concatenate([at_b[c], at_a[c2]]), np.concatenate([v, v2])

    def best(rows, order):
        i, j, v = rows
        at = np.lexsort((order[j], -v, i))
        i, j, v = i[at], j[at], v[at]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        return i[place < k], j[place < k], v[place < k]

    def columns(rows, order, keys):
        return [keys.take(pa.array(rows[0])), keys.take(pa.array(rows[1])), pa.array(rows[2])]

    found = _in_tasks(df, key, vec, group, at_least, rows_per_block, inner, columns,
                      f"{key} {k_type}, neighbour {k_type}, score double", best)
    w = Window.partitionBy(*group, key).orderBy(F.desc("score"), F.asc("neighbour"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def links(df: DataFrame, key: str, threshold: float, group: list[str] | None = None, vec: str = "vec",
          rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Enough of the edges at or over the threshold to connect what they all connect.

    A task joins up its own rows and gives back one link per joined row, so the result
    grows with rows, not with pairs.  Returns group, a, b.
    """
    group = group or []
    k_type = df.schema[key].dataType.simpleString()

    def spanning(n, i, j):
        """One link (root, row) for each of ``n`` rows that the links (i, j) join to an earlier one."""
        root = np.arange(n)
        while True:
            low = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        joined = np.flatnonzero(root != np.arange(n))
        return root[joined], joined

    def inner(a, at_a, b, at_b, same, order, held):
        r, c, _ = _above(a, b, same, threshold, False)
        at = at_a if same else np.concatenate([at_a, at_b])
        root, joined = spanning(len(at), r, c if same else c + len(at_a))
        return at[root], at[joined], np.zeros(len(joined))

    def fewer(rows, order):
        root, joined = spanning(len(order), rows[0], rows[1])
        return root, joined, np.zeros(len(joined))

    def columns(rows, order, keys):
        return [keys.take(pa.array(rows[0])), keys.take(pa.array(rows[1]))]

    return _in_tasks(df, key, vec, group, threshold, rows_per_block, inner, columns, f"a {k_type}, b {k_type}", fewer)


# ---------------------------------------------------------------- means over a group


def mean_similarity(df: DataFrame, key: list[str], group: list[str], vec: str = "vec",
                    out: str = "avg_sim") -> DataFrame:
    """Mean similarity of each row to the other rows of its group, without forming a pair.

    With unit vectors the sum of similarities to all rows is v . S, S being the group's
    vector sum, so the mean over the others is (v . S - v . v) / (n - 1).  Rows alone in
    their group get NULL.  Keys must be unique within a group.  ``df`` is read twice and only its means are kept: its
    vectors may be many times the size of what they are made from.
    """
    sums = keep(mean_vector(df.withColumn("_u", unit(F.col(vec))), group, "_u", "_mean", "_n"))
    large = not sums.where(F.col("_n") > LARGE_GROUP_ROWS).isEmpty()
    length = let(norm(F.col(vec)), lambda s: F.struct(F.nullif(s, F.lit(0.0)).alias("s"), (s > 0.0).cast("double").alias("own")))
    joined = join_groups(df, sums, group, salts=16 if large else 1).withColumn("_len", length)
    whole = F.coalesce(dot_product(F.col(vec), F.col("_mean")) / F.col("_len.s"), F.col("_len.own"))
    value = (whole * F.col("_n") - F.col("_len.own")) / F.nullif(F.col("_n") - 1, F.lit(0))
    return joined.withColumn(out, F.round(value, DIGITS)).drop("_len", "_mean", "_n")


def join_groups(rows: DataFrame, per_group: DataFrame, group: list[str], how: str = "inner",
                salts: int = 16) -> DataFrame:
    """Join rows to one row per group without sending a large group to one task.

    The group side is broadcast when it is small (counted); otherwise rows are spread over
    ``salts`` copies of it.  One copy will do where no group is large.
    """
    per_group = keep(per_group)
    if fits(per_group):
        return rows.join(F.broadcast(per_group), group, how)
    if salts == 1:
        return rows.join(per_group, group, how)
    spread = rows.withColumn("_salt", F.expr(f"pmod(xxhash64({', '.join(f'`{c}`' for c in rows.columns)}), {salts})"))
    copies = per_group.withColumn("_salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))
    return spread.join(copies, [*group, "_salt"], how).drop("_salt")
