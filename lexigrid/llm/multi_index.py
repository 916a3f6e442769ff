"""Hard negatives from an inverted multi-index.

Each half of the vectors has a codebook of its own, and a row's cell is its pair of codes.  A row's half product with
an anchor is at most the product with the half's centre plus the half's radius times the length of the anchor's half,
so the sum of two such bounds is a bound for a whole cell.  A heap walks the two sorted sequences of half bounds and
visits the cells in the order of their sums.  An anchor asks for the best rows in windows of scores; it stops when the
bound of the next cell is under what could still change any of its windows.

Rows lie in shards in the order of their cells; a task walks one shard for one block of anchors, and what the shards
certify is merged.  Positives are the windows without bounds over the anchor's own label; each positive then gives the
window in which its hard negatives are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.llm.common import ranked, short_batches, stored
from lexigrid.llm.norm_buckets import EXACT, matrix, usable, whole_numbers

CODES = 16                  # in the codebook of a half
SAMPLE_NUMBERS = 1 << 20    # components of the sample that codebooks are fitted on, in the order of a hash; every row is indexed
ROWS_PER_CODE = 8           # of the sample, at least
ROUNDS = 10                 # of k-means
SHARD_NUMBERS = 1 << 20     # components in a shard and in a block of anchors, at most
BLOCK_NUMBERS = 1 << 19
STRIDE = 4                  # cells that an anchor visits before it looks whether it may stop; doubles every time
SEED = 13
ANY = 1 << 62               # a score beyond all others
CHUNK = 1 << 22             # products held at once
_SLACK = 1e-9               # bounds are floating-point numbers; products are exact


class Codebooks:
    """Centres of both halves, for vectors of one width."""

    def __init__(self, width: int, sample: np.ndarray | None = None, codes: int = CODES):
        self.half = width // 2
        parts = [np.zeros((1, self.half)), np.zeros((1, width - self.half))]
        if sample is not None and len(sample):
            m = int(np.clip(len(sample) // ROWS_PER_CODE, 1, codes))
            parts = [_centres(x, m) for x in (sample[:, : self.half], sample[:, self.half :])]
        self.parts = parts

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def cells(self, x: np.ndarray) -> np.ndarray:
        first, second = (_nearest(h, c) for h, c in zip(self.halves(x), self.parts))
        return first * len(self.parts[1]) + second


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


def _centres(x: np.ndarray, m: int) -> np.ndarray:
    centres = x[np.random.default_rng(SEED).permutation(len(x))[:m]].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=m)[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


def multi_sequence(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, place in first, place in second) of all pairs, in descending order of the sums, by a heap.

    Pairs with -inf are not visited.  A pair enters the heap when the pair before it in its row has left; the first
    of a row, when the first of the row before has.
    """
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    x = [v for v in first[a].tolist() if v > -np.inf]
    y = [v for v in second[b].tolist() if v > -np.inf]
    heap = [(-(x[0] + y[0]), 0, 0)] if x and y else []
    while heap:
        less, i, j = heapq.heappop(heap)
        yield -less, int(a[i]), int(b[j])
        if j + 1 < len(y):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))


class Shard:
    """Rows sorted by cell, with the radii of the halves around their centres."""

    def __init__(self, books: Codebooks, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        cells = books.cells(vectors)
        order = np.lexsort((ids, cells))
        self.books, self.ids, self.labels, self.vectors = books, ids[order], labels[order], vectors[order]
        self.codes = [len(c) for c in books.parts]
        bounds = np.searchsorted(cells[order], np.arange(self.codes[0] * self.codes[1] + 1))
        self.start, self.stop = bounds[:-1], bounds[1:]
        codes = np.divmod(cells[order], self.codes[1])
        self.radii = []
        for h, centres, code in zip(books.halves(self.vectors), books.parts, codes):
            radii = np.full(len(centres), -np.inf)   # codes without rows bound nothing
            np.maximum.at(radii, code, np.sqrt(((h - centres[code]) ** 2).sum(axis=1)))
            self.radii.append(radii)

    def half_bounds(self, anchors: np.ndarray) -> list[np.ndarray]:
        out = []
        for h, centres, radii in zip(self.books.halves(anchors), self.books.parts, self.radii):
            length = np.sqrt((h * h).sum(axis=1))
            with np.errstate(invalid="ignore"):
                bound = h @ centres.T + length[:, None] * np.where(radii > -np.inf, radii, 0)[None, :]
            bound += _SLACK * (1 + np.abs(bound))
            out.append(np.where(radii[None, :] > -np.inf, bound, -np.inf))
        return out


def walk(shard: Shard, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
    """Per window the k best rows of a shard: (anchor place, window, row id, score), and how many cells were visited.

    ``low`` and ``high`` are [anchor, window]: a window takes the rows with scores between them, of the anchor's label
    if ``same`` or of the others if not, and never the anchor's own id.  Ties go to the smaller id.
    """
    lengths = [np.sqrt((x * x).sum(axis=1).max(initial=0.0)) for x in (anchors, shard.vectors)]
    if lengths[0] * lengths[1] >= 2.0 ** 62:
        raise OverflowError("inner products don't fit into a long")
    whole = lengths[0] * lengths[1] >= EXACT   # beyond double precision
    left, right = (anchors.astype(np.int64), shard.vectors.astype(np.int64)) if whole else (anchors, shard.vectors)
    windows = low.shape[1]
    bounds = shard.half_bounds(anchors)
    paths = [multi_sequence(bounds[0][a], bounds[1][a]) for a in range(len(anchors))]
    heads = [next(p, None) for p in paths]
    nothing = tuple(np.zeros(0, np.int64) for _ in range(3))
    kept = [nothing] * windows       # per window: anchor place, score and id of its best so far
    floor = low.astype(np.float64)   # what a row must reach to change a window
    done = low > high                # windows that no score is in need nothing
    open_ = [a for a in range(len(anchors)) if heads[a] is not None and not done[a].all()]

    def take(found: list[tuple[np.ndarray, ...]]) -> None:
        new = tuple(np.concatenate(c) for c in zip(*found)) if found else nothing
        for w in range(windows):
            inside = (new[1] >= low[new[0], w]) & (new[1] <= high[new[0], w])
            a, score, row = (np.concatenate([old, n[inside]]) for old, n in zip(kept[w], new))
            order = np.lexsort((row, -score, a))
            a, score, row = a[order], score[order], row[order]
            place = np.arange(len(a)) - np.searchsorted(a, a, "left")
            kept[w] = tuple(c[place < k] for c in (a, score, row))
            floor[a[place == k - 1], w] = score[place == k - 1]

    def span() -> tuple[np.ndarray, np.ndarray]:
        return np.where(done, np.inf, floor).min(axis=1), np.where(done, -np.inf, high.astype(np.float64)).max(axis=1)

    visited, stride = 0, STRIDE
    while open_:
        by_cell: dict[int, list[int]] = {}
        for a in open_:
            more = stride
            while heads[a] is not None and more:
                _, i, j = heads[a]
                cell = i * shard.codes[1] + j
                if shard.start[cell] < shard.stop[cell]:
                    by_cell.setdefault(cell, []).append(a)
                    more -= 1
                heads[a] = next(paths[a], None)
        least, most = span()
        found, held = [], 0
        for cell, who in by_cell.items():
            visited += len(who)
            rows = slice(shard.start[cell], shard.stop[cell])
            step = max(1, CHUNK // (rows.stop - rows.start))
            for c in range(0, len(who), step):
                at = np.array(who[c : c + step])
                scores = left[at] @ right[rows].T
                fits = (scores >= least[at, None]) & (scores <= most[at, None])
                fits &= (shard.labels[rows][None, :] == labels[at, None]) == same
                fits &= shard.ids[rows][None, :] != ids[at, None]
                y, x = np.nonzero(fits)
                found.append((at[y], scores[y, x].astype(np.int64), shard.ids[rows][x]))
                held += len(y)
                if held > CHUNK:   # no more than this waits to be sorted
                    take(found)
                    found, held = [], 0
                    least, most = span()
        take(found)
        # certified: no row left reaches the window, or none betters its k-th; equal scores may by their ids
        for a in open_:
            done[a] |= heads[a] is None or heads[a][0] < floor[a]
        open_, stride = [a for a in open_ if not done[a].all()], 2 * stride
    out = [(a, np.full(len(a), w, np.int64), row, score) for w, (a, score, row) in enumerate(kept)]
    return tuple(np.concatenate(c) for c in zip(*out)), visited


def _stretch(numbers: int) -> Column:
    """Which run of rows, of at most so many components together, a row's place belongs to."""
    rows = F.greatest(F.lit(1), F.floor(F.lit(numbers) / F.greatest(F.col("width"), F.lit(1))))
    return F.floor(F.col("at") / rows).cast("long")


class MultiIndex:
    """Codebooks and the rows of a table in shards."""

    def __init__(self, rows: DataFrame, shard_numbers: int = SHARD_NUMBERS, codes: int = CODES):
        """``rows``: id, label, width, vec (whole numbers)."""
        widest = rows.agg(F.max("width")).first()[0] or 1
        drawn = rows.orderBy(F.xxhash64(F.lit(SEED), "vec"), "id").limit(max(1, SAMPLE_NUMBERS // widest)).select("width", "vec").toArrow()
        widths = np.asarray(drawn.column("width"))
        self.books = {int(w): Codebooks(int(w), matrix(drawn.column("vec").filter(pa.array(widths == w)), int(w)), codes) for w in np.unique(widths)}
        sent = self.sent = rows.sparkSession.sparkContext.broadcast(self.books)   # a few centres for each width of the sample

        @F.arrow_udf("long")
        def cell_of(vecs: pa.Array, width: pa.Array) -> pa.Array:
            out = np.zeros(len(vecs), np.int64)
            sizes = np.asarray(width)
            for w in np.unique(sizes):
                at = np.nonzero(sizes == w)[0]
                out[at] = _books(sent.value, int(w)).cells(matrix(pa.chunked_array([vecs.take(pa.array(at))]), int(w)))
            return pa.array(out)

        held = ranked(rows.withColumn("cell", cell_of("vec", "width")), "width", [F.col("cell"), F.col("id")])
        self.held = held.select("width", _stretch(shard_numbers).alias("shard"), "id", "label", "vec")
        length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
        self.shards = stored(self.held.groupBy("width", "shard").agg(F.max(length).alias("longest")), "shards")

    def windows(self, asked: DataFrame, same: bool, k: int) -> DataFrame:
        """width, aid, window, id and score of the k best rows of each shard in each window of ``asked``.

        ``asked``: width, block, aid, id, label, vec, low and high (lists, one entry a window).
        """
        length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
        reach = F.array_min("low") <= length * F.col("longest") * (1 + _SLACK) + 1
        left = stored(asked.join(self.shards, "width").where(reach).drop("longest"), "asked")
        blocks = left.select("width", "shard", F.col("block").alias("part")).distinct()
        right = self.held.join(blocks, ["width", "shard"])
        sent = self.sent

        def compare(a: pa.Table, b: pa.Table) -> pa.Table:
            names = ("aid", "window", "id", "score")
            if not a.num_rows or not b.num_rows:
                return pa.table({"width": pa.array([], pa.int32()), **{c: pa.array([], pa.int64()) for c in names}})
            w = a.column("width")[0].as_py()
            shard = Shard(_books(sent.value, w), np.asarray(b.column("id")), np.asarray(b.column("label")), matrix(b.column("vec"), w))
            # anchors may ask for windows of different numbers; those that are missing take nothing
            sizes = np.asarray([len(x) for x in a.column("low").to_pylist()])
            low, high = (np.full((a.num_rows, sizes.max()), fill, np.int64) for fill in (1, 0))
            for box, name in ((low, "low"), (high, "high")):
                for row, values in enumerate(a.column(name).to_pylist()):
                    box[row, : len(values)] = values
            found, _ = walk(shard, np.asarray(a.column("id")), np.asarray(a.column("label")), matrix(a.column("vec"), w), low, high, same, k)
            columns = [np.asarray(a.column("aid"))[found[0]], *found[1:]]
            return pa.table({"width": pa.array([w] * len(found[0]), pa.int32()), **{c: pa.array(x, pa.int64()) for c, x in zip(names, columns)}})

        pairs = left.groupBy("width", "shard", "block").cogroup(right.groupBy("width", "shard", "part"))
        return pairs.applyInArrow(compare, "width int, aid long, window long, id long, score long")


def _books(books: dict[int, Codebooks], width: int) -> Codebooks:
    return books[width] if width in books else Codebooks(width)


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("width", "aid", "window").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
         key: str = "vec_id", vec: str = "embedding", label: str = "label", shard_numbers: int = SHARD_NUMBERS,
         block_numbers: int = BLOCK_NUMBERS, codes: int = CODES) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    ``anchors`` is a condition on ``vectors``.  An anchor's positives are its nearest rows of the same label, by integer
    inner product; a positive's hard negatives are the highest rows of other labels whose score is from ``low`` to
    ``high`` per cent of the positive's.  Ties go to the smaller id.  Rows with null id or label, or a vector that is
    null or holds null or non-finite components, take no part; all-zero vectors do.  Repeated rows (one id, label and
    vector) count once, and no row of the anchor's id is its positive or negative.  Vectors of different dimensions
    don't meet.  Ids and labels are integers; scores beyond a long are an error.  Other columns are only read by
    ``anchors``.
    """
    short_batches(vectors)
    rows = (vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vec).alias("_v"),
                           F.coalesce(anchors, F.lit(False)).alias("_asks"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("_v"))).distinct()
            .select("id", "label", F.size("_v").alias("width"), whole_numbers(F.col("_v"), scale).alias("vec"), "_asks"))
    rows = stored(rows, "rows")
    index = MultiIndex(rows.drop("_asks"), shard_numbers, codes)
    asked = ranked(rows.where("_asks").drop("_asks"), "width", [F.col("id"), F.col("label")])
    asked = stored(asked.select("width", _stretch(block_numbers).alias("block"), F.col("at").alias("aid"), "id", "label", "vec"), "anchors")
    everything = asked.withColumns({"low": F.array(F.lit(-ANY)), "high": F.array(F.lit(ANY))})
    near = stored(_best(index.windows(everything, True, positives), positives), "positives")
    # at most ``positives`` rows for each anchor
    lists = near.groupBy("width", "aid").agg(F.sort_array(F.collect_list(F.struct("place", F.col("id").alias("p"), F.col("score").alias("s")))).alias("near"))
    lists = lists.withColumns({"low": F.transform("near", lambda c: F.ceil(c["s"].cast("decimal(25,0)") * low / 100).cast("long")),
                               "high": F.transform("near", lambda c: F.floor(c["s"].cast("decimal(25,0)") * high / 100).cast("long"))})
    windows = asked.join(lists.select("width", "aid", "low", "high"), ["width", "aid"])
    found = _best(index.windows(windows, False, negatives), negatives)
    named = asked.select("width", "aid", F.col("id").alias("anchor_id")).join(lists.select("width", "aid", "near"), ["width", "aid"])
    out = found.join(named, ["width", "aid"]).withColumn("_p", F.element_at("near", (F.col("window") + 1).cast("int")))
    return out.select("anchor_id", F.col("_p.p").alias("positive_id"), F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                      F.col("_p.s").alias("positive_score"), F.col("score").alias("negative_score"))


def sql(positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, every: int = 100) -> str:
    """DuckDB SQL for ``mine`` over embeddings, with the labels of every seventh id moved on by one."""
    return f"""WITH v AS MATERIALIZED (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS e FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % {every} = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {positives})
SELECT anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT s.same AND {low} * p.score <= 100 * s.score AND 100 * s.score <= {high} * p.score QUALIFY rank <= {negatives}"""
