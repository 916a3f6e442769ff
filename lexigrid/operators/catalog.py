"""Column catalogs: choosing tables, column types, and the texts that describe them.

A catalog row is (domain, resource_id, field_name, data_type, ordinal_position), with
``description`` and ``tt_end`` where the source has them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.functions.text import names
from lexigrid.functions.vectors import dot_product, mean_vector, unit
from lexigrid.operators.ranking import draw, joined_list, top_per_group
from lexigrid.operators.similarity import join_groups
from lexigrid.session import cut_lineage, keep

TABLE = ["domain", "resource_id"]
OPEN_END = "9999-12-31"  # fixed value


def current(df: DataFrame, tt_end: str = "tt_end") -> DataFrame:
    """Rows of the newest version."""
    return df.where(F.col(tt_end).cast("string").startswith(OPEN_END))


def of_top_groups(df: DataFrame, group: list[str], n: int) -> DataFrame:
    """The rows of the ``n`` groups with the most rows; ties go to the smaller group."""
    top = df.groupBy(*group).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), *group).limit(n).select(*group)
    return df.join(F.broadcast(top), group, "left_semi")  # n rows


def listed_columns(spark: SparkSession, names_list: str) -> DataFrame:
    """A comma list of column names as rows: field_name, ordinal_position."""
    listed = spark.range(1).select(F.posexplode(F.split(F.lit(names_list), ",")).alias("_p", "_n"))
    return listed.select(F.trim("_n").alias("field_name"), (F.col("_p") + 1).alias("ordinal_position"))


def name_type(name: Column) -> Column:
    """Type of a column as far as its name shows."""
    return F.when(name.rlike("^[0-9]+$"), "Number").otherwise("Text")


def text_catalog(df: DataFrame, domain: Column, resource: Column, text: Column) -> DataFrame:
    """Read each text as a table whose columns are its distinct words, in order.  No shuffle."""
    rows = df.select(domain.alias("domain"), resource.alias("resource_id"), F.posexplode(names(text)).alias("_p", "field_name"))
    return rows.select(*TABLE, "field_name", name_type(F.col("field_name")).alias("data_type"),
                       (F.col("_p") + 1).alias("ordinal_position"))


def merge_catalog(rows: DataFrame) -> DataFrame:
    """One row per table and name, at its first position."""
    return (rows.groupBy(*TABLE, "field_name").agg(F.min("data_type").alias("data_type"),
                                                   F.min("ordinal_position").alias("ordinal_position")))


def target_tables(columns: DataFrame, low: int, high: int, per_domain: int, sampled: bool = False,
                  seed: int = 0) -> DataFrame:
    """Tables with ``low`` to ``high`` columns, the widest or a sample per domain."""
    sizes = columns.groupBy(*TABLE).agg(
        F.count("*").alias("n_cols"),
        F.count_if(F.col("data_type") == "Number").alias("n_numeric"),
        F.count_if(F.col("data_type") == "Text").alias("n_text")).where(F.col("n_cols").between(low, high))
    order = [draw(["resource_id"], seed)] if sampled else [F.desc("n_cols")]
    return top_per_group(sizes, ["domain"], [*order, F.col("resource_id")], per_domain, rank="rn")


def of_tables(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """The columns of the tables listed."""
    return columns.join(tables.select(*TABLE).distinct(), TABLE, "left_semi")


# Source column type -> medium type: fixed values.
MEDIUM_TYPES = {
    "Text": "string", "Number": "number", "Date": "date", "Calendar date": "date", "Checkbox": "boolean",
    "Point": "geo", "Location": "geo", "MultiPolygon": "geo", "Polygon": "geo", "MultiLine": "geo",
    "Line": "geo", "MultiPoint": "geo", "URL": "url", "Email": "string", "Phone": "string",
    "Money": "number", "Percent": "number",
}


def medium_type(data_type: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MEDIUM_TYPES.items() for x in pair])
    return F.coalesce(F.element_at(known, data_type), F.lit("other"))


def type_mix(columns: DataFrame, group: list[str]) -> DataFrame:
    """Columns per medium type and group."""
    kinds = ["string", "number", "date", "geo", "boolean", "url", "other"]
    typed = columns.withColumn("_m", medium_type(F.col("data_type")))
    return typed.groupBy(*group).agg(
        F.count("*").alias("n_cols"), *[F.count_if(F.col("_m") == k).alias(f"n_{k}") for k in kinds])


def column_text(domain: Column, table: Column, field: Column, description: Column) -> Column:
    """``domain.table.field (description)``."""
    note = F.when(description.isNotNull() & (description != ""), F.concat(F.lit(" ("), description, F.lit(")")))
    return F.concat(domain, F.lit("."), table, F.lit("."), field, F.coalesce(note, F.lit("")))


def table_text(columns: DataFrame, title: Column, group: list[str] | None = None) -> DataFrame:
    """``title: field (type), field (type), …`` in column order, per table.

    A table's columns meet in one row; that is as long as the text asked for.
    """
    field = F.concat("field_name", F.lit(" ("), "data_type", F.lit(")"))
    joined = joined_list(field, [F.col("ordinal_position"), F.col("field_name")])
    return columns.groupBy(*(group or TABLE)).agg(joined.alias("_f")).withColumn(
        "table_text", F.concat(title, F.lit(": "), "_f")).drop("_f")


def taxonomy_text(category: Column, gloss: Column) -> Column:
    return F.concat(category, F.lit(": "), F.coalesce(gloss, F.lit("")))


def path_texts(paths: DataFrame, levels: list[str], content: str) -> DataFrame:
    """One text per node of a path hierarchy: (level, path, text).

    A node's text is its dotted path; a node of the lowest level adds its ``content``.  A NULL
    name is an empty step, so that what is below stays where it is.
    """
    out = None
    for i in range(1, len(levels) + 1):
        path = F.concat_ws(".", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in levels[:i]])
        text = path if i < len(levels) else F.concat(path, F.lit(": "), F.col(content))
        nodes = paths.select(F.lit(levels[i - 1]).alias("level"), path.alias("path"), text.alias("text"))
        nodes = nodes.distinct() if i < len(levels) else nodes
        out = nodes if out is None else out.unionByName(nodes)
    return out


def drift(counts: DataFrame, key: list[str], snapshot: str, item: str, n: str) -> DataFrame:
    """Cosine of each key's counts per item to those of its previous snapshot, however long ago that was.

    ``counts`` holds (key, snapshot, item, n).  A key's first snapshot has no row.  Returns key, snapshot, sim.
    """
    norms = counts.groupBy(*key, snapshot).agg(F.sqrt(F.sum(F.col(n) * F.col(n))).alias("_norm"))
    by_time = Window.partitionBy(*key).orderBy(snapshot)
    steps = norms.select(*key, snapshot, "_norm", F.lag(snapshot).over(by_time).alias("_before"),
                         F.lag("_norm").over(by_time).alias("_norm_before")).where(F.col("_before").isNotNull())
    then = counts.select(*key, F.col(snapshot).alias("_before"), item, F.col(n).alias("_then"))
    shared = F.sum(F.col(n) * F.coalesce("_then", F.lit(0)))
    dots = (counts.join(steps, [*key, snapshot]).join(then, [*key, "_before", item], "left")
            .groupBy(*key, snapshot, "_norm", "_norm_before").agg(shared.alias("_dot")))
    return dots.select(*key, snapshot, F.round(F.col("_dot") / (F.col("_norm") * F.col("_norm_before")), 6).alias("sim"))


PARTNERS = 256  # sets that a set may meet by its keys; where it would meet more, sets meet in blocks
DRAWN = 2_000  # sets that tell how many that is
SET_BLOCKS = 32
LISTED = 16_000_000  # topics listed in one block
TILE_SETS = 2_048


def topic_overlap(topics: DataFrame, table: str, topic: str, min_ratio: float) -> DataFrame:
    """Pairs of tables whose topics overlap: shared / either is at least ``min_ratio``.

    Tables with the same topics are one entry, named by the smallest table, with their
    number.  Two sets at the ratio differ in few topics; with topics dealt by hash into one part more than
    these, they agree on a whole part.  Parts are the keys that sets meet by, and their number follows from
    the sizes of the two, told by classes: partners are of one class or of neighbouring ones.  Where topics are few and
    sets large, unlike sets agree on parts too; if that is common among sets drawn, sets are laid out by size and meet in
    blocks of them instead.  No pair is missed, and each is compared in full where it meets.  Returns table_a, table_b,
    tables_a, tables_b, n_a, n_b, n_shared, ratio (Jaccard).
    """
    rows = topics.select(F.col(table).alias("_t"), F.col(topic).alias("_w")).distinct()
    rows = keep(rows)
    freq = cut_lineage(rows.select("_w").distinct().withColumn("_i", F.monotonically_increasing_id()))
    sets = join_groups(rows, freq, ["_w"]).groupBy("_t").agg(F.array_sort(F.collect_list("_i")).alias("_s"))
    sets = sets.groupBy("_s").agg(F.min("_t").alias("_t"), F.count("*").alias("_n"))
    sets = keep(sets.select("_t", "_n", "_s", F.size("_s").alias("_k")))
    least = min_ratio - 5e-7  # ratios are rounded to six places
    sizes = sorted(sets.groupBy("_k").agg(F.count("*").alias("n")).collect())
    total = sum(r["n"] for r in sizes)
    keyed = _part_keys(sets, least, sizes[-1]["_k"] if sizes else 0)
    drawn = sets.where(F.pmod(F.xxhash64("_s"), F.lit(total)) < DRAWN) if total > DRAWN else sets
    shared = _part_keys(drawn, least, sizes[-1]["_k"] if sizes else 0).groupBy("_key").agg(F.count("*").alias("n"))
    met = shared.agg(F.sum(F.col("n") * (F.col("n") - 1))).first()[0] or 0
    # partners of one that is drawn, times what each of them stands for
    if met / max(min(total, DRAWN), 1) * max(total / DRAWN, 1) > PARTNERS:
        near = _near_in_blocks(sets, least, sizes)
    else:
        side = lambda x: keyed.select("_key", *[F.col(c).alias(f"{x}{c}") for c in ("_t", "_n", "_s", "_k")])
        # a set becomes many rows that the planner does not count: no side may be broadcast
        near = side("a").hint("merge").join(side("b").hint("merge"), "_key").where(
            (F.col("a_t") < F.col("b_t")) & (F.least("a_k", "b_k") >= F.greatest("a_k", "b_k") * least))
        near = near.withColumn("n_shared", F.size(F.array_intersect("a_s", "b_s")))
    ratio = F.round(F.col("n_shared") / (F.col("a_k") + F.col("b_k") - F.col("n_shared")), 6)
    found = near.withColumn("ratio", ratio).where(F.col("ratio") >= min_ratio).select(
        F.col("a_t").alias("table_a"), F.col("b_t").alias("table_b"), F.col("a_n").alias("tables_a"),
        F.col("b_n").alias("tables_b"), F.col("a_k").alias("n_a"), F.col("b_k").alias("n_b"), "n_shared", "ratio")
    return found.distinct()


def _part_keys(sets: DataFrame, least: float, widest: int) -> DataFrame:
    """Sets (_s, of size _k) once per key: what they hold of each part, in each meeting."""
    bounds = [1, int(1 / least) + 1]  # smallest size of each class, and of the one after
    while bounds[-1] <= widest:
        bounds.append(int(bounds[-1] / least) + 1)
    bounds.append(int(bounds[-1] / least) + 1)
    # meetings 2c (within class c) and 2c + 1 (of c with c + 1): the parts of topics that the largest sets there need
    largest = [b - 1 for b in bounds[1:]]
    parts = [int((1 - least) / (1 + least) * (largest[i // 2] + largest[(i + 1) // 2]) + 1e-6) + 1 for i in range(2 * len(largest) - 1)]
    listed = lambda xs: F.array(*[F.lit(x) for x in xs])
    classed = sets.withColumn("_c", F.size(F.filter(listed(bounds), lambda b: b <= F.col("_k"))) - 1)
    meetings = F.filter(F.array(F.col("_c") * 2 - 1, F.col("_c") * 2, F.col("_c") * 2 + 1), lambda m: m >= 0)
    met = classed.withColumn("_m", F.explode(meetings)).withColumn("_p", F.get(listed(parts), F.col("_m")))
    met = met.withColumn("_j", F.explode(F.expr("sequence(0, _p - 1)")))
    return met.withColumn("_key", F.expr("xxhash64(_m, _j, filter(_s, w -> pmod(xxhash64(w), _p) = _j))"))


def _shared(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], part: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in a, place in b, topics shared) of pairs that share ``part`` of their topics, summed up, or more.

    A side is (sizes, starts, topics): sets one after another.  Topics are folded into columns; with one topic a column, products of 0/1 rows are
    what sets share, else at most so much is missed as the set with fewer topics folded together lost, and pairs left are counted out.
    """
    of = lambda s: (np.repeat(np.arange(len(s[0])), s[0]), s[2])
    (row_a, top_a), (row_b, top_b) = of(a), of(b)
    known, codes = np.unique(np.concatenate([top_a, top_b]), return_inverse=True)
    width = min(len(known), max(1_024, 16 * int(max(a[0].max(), b[0].max()))), 65_536)
    code_a, code_b = codes[:len(top_a)], codes[len(top_a):]
    tile = max(64, min(TILE_SETS, LISTED // width))

    def tiles(k, starts, rows, code):
        for s in range(0, len(k), tile):
            end = min(s + tile, len(k))
            lo, hi = starts[s], starts[end - 1] + k[end - 1]
            m = np.zeros((end - s, width), np.float32)
            m[rows[lo:hi] - s, code[lo:hi] % width] = 1
            yield s, m, k[s:end].astype(np.float32), k[s:end] - m.sum(axis=1)

    found = []
    for s, x, k_x, lost_x in tiles(a[0], a[1], row_a, code_a):
        for e, y, k_y, lost_y in tiles(b[0], b[1], row_b, code_b):
            apart = max(k_y.min() * part - k_x.max() * (1 - part), k_x.min() * part - k_y.max() * (1 - part))
            if apart > 1e-2 * k_y.max() or a is b and e < s:
                continue
            most = x @ y.T
            if len(known) > width:
                most += np.minimum(lost_x[:, None], lost_y[None, :])
            i, j = np.nonzero(most >= (k_x[:, None] + k_y[None, :]) * np.float32(part * (1 - 1e-6)) - np.float32(1e-2))
            n = most[i, j].astype(np.int64)
            if len(known) > width:
                n = _counted(i + s, j + e, a[0], a[1], code_a, row_b * len(known) + code_b, len(known))
            found.append((i + s, j + e, n))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip((none, none, none), *found))


def _counted(i: np.ndarray, j: np.ndarray, k: np.ndarray, starts: np.ndarray, code: np.ndarray, there: np.ndarray, width: int) -> np.ndarray:
    """How many topics of each set i are among those of set j, listed in ``there`` as j * width + topic."""
    out, there = np.zeros(len(i), np.int64), np.sort(there)
    for s in range(0, len(i), 10_000):
        n = k[i[s:s + 10_000]]
        pair = np.repeat(np.arange(len(n)), n)
        at = np.repeat(starts[i[s:s + 10_000]] - np.cumsum(n) + n, n) + np.arange(len(pair))
        asked = j[s:s + 10_000][pair] * width + code[at]
        spot = np.minimum(np.searchsorted(there, asked), len(there) - 1)
        out[s:s + 10_000] = np.bincount(pair, there[spot] == asked, len(n))
    return out


def _near_in_blocks(sets: DataFrame, least: float, sizes: list) -> DataFrame:
    """Pairs of sets near the ratio, with what they share: the columns a_ and b_ of both, n_shared.

    Sets lie in order of their size, cut into about ``SET_BLOCKS`` blocks; blocks whose sizes are too unlike never meet.
    """
    total, topics = sum(r["n"] for r in sizes), sum(r["n"] * r["_k"] for r in sizes)
    rows = max(TILE_SETS, min(-(-total // SET_BLOCKS), int(LISTED * total / topics) + 1))
    n_blocks = -(-total // rows)
    low, high, first, at = [0] * n_blocks, [0] * n_blocks, {}, 0
    for r in sizes:
        first[r["_k"]] = (at, r["n"])
        for b in range(at // rows, (at + r["n"] - 1) // rows + 1):
            low[b], high[b] = low[b] or r["_k"], r["_k"]
        at += r["n"]
    place = sets.sparkSession.createDataFrame([(k, a, n) for k, (a, n) in first.items()], "_k int, _first long, _of long")
    meets = [[o for o in range(n_blocks) if high[min(b, o)] >= low[max(b, o)] * least] for b in range(n_blocks)]
    partners = sets.sparkSession.createDataFrame([(b, m) for b, m in enumerate(meets)], "_b long, _with array<long>")
    kind = sets.schema["_t"].dataType.simpleString()
    laid = (sets.where(F.col("_t").isNotNull()).join(F.broadcast(place), "_k")
            .withColumn("_b", F.expr(f"(_first + pmod(xxhash64(_s), _of)) div {rows}")).join(F.broadcast(partners), "_b"))
    sent = laid.select("_b", F.explode("_with").alias("_o"), "_t", "_n", "_k", "_s").select(
        F.least("_b", "_o").alias("_lo"), F.greatest("_b", "_o").alias("_hi"), "_b", "_t", "_n", "_k", "_s")
    part = least / (1 + least)

    def task(t: pa.Table) -> pa.Table:
        lo, hi = t.column("_lo")[0].as_py(), t.column("_hi")[0].as_py()
        t = t.sort_by("_k")
        mine = t.column("_b").to_numpy() == lo
        a = t.filter(pa.array(mine))
        b = a if lo == hi else t.filter(pa.array(~mine))

        def side(x: pa.Table) -> tuple[np.ndarray, ...]:
            lists = x.column("_s").combine_chunks()
            k = lists.value_lengths().to_numpy().astype(np.int64)
            return k, np.cumsum(k) - k, lists.flatten().to_numpy()

        i, j, n = _shared(side(a), side(b), part) if a.num_rows and b.num_rows else (np.zeros(0, np.int64),) * 3
        if lo == hi:
            i, j, n = (p[i < j] for p in (i, j, n))
        cols = {f"{x}{c}": s.column(c).combine_chunks().take(pa.array(at)) for x, s, at in (("a", a, i), ("b", b, j)) for c in ("_t", "_n", "_k")}
        return pa.table({**cols, "n_shared": pa.array(n.astype(np.int32), pa.int32())})

    found = sent.groupBy("_lo", "_hi").applyInArrow(task, f"a_t {kind}, a_n long, a_k int, b_t {kind}, b_n long, b_k int, n_shared int")
    pair = [F.struct(*[F.col(f"{x}{c}").alias(c) for c in ("_t", "_n", "_k")]) for x in "ab"]
    both = found.select("n_shared", F.least(*pair).alias("_a"), F.greatest(*pair).alias("_b"))  # the smaller table is a
    return both.select("n_shared", *[F.col(f"_{x}.{c}").alias(f"{x}{c}") for x in "ab" for c in ("_t", "_n", "_k")])


def of_pairs(columns: DataFrame, pairs: DataFrame, table: str) -> DataFrame:
    """The columns of the tables that ``pairs`` names."""
    named = pairs.select(F.explode(F.array("table_a", "table_b")).alias(table)).distinct()
    return columns.join(named, table, "left_semi")


def pair_similarity(pairs: DataFrame, columns: DataFrame, table: str, vec: str = "vec") -> DataFrame:
    """Mean similarity between the columns of the two tables of each pair.

    For unit vectors the mean over all column pairs is the product of the tables' mean
    vectors, so the survivors of a coarse filter cost one product each.  Adds ``col_sim``.
    """
    means = cut_lineage(mean_vector(columns.select(table, unit(F.col(vec)).alias("_u")), [table], "_u", "_m"))
    a = means.select(F.col(table).alias("table_a"), F.col("_m").alias("_a"))
    b = means.select(F.col(table).alias("table_b"), F.col("_m").alias("_b"))
    joined = pairs.join(a, "table_a").join(b, "table_b")
    return joined.withColumn("col_sim", F.round(dot_product(F.col("_a"), F.col("_b")), 6)).drop("_a", "_b")
