"""Misspelt names: the nearest known term within a few edits, by keys that near names share."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.operators.similarity import join_groups
from lexigrid.session import cut_lineage

CUT = 24  # names up to this length meet by their deletions, whose number grows with its power; longer ones by segments
EDITS = 2
# keys are made once per text where texts are in so many groups, or where rows would be sent so many times
GROUPS_PER_TEXT = 8
TIMES_SENT = 16
TEXTS_PER_BLOCK = 50_000
KEYS_AT_ONCE = 2_000_000


def allowed_edits(name: Column, most: int = EDITS) -> Column:
    """Edits a name of that length may be away: none below three characters, one below six, then ``most``."""
    n = F.length(name)
    return F.when(n < 3, 0).when(n < 6, min(1, most)).otherwise(most)


def _less_one(text: Column) -> Column:
    """The text without its first, without its second, ... character."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))),
                      lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1)))
    return F.when(F.length(text) > 0, cut).otherwise(F.expr("cast(array() as array<string>)"))


def deletions(text: Column, edits: int) -> Column:
    """Every string that is left of the text after at most ``edits`` deletions.

    Texts within so many edits of each other share one: each gives up what was replaced or inserted.
    """
    out = layer = F.array(text)
    for _ in range(edits):
        layer = F.array_distinct(F.flatten(F.transform(layer, _less_one)))
        out = F.concat(out, layer)
    return F.array_distinct(out)


def _segment(length: str, edits: int) -> tuple[str, str]:
    """Start (from 0) and width of segment ``i`` of a text cut into ``edits`` + 1."""
    start = f"cast({length} * i div {edits + 1} as int)"
    return start, f"cast({length} * (i + 1) div {edits + 1} as int) - {start}"


def segments(text: str, edits: int) -> Column:
    """Keys of the ``edits`` + 1 segments of a term: so many edits leave one of them whole."""
    start, width = _segment(f"length({text})", edits)
    return F.expr(f"transform(sequence(0, {edits}), i -> xxhash64(length({text}), i, substr({text}, {start} + 1, {width})))")


def segment_probes(text: str, edits: int) -> Column:
    """Keys of every stretch of a name that may be a whole segment of a term within ``edits`` edits."""
    start, width = _segment("l", edits)
    stretch = f"transform(filter(sequence(-{edits}, {edits}), s -> {start} + s >= 0), s -> xxhash64(l, i, substr({text}, {start} + s + 1, {width})))"
    lengths = f"sequence(length({text}) - {edits}, length({text}) + {edits})"
    return F.expr(f"array_distinct(flatten(transform({lengths}, l -> flatten(transform(sequence(0, {edits}), i -> {stretch})))))")


def _keyed(rows: DataFrame, text: str, edits: int, asked: bool) -> DataFrame:
    """Rows once per key.  Terms near the cut get the keys of both kinds, as names on either side may ask for them."""
    reach = 0 if asked else edits
    length = F.length(text)
    short = F.when(length <= CUT + reach, F.transform(deletions(F.col(text), edits), lambda x: F.xxhash64(x)))
    long = F.when(length > CUT - reach, segment_probes(text, edits) if asked else segments(text, edits))
    none = F.expr("cast(array() as array<bigint>)")
    return rows.withColumn("_key", F.explode(F.array_distinct(F.concat(F.coalesce(short, none), F.coalesce(long, none)))))


BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_BACK = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.array(list(itertools.accumulate(range(n), lambda x, _: x * base % (1 << 64), initial=1)), np.uint64)


def _mixed(keys: np.ndarray, salt) -> np.ndarray:
    keys = (keys ^ salt) * np.uint64(0xFF51AFD7ED558CCD)
    return keys ^ (keys >> np.uint64(32))


def _cut_keys(before: np.ndarray, codes: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of what is left of texts of one length after at most ``edits`` deletions.

    A key is a polynomial in the characters, so it is summed up from the stretches between deletions.  Of a run of one character the
    first ones are deleted, as the others leave the same.
    """
    n = codes.shape[1]
    back = _powers(_BACK, edits + 1)
    follows = np.zeros((len(codes), n), bool)
    follows[:, 1:] = codes[:, 1:] == codes[:, :-1]
    for d in range(min(edits, n) + 1):
        for cut in itertools.batched(itertools.combinations(range(n), d), max(1, KEYS_AT_ONCE // len(codes))):
            at = np.array(cut, np.int64).reshape(len(cut), d)
            key, start, kept = np.zeros((len(codes), len(cut)), np.uint64), np.zeros(len(cut), np.int64), np.ones((len(codes), len(cut)), bool)
            for q in range(d):
                key += (before[:, at[:, q]] - before[:, start]) * back[q]
                kept &= ~follows[:, at[:, q]] | ((at[:, q] == start) & bool(q))[None, :]
                start = at[:, q] + 1
            key += (before[:, [n]] - before[:, start]) * back[d]
            row, col = np.nonzero(kept)
            yield row, key[row, col]


def _stretch_keys(before: np.ndarray, edits: int, asked: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of the segments of texts of one length; of names, of every stretch that may be a whole segment."""
    n = before.shape[1] - 1
    back, rows = _powers(_BACK, n + 1), np.arange(len(before))
    for length in range(n - edits, n + edits + 1) if asked else [n]:
        for i in range(edits + 1):
            start, end = length * i // (edits + 1), length * (i + 1) // (edits + 1)
            for s in range(-edits, edits + 1) if asked else [0]:
                if start + s >= 0 and end + s <= n:
                    key = (before[:, end + s] - before[:, start + s]) * back[start + s]
                    yield rows, _mixed(key, np.uint64(length * (edits + 1) + i + 1))


def _text_keys(texts: pa.Array, salts: np.ndarray, edits: int, asked: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, key) of each text, told apart by ``salts``: as ``_keyed`` makes them, but for the hash."""
    reach = 0 if asked else edits
    lengths = pa.compute.utf8_length(texts).to_numpy()
    for n in np.unique(lengths).tolist():
        everyone = np.flatnonzero(lengths == n)
        power = _powers(BASE, n)[:n]
        for part in range(0, len(everyone), 10_000):
            at = everyone[part:part + 10_000]
            flat = "".join(texts.take(pa.array(at)).to_pylist()).encode("utf-32-le", "surrogatepass")
            codes = np.frombuffer(flat, np.uint32).reshape(len(at), n).astype(np.uint64) + np.uint64(1)
            before = np.zeros((len(at), n + 1), np.uint64)
            np.cumsum(codes * power, axis=1, out=before[:, 1:])
            if n <= CUT + reach:
                for row, key in _cut_keys(before, codes, edits):
                    yield at[row], _mixed(key, salts[at[row]])
            if n > CUT - reach:
                for row, key in _stretch_keys(before, edits, asked):
                    yield at[row], _mixed(key, ~salts[at[row]])


def _sharing(names: pa.Array, name_salts: np.ndarray, terms: pa.Array, term_salts: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of a name, place of a term) of the pairs that share a key, each once."""
    made = [*_text_keys(names, name_salts, edits, True)]
    row, key = np.concatenate([r for r, _ in made]), np.concatenate([k for _, k in made])
    order = np.argsort(key)
    row, key = row[order], key[order]
    pairs = [np.zeros(0, np.int64)]
    for t, probe in _text_keys(terms, term_salts, edits, False):
        first, last = np.searchsorted(key, probe), np.searchsorted(key, probe, "right")
        n = last - first
        hit = np.flatnonzero(n)
        n = n[hit]
        at = np.repeat(first[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())
        pairs.append(np.unique(row[at] * len(terms) + np.repeat(t[hit], n)))
        if sum(map(len, pairs[1:])) > max(KEYS_AT_ONCE, 2 * len(pairs[0])):
            pairs = [np.unique(np.concatenate(pairs))]
    found = np.unique(np.concatenate(pairs))
    return found // len(terms), found % len(terms)


def _group_sizes(asked: DataFrame, terms: DataFrame, group: list[str]) -> DataFrame:
    """Groups that names and terms are in, the blocks that either side of them is cut into, and the rows that are sent."""
    n = asked.groupBy(*group).agg(F.count("*").alias("_asked")).join(terms.groupBy(*group).agg(F.count("*").alias("_terms")), group)
    blocks = lambda c: F.ceil(F.col(c) / TEXTS_PER_BLOCK).cast("long")
    return cut_lineage(n.withColumns({"_nb": blocks("_asked"), "_tb": blocks("_terms"), "_sent": F.col("_asked") * blocks("_terms") + F.col("_terms") * blocks("_asked")}))


def _near_in_groups(asked: DataFrame, terms: DataFrame, sizes: DataFrame, group: list[str], sent: int, edits: int) -> DataFrame:
    """Every (group, _name, _term) of one group that is ``edits`` apart.

    Names and terms are sent to where their group meets, and keys are made there.  Small groups share tasks, told apart by a hash
    in the keys; a large one is cut into blocks, each of names meeting each of terms.
    """
    slots = max(1, sent // TEXTS_PER_BLOCK, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salt = F.xxhash64(*group)
    per_group = sizes.select(*group, salt.alias("_salt"), "_nb", "_tb").withColumn(
        "_slot", F.when(F.col("_nb") * F.col("_tb") == 1, F.pmod("_salt", F.lit(slots))).otherwise(F.col("_salt")))
    placed = lambda df, text, own, other, mine, theirs: join_groups(df, per_group, group).select(
        *group, text, "_salt", "_slot", F.expr(f"pmod(xxhash64({text}), {own})").alias(mine), F.explode(F.expr(f"sequence(0L, {other} - 1)")).alias(theirs))
    names = placed(asked, "_name", "_nb", "_tb", "_bn", "_bt")
    held = placed(terms, "_term", "_tb", "_nb", "_bt", "_bn")
    in_b = [f"_in{i}" for i in range(len(group))]
    # both sides stem from one table: give these columns of their own
    held = held.select(*group, "_term", "_salt", "_slot", "_bn", "_bt").toDF(*in_b, "_term", "_salt", "_slot", "_bn", "_bt")
    kinds = [names.schema[g].dataType.simpleString() for g in group]

    def task(a: pa.Table, b: pa.Table) -> pa.Table:
        i = j = np.zeros(0, np.int64)
        if a.num_rows and b.num_rows:
            salts = [t.column("_salt").to_numpy().view(np.uint64) for t in (a, b)]
            texts = [t.column(c).combine_chunks() for t, c in ((a, "_name"), (b, "_term"))]
            i, j = _sharing(texts[0], salts[0], texts[1], salts[1], edits)
        return pa.table({c: t.column(c).combine_chunks().take(pa.array(at)) for t, at, cs in ((a, i, [*group, "_name"]), (b, j, [*in_b, "_term"])) for c in cs})

    by = ["_slot", "_bn", "_bt"]
    out = ", ".join([*[f"`{g}` {k}" for g, k in zip(group, kinds)], "_name string", *[f"{x} {k}" for x, k in zip(in_b, kinds)], "_term string"])
    # texts are short for what is made of them: by their bytes alone they would be dealt to too few tasks
    met = names.repartition(slots, *by).groupBy(*by).cogroup(held.repartition(slots, *by).groupBy(*by)).applyInArrow(task, out)
    for g, x in zip(group, in_b):
        met = met.where(F.col(g) == F.col(x))
    return met.where(F.levenshtein("_name", "_term", edits) == edits).select(*group, "_name", "_term")


def _groups_per_text(known: DataFrame) -> float:
    seen = known.agg(F.count("*").alias("n"), F.approx_count_distinct("_term").alias("texts")).first()
    return seen["n"] / max(seen["texts"], 1)


def nearest_terms(asked: DataFrame, name: str, terms: DataFrame, term: str, group: list[str] | None = None,
                  edits: int = EDITS) -> DataFrame:
    """The known term nearest to each distinct name by edit distance, among the terms of its group.

    Passes go from no edit up to ``edits``, each over the names still open, so that the many keys of a wide pass
    are made for few names; what a pass reads and finds is checkpointed, as plans of passes upon passes grow without end.
    Names and terms of a group meet where keys are made of them, so that texts are sent and no keys.  Without groups, and where most texts are in
    many or where groups are so large that texts would be sent many times, keys are made once per text and travel with a number instead of the text, and
    groups are looked up for the pairs that are near.  Keys only propose: ``levenshtein`` decides, and no pair within reach is missed.  Returns group, name,
    term (of several equally near the smallest), distance and n_terms, how many were that near.  Names that nothing is near
    to within ``allowed_edits``, null names and names in a null group have no row; repeated rows count once.
    """
    group = group or []
    tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = lambda df: df.repartition(tasks)
    open_names = cut_lineage(asked.select(*group, F.col(name).alias("_name")).where(F.col("_name").isNotNull()).distinct())
    known = cut_lineage(terms.select(*group, F.col(term).alias("_term")).where(F.col("_term").isNotNull()).distinct())
    same = open_names.join(known.withColumn("_name", F.col("_term")), [*group, "_name"])
    found = cut_lineage(same.select(*group, "_name", "_term", F.lit(0).alias("distance"), F.lit(1).cast("long").alias("n_terms")))
    out = found
    number = lambda df, text, no: cut_lineage(df.select(text).distinct().withColumn(no, F.monotonically_increasing_id()))
    in_groups = bool(group) and _groups_per_text(known) <= GROUPS_PER_TEXT
    numbered = None
    nearest = lambda near, e: near.groupBy(*group, "_name").agg(
        F.min("_term").alias("_term"), F.lit(e).alias("distance"), F.count("*").alias("n_terms"))
    for e in range(1, edits + 1):
        open_names = cut_lineage(open_names.join(found, [*group, "_name"], "left_anti"))
        # short rows that grow into many keys: by their bytes alone they would be dealt to too few tasks
        wanting = open_names.where(allowed_edits(F.col("_name"), edits) >= e)
        held = known.join(wanting.select(*group).distinct(), group, "left_semi") if group else known
        if in_groups:
            sizes = _group_sizes(wanting, held, group)
            rows, sent = sizes.agg(F.sum(F.col("_asked") + F.col("_terms")), F.sum("_sent")).first()
            if (sent or 0) <= TIMES_SENT * (rows or 0):
                near = _near_in_groups(wanting, held, sizes, group, sent or 0, e)
                found = cut_lineage(nearest(near, e))
                out = out.unionByName(found)
                continue
        names, texts = numbered = numbered or (number(open_names, "_name", "_n"), number(known, "_term", "_t"))
        asking = names.join(wanting.select("_name").distinct(), "_name", "left_semi")
        asked_for = texts.join(held.select("_term").distinct(), "_term", "left_semi") if group else texts
        # the planner takes a side for as small as its texts; its keys are many times that and must not be broadcast
        met = (_keyed(spread(asking), "_name", e, True).select("_key", "_n").hint("merge")
               .join(_keyed(spread(asked_for), "_term", e, False).select("_key", "_t").hint("merge"), "_key").select("_n", "_t").distinct())
        near = met.join(names, "_n").join(texts, "_t").where(F.levenshtein("_name", "_term", e) == e).select("_name", "_term")
        if group:
            near = near.join(wanting, "_name").join(held, [*group, "_term"])
        found = cut_lineage(nearest(near, e))
        out = out.unionByName(found)
    return out.select(*group, F.col("_name").alias(name), F.col("_term").alias("term"), "distance", "n_terms")
