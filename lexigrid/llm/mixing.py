"""Mixing documents to target weights by iterative proportional fitting, in DataFrame functions only.

Token weights are kept per cell of source, language and topic.  Each round scales the cells to the target weights of
one margin after the other, and no cell is drawn from more than once: its weight is its tokens times its scale, held at
its tokens.  The scales go on beyond 1, so that what settles is the one fit that is nearest to the tokens at hand among
all that meet the margins.  What a value has too few tokens for is wanted of the others.  A cell's weight over its
tokens is the probability with which each of its documents is drawn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.llm.common import free_name, lookup, small, stored, words
from lexigrid.session import cut_lineage

# topics by the first pattern that a text shows; texts without any are of the last topic
TOPIC_RULES = [
    ("legal", "[Ll]icen[cs]ed? under|[Aa]ll rights reserved|Copyright|under the [A-Z][A-Za-z]+ License"),
    ("tabular", "\\|[^|\\n]{0,80}\\|[^|\\n]{0,80}\\|"),
    ("contact", "[A-Za-z0-9]@[A-Za-z0-9]|\\+[0-9][0-9 ()-]{7,}"),
    ("web", "https?://|www[.]"),
]
OTHER_TOPIC = "general"
MARGINS = ("source", "lang", "topic")
# a target share grows as the present share to this power: 1 keeps the share, 0 makes all equal
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
FRACTION = 0.5   # of all tokens that the sample is to have
ROUNDS = 4         # between two looks at the change, where all cells fit into one task
MOST_ROUNDS = 200  # margins that contradict each other never settle; most others take 10 to 40 rounds
TOLERANCE = 1e-12  # largest change of a probability in the last round
LARGEST = 1e100    # scale, where margins contradict each other
SEED = "mix"
_DIGITS = 9


def topic_of(text: Column) -> Column:
    out = F.lit(OTHER_TOPIC)
    for name, pattern in reversed(TOPIC_RULES):
        out = F.when(F.coalesce(text, F.lit("")).rlike(pattern), name).otherwise(out)
    return out


def describe(docs: DataFrame, key: Column, text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """doc_id, the three margin values ('' for null) and n_tokens (words) of every row."""
    return docs.select(key.alias("doc_id"), *_margin_values(text, source, lang),
                       F.size(words(F.col(text))).cast("long").alias("n_tokens"))


def _margin_values(text: str, source: str, lang: str) -> list[Column]:
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return [plain(source).alias("source"), plain(lang).alias("lang"), topic_of(F.col(text)).alias("topic")]


def cells_of(described: DataFrame) -> DataFrame:
    """Tokens per cell; documents without tokens belong to none."""
    return described.where("n_tokens > 0").groupBy(*MARGINS).agg(F.sum("n_tokens").cast("double").alias("tokens"))


def tempered_targets(cells: DataFrame, temper: dict[str, float], fraction: float) -> dict[str, DataFrame]:
    """Per margin (value, target): tokens wanted of each value, together ``fraction`` of all tokens.

    No value is to give more tokens than it has; the others make up for it in the proportion of their own targets.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    out = {}
    for margin, power in temper.items():
        lifted = stored(cells.groupBy(margin).agg(F.sum("tokens").alias("_has"), F.pow(F.sum("tokens") / total, F.lit(power)).alias("_lift")))
        # The level at which the values give ``wanted`` together: each step takes those that run out below the last one
        # as giving all that they have.  Levels only rise, so that no value is taken back, and few steps do.
        wanted, level, before = total * fraction, 0.0, -1.0
        while level != before:
            gone = F.col("_has") <= F.lit(level) * F.col("_lift")
            sums = lifted.agg(F.sum(F.when(gone, F.col("_has")).otherwise(0.0)).alias("gone"),
                              F.sum(F.when(gone, 0.0).otherwise(F.col("_lift"))).alias("lift")).first()
            before, level = level, max(level, (wanted - sums["gone"]) / sums["lift"]) if sums["lift"] else float("inf")
        out[margin] = lifted.select(margin, F.least(F.col("_has"), F.lit(level) * F.col("_lift")).alias("target"))
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int | None = None) -> DataFrame:
    """The cells with their fitted ``weight``, at most their tokens.

    ``targets`` has (margin, target) for each margin; a value without a target gets weight 0.  Without ``rounds`` they
    go on until no weight changes by TOLERANCE of its cell's tokens, or for MOST_ROUNDS.  Margins agree with their
    targets as far as the tokens at hand allow; where they contradict each other, the last one counts.
    """
    out = cells.withColumns({"scale": F.lit(1.0), "_change": F.lit(1.0)})
    for margin, target in targets.items():
        out = lookup(out, target.withColumnRenamed("target", f"_want_{margin}"), [margin], row_bytes=256)
    out = stored(out, "raked")
    one_task = small(out, 256)
    done, most = 0, rounds or MOST_ROUNDS
    while done < most:
        if one_task:   # few cells: several rounds in one task, without a shuffle
            steps = min(ROUNDS, most - done)
            out = out.coalesce(1)
            for _ in range(steps):
                out = _round(out, list(targets))
        else:          # sums by margin value are added up before they are shuffled
            steps = 1
            out = out.withColumn("_before", F.col("scale"))
            for margin in targets:
                sums = out.groupBy(margin).agg(*[c.alias(n) for n, c in _sums().items()])
                out = stored(_scaled(lookup(out, sums, [margin], row_bytes=256), margin), "raked")
            out = _changed(out)
        out, done = stored(out, "raked"), done + steps
        if rounds is None and (out.agg(F.max("_change")).first()[0] or 0.0) < TOLERANCE:
            break
    return out.select(*cells.columns, (F.col("tokens") * F.least(F.col("scale"), F.lit(1.0))).alias("weight"))


def _sums() -> dict[str, Column]:
    """Tokens of a margin value's cells that give all they have, and weight of the others."""
    whole = F.col("scale") >= 1
    return {"_whole": F.sum(F.when(whole, F.col("tokens")).otherwise(0.0)), "_part": F.sum(F.when(whole, 0.0).otherwise(F.col("tokens") * F.col("scale")))}


def _scaled(cells: DataFrame, margin: str) -> DataFrame:
    """Scales the cells that don't yet give all, so that the margin value reaches its target; all, if that isn't enough."""
    want, sums = F.coalesce(f"_want_{margin}", F.lit(0.0)), F.col("_whole") + F.col("_part")
    factor = (F.when((F.col("_part") > 0) & (want > F.col("_whole")), (want - F.col("_whole")) / F.col("_part"))
              .when(sums > 0, want / sums).otherwise(0.0))
    return cells.withColumn("scale", F.least(F.col("scale") * factor, F.lit(LARGEST))).drop("_whole", "_part")


def _changed(cells: DataFrame) -> DataFrame:
    held = lambda c: F.least(F.col(c), F.lit(1.0))
    return cells.withColumn("_change", F.abs(held("scale") - held("_before"))).drop("_before")


def _round(cells: DataFrame, margins: list[str]) -> DataFrame:
    out = cells.withColumn("_before", F.col("scale"))
    for margin in margins:
        out = _scaled(out.withColumns({n: c.over(Window.partitionBy(margin)) for n, c in _sums().items()}), margin)
    return _changed(out)


def probabilities(cells: DataFrame, temper: dict[str, float] | None = None, fraction: float = FRACTION,
                  rounds: int | None = None) -> DataFrame:
    """Per cell its margin values and the probability of its documents."""
    cells = stored(cells, "cells")
    fitted = rake(cells, tempered_targets(cells, temper or TEMPER, fraction), rounds)
    return fitted.select(*MARGINS, F.round(F.col("weight") / F.col("tokens"), _DIGITS).alias("probability"))


def draw(key: Column, seed: str = SEED) -> Column:
    """A number from 0 to 1 that depends on the key alone, so that a lost task draws again alike."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
        temper: dict[str, float] | None = None, fraction: float = FRACTION, rounds: int | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability and selected of every row.

    Null sources and languages count as ''.  Null and empty texts have no tokens, probability 0 and are not drawn.
    Rows with one key share their draw; an empty table gives no rows; other columns are not read.
    """
    rows = cut_lineage(describe(docs, F.col(key), text, source, lang))
    chance = probabilities(cells_of(rows), temper, fraction, rounds)
    out = lookup(rows, chance, list(MARGINS), row_bytes=256)
    p = F.when(F.col("n_tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(0.0)
    return out.select("doc_id", *MARGINS, "n_tokens", p.alias("probability"), (draw(F.col("doc_id")) < p).alias("selected"))


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
           temper: dict[str, float] | None = None, fraction: float = FRACTION, rounds: int | None = None) -> DataFrame:
    """The drawn rows with the input's columns; the texts are not shuffled while the cells fit into a broadcast."""
    chance = probabilities(cells_of(describe(docs, F.col(key), text, source, lang)), temper, fraction, rounds)
    names = {m: free_name(docs, f"_mix_{m}") for m in (*MARGINS, "probability")}
    side = chance.select(*[F.col(m).alias(n) for m, n in names.items()])
    values = dict(zip(MARGINS, _margin_values(text, source, lang)))
    marked = docs.withColumns({names[m]: values[m] for m in MARGINS})
    joined = lookup(marked, side, [names[m] for m in MARGINS], row_bytes=256, how="inner")
    has_words = F.col(text).rlike("[^\\x20\\x09-\\x0D]")
    return joined.where(has_words & (draw(F.col(key)) < F.col(names["probability"]))).select(*docs.columns)


def sql(fraction: float = FRACTION) -> str:
    """DuckDB SQL for the rows of ``mix`` over documents, raking until it settles."""
    cases = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in TOPIC_RULES)
    steps = ["d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, "
             f"CASE {cases} ELSE '{OTHER_TOPIC}' END AS topic, "
             "len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens "
             "FROM (SELECT *, coalesce(text, '') AS t FROM documents))",
             "c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d WHERE n_tokens > 0 GROUP BY ALL)"]
    for m in MARGINS:
        # values in the order in which they run out; the level is the highest of those that each stretch would need
        steps.append(f"l_{m} AS (SELECT {m}, sum(tokens) AS has, pow(sum(tokens) / (SELECT sum(tokens) FROM c), {TEMPER[m]}) AS lift FROM c GROUP BY {m})")
        steps.append(f"v_{m} AS (SELECT max((a * {fraction} - gone) / rest) AS level FROM (SELECT (SELECT sum(tokens) FROM c) AS a, coalesce(sum(has) OVER "
                     f"(ORDER BY has / lift, {m} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone, sum(lift) OVER (ORDER BY has / lift, {m} "
                     f"ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM l_{m}))")
        steps.append(f"t_{m} AS MATERIALIZED (SELECT {m}, least(has, level * lift) AS target_{m} FROM l_{m}, v_{m})")
    inner = "(SELECT *, scale AS before FROM it WHERE change >= {t} AND k < {n})".format(t=TOLERANCE, n=MOST_ROUNDS)
    for m in MARGINS:
        sums = (f"(SELECT *, sum(CASE WHEN scale >= 1 THEN tokens ELSE 0 END) OVER (PARTITION BY {m}) AS whole, "
                f"sum(CASE WHEN scale >= 1 THEN 0 ELSE tokens * scale END) OVER (PARTITION BY {m}) AS part FROM {inner})")
        inner = (f"(SELECT * EXCLUDE (whole, part) REPLACE (least({LARGEST!r}, scale * CASE WHEN part > 0 AND target_{m} > whole THEN (target_{m} - whole) / part "
                 f"WHEN whole + part > 0 THEN target_{m} / (whole + part) ELSE 0 END) AS scale) FROM {sums})")
    steps.append(f"""it(k, source, lang, topic, tokens, target_source, target_lang, target_topic, scale, change) AS (
SELECT 0, source, lang, topic, tokens, target_source, target_lang, target_topic, 1.0::DOUBLE, 1.0::DOUBLE
FROM c JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)
UNION ALL SELECT k + 1, source, lang, topic, tokens, target_source, target_lang, target_topic, scale,
max(abs(least(scale, 1) - least(before, 1))) OVER () FROM {inner})""")
    steps.append("fit AS MATERIALIZED (SELECT source, lang, topic, round(least(scale, 1), %d) AS probability FROM it WHERE k = (SELECT max(k) FROM it))" % _DIGITS)
    u = f"('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / {float(1 << 48)!r}"
    return ("WITH RECURSIVE " + ",\n".join(steps) + f"\nSELECT *, {u} < probability AS selected FROM (SELECT doc_id, d.source, d.lang, d.topic, "
            f"n_tokens, CASE WHEN n_tokens > 0 THEN coalesce(probability, 0) ELSE 0 END AS probability "
            f"FROM d LEFT JOIN fit USING (source, lang, topic))")
