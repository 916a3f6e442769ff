"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histograms of character classes and of common words are compared with the mean histograms of its
language by the Jensen-Shannon distance.  Short documents say little about a distribution, so each comparison has
a minimum length below which it decides nothing.  A base rule on length and repeated windows comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import lookup, words
from lexigrid.session import cut_lineage

# Fixed lists: frequent function words of each language; the last bin of a histogram is every other word.
COMMON_WORDS = {
    "en": "the of and to in is was for it on with that be are by at from as this a an or have not".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce avec".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o".split(),
}
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
# lengths from which a histogram is compared, and the distances above which a document is rejected
MIN_CLASS_CHARS = 200
MAX_CLASS_DISTANCE = 0.28
MIN_COMMON_WORDS = 100
MAX_COMMON_DISTANCE = 0.30
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _pairs(hashes: str, apart: int) -> Column:
    """Hashes of two windows ``apart`` words from each other: windows of twice the words."""
    n = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, apart + 1, n), lambda a, b: F.xxhash64(a, b))


def _steps(positions: str) -> Column:
    """How many words the 8-word windows that begin at these sorted positions cover."""
    ahead = F.slice(positions, 2, F.greatest(F.size(positions) - 1, F.lit(0)))
    steps = F.zip_with(positions, ahead, lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0), lambda s, x: s + x)


def measure(docs: DataFrame, text: str, lang: str, keep: dict[str, Column]) -> DataFrame:
    """``keep`` columns, the five base counts, and the two histograms as arrays of counts.

    Arrays that several expressions read stand in a step of their own, so that each is computed once.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    kept = list(keep)
    a = docs.select(*[c.alias(n) for n, c in keep.items()], F.coalesce(F.col(lang), F.lit("")).alias("_lang"),
                    body.alias("_text"), words(F.col(text)).alias("_w"))
    lines = F.filter(F.split("_text", "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))
    listed = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    b = a.select(*kept, "_lang", "_text", F.size("_w").alias("_n"), F.length(F.array_join("_w", "")).alias("_chars"),
                 lines.alias("_lines"),
                 F.filter(F.transform("_w", lambda w: F.lower(w)), lambda w: w.isin(listed)).alias("_common"),
                 F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    length = F.length("_text")
    count = lambda pattern: F.regexp_count("_text", F.lit(pattern))
    c = b.select(*kept, "_lang", "_n", "_chars", "_common",
                 (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("_dup"),
                 count("[#*$%&|<>]").alias("_symbols"), count("\\p{Lu}").alias("_upper"), count("[0-9]").alias("_digit"),
                 count("[.,;:!?'\"()\\[\\]{}/-]").alias("_punct"), length.alias("_length"),
                 (F.octet_length("_text") - length).alias("_wide"), _pairs("_h", 1).alias("_h"))
    d = c.withColumn("_h", _pairs("_h", 2))
    e = d.withColumn("_h", _pairs("_h", 4))
    f = e.withColumn("_again", F.size(F.array_distinct("_h")) < F.size("_h"))
    # only texts with a repeated window sort their windows; equal ones then stand side by side
    g = f.withColumn("_h", F.when(F.col("_again"), F.array_sort(
        F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    both = F.zip_with("_h", F.slice("_h", 2, F.greatest(F.size("_h") - 1, F.lit(0))),
                      lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
    h = g.withColumn("_at", F.when(F.col("_again"), F.array_sort(F.array_distinct(
        F.flatten(F.filter(both, lambda p: p.isNotNull()))))))
    space = F.col("_length") - F.col("_chars")
    classes = [space, F.col("_upper"), F.col("_digit"), F.col("_punct"), F.col("_symbols"), F.col("_wide")]
    lower = F.greatest(F.lit(0), F.col("_length") - space - F.col("_upper") - F.col("_digit") - F.col("_punct") - F.col("_symbols"))
    per_word = F.lit(None).cast("array<double>")
    for name, listed in COMMON_WORDS.items():
        found = F.transform(F.array(*map(F.lit, listed)), lambda t: F.size(F.filter("_common", lambda w: w == t)).cast("double"))
        per_word = F.when(F.col("_lang") == name, found).otherwise(per_word)
    h = h.select(*kept, "_lang", F.col("_n").cast("long").alias("n_words"), F.col("_chars").cast("long").alias("word_chars"),
                 F.col("_symbols").cast("long").alias("n_symbols"), F.col("_dup").cast("long").alias("n_dup_lines"),
                 F.when(F.col("_again"), _steps("_at")).otherwise(0).cast("long").alias("n_repeat_words"),
                 F.array(*[x.cast("double") for x in [lower, *classes]]).alias("_class"), per_word.alias("_found"))
    rest = F.greatest(F.lit(0.0), F.col("n_words") - F.aggregate("_found", F.lit(0.0), lambda s, x: s + x))
    return h.select(*kept, "_lang", *_COUNTS, _share("_class").alias("_class"),
                    _share(F.concat("_found", F.array(rest))).alias("_common"))


def _share(counts: Column | str) -> Column:
    counts = F.col(counts) if isinstance(counts, str) else counts
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.transform(counts, lambda x: x / total))


def divergence(p: str, q: str) -> Column:
    """Jensen-Shannon distance (base 2, from 0 to 1) of two histograms of shares; null if one is missing."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def references(measured: DataFrame) -> DataFrame:
    """Mean histograms of each language over the documents that pass the base rule; each document counts once."""
    sound = measured.where(~F.col("base_failed"))
    widest = max(map(len, COMMON_WORDS.values())) + 1
    mean = lambda name, n: F.array(*[F.avg(F.get(F.col(name), F.lit(i))) for i in range(n)])
    out = sound.groupBy("_lang").agg(mean("_class", 7).alias("_class_ref"), mean("_common", widest).alias("_common_ref"))
    return out.withColumn("_common_ref", F.filter("_common_ref", lambda x: x.isNotNull()))


def _based(docs: DataFrame, text: str, lang: str, keep: dict[str, Column]) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measure(docs, text, lang, keep).withColumn("base_failed", failed)


def _judged(measured: DataFrame, refs: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """``keep`` columns, counts, distances (six places) and verdict of measured rows."""
    joined = lookup(measured, refs, ["_lang"], row_bytes=512)
    chars = F.aggregate("_class", F.lit(0.0), lambda s, x: s + x)  # null where there is no text
    out = joined.select(
        *keep, *_COUNTS, "base_failed",
        F.when(chars.isNotNull() & (F.col("word_chars") >= MIN_CLASS_CHARS), F.round(divergence("_class", "_class_ref"), 6)).alias("class_distance"),
        F.when(F.col("n_words") >= MIN_COMMON_WORDS, F.round(divergence("_common", "_common_ref"), 6)).alias("common_distance"))
    far = ((F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE)
           | (F.coalesce("common_distance", F.lit(0.0)) > MAX_COMMON_DISTANCE))
    return out.withColumn("kept", ~F.col("base_failed") & ~far)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row its key, base counts, base_failed, both distances (null under their guard) and kept.

    Null and empty texts have no words and fail the base rule.  A null language is a language of its own; one
    without a list of common words is judged by its character classes only.  Repeated rows are judged alike; an
    empty table gives no rows; columns of other names are not read.
    """
    keep = {key: F.col(key)}
    measured = cut_lineage(_based(docs, text, lang, keep))  # a few dozen numbers a row
    return _judged(measured, references(measured), keep)


def keep_sound(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that the rules keep, with the input's columns.

    Each row is judged where it is, by references that a first pass has gathered; texts are not shuffled while the
    references fit into a broadcast.
    """
    measured = cut_lineage(_based(docs, text, lang, {}))   # a few dozen numbers a row
    refs = cut_lineage(references(measured))               # a row for each language
    held = {f"_in_{k}": F.col(c) for k, c in enumerate(docs.columns)}
    # a condition that the optimizer can't take apart: it would copy the window counts into filters below each step
    sound = _judged(_based(docs, text, lang, held), refs, held).where(F.greatest((~F.col("kept")).cast("int"), F.lit(0)) == 0)
    return sound.select(*[F.col(h).alias(c) for h, c in zip(held, docs.columns)])


def sql() -> str:
    """DuckDB SQL for the rows of ``judge`` over documents."""
    word, n_ref = "[^\\x20\\x09-\\x0D]", max(map(len, COMMON_WORDS.values())) + 1
    punct = "[.,;:!?\'\'\"()\\[\\]{}/-]"  # the quote doubled for SQL
    count = lambda pattern: f"len(regexp_extract_all(t, '{pattern}'))"
    listed = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in COMMON_WORDS.items()) + " END"
    share = lambda x: f"CASE WHEN list_sum({x}) > 0 THEN list_transform({x}, lambda v: v / list_sum({x})) END"
    part = lambda x, p, q: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
    apart = lambda p, q: (f"round(sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: "  # noqa: E731
                          f"{part(p + '[i]', p + '[i]', q + '[i]')} + {part(q + '[i]', p + '[i]', q + '[i]')})) / 2)), 6)")
    means = lambda x, n: "[" + ", ".join(f"avg({x}[{i}])" for i in range(1, n + 1)) + "]"
    return f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, t, regexp_extract_all(t, '{word}+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
 win AS (SELECT doc_id, i, w[i:i + {WINDOW - 1}] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
 rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM win) WHERE k > 1) GROUP BY doc_id),
 base AS (SELECT doc_id, lang, t, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {count('[#*$%&|<>]')} AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
 shape AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  list_transform({listed}, lambda x: len(list_filter(w, lambda y: lower(y) = x))) AS f,
  [length(t) - word_chars, {count('\\p{Lu}')}, {count('[0-9]')}, {count(punct)}, n_symbols, strlen(t) - length(t)] AS s FROM base),
 shares AS (SELECT * EXCLUDE (f, s), {share("list_prepend(greatest(0, length(t) - list_sum(s[1:5])), s)")} AS c,
  {share("list_append(f, greatest(0, n_words - list_sum(f)))")} AS f FROM shape),
 refs AS (SELECT lang, {means('c', 7)} AS rc, list_filter({means('f', n_ref)}, lambda x: x IS NOT NULL) AS rf FROM shares WHERE NOT base_failed GROUP BY lang),
 far AS (SELECT *, CASE WHEN word_chars >= {MIN_CLASS_CHARS} THEN {apart('c', 'rc')} END AS class_distance,
  CASE WHEN n_words >= {MIN_COMMON_WORDS} THEN {apart('f', 'rf')} END AS common_distance FROM shares LEFT JOIN refs USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, common_distance,
 NOT base_failed AND coalesce(class_distance, 0) <= {MAX_CLASS_DISTANCE} AND coalesce(common_distance, 0) <= {MAX_COMMON_DISTANCE} AS kept FROM far"""
