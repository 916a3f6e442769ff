"""Enumerations as (domain, term) rows, and how much of a probe they contain.

Containment of probe P in domain D is |P and D| / |P|, computed exactly by an equi-join on
the term: only pairs that share a term are ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Enumerations every catalog knows: fixed values.
ENUMERATIONS: list[tuple[str, str, list[str]]] = [
    ("months_long", "month", "january february march april may june july august september october november december".split()),
    ("months_short", "month", "jan feb mar apr may jun jul aug sep oct nov dec".split()),
    ("days_long", "day_of_week", "monday tuesday wednesday thursday friday saturday sunday".split()),
    ("days_short", "day_of_week", "mon tue wed thu fri sat sun".split()),
    ("quarters", "quarter", "q1 q2 q3 q4 quarter1 quarter2 quarter3 quarter4 qtr1 qtr2 qtr3 qtr4".split()),
    ("us_states_long", "us_state", (
        "alabama alaska arizona arkansas california colorado connecticut delaware florida georgia hawaii idaho "
        "illinois indiana iowa kansas kentucky louisiana maine maryland massachusetts michigan minnesota "
        "mississippi missouri montana nebraska nevada new_hampshire new_jersey new_mexico new_york "
        "north_carolina north_dakota ohio oklahoma oregon pennsylvania rhode_island south_carolina "
        "south_dakota tennessee texas utah vermont virginia washington west_virginia wisconsin wyoming").split()),
    ("us_states_abbrev", "us_state", (
        "al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd "
        "oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy").split()),
    ("currencies", "currency", (
        "usd eur gbp jpy cny cad aud chf inr brl krw mxn sgd hkd nzd sek nok dkk zar rub try pln thb idr myr "
        "php czk ils clp cop").split()),
    ("boolean_labels", "boolean", "yes no true false y n t f on off active inactive enabled disabled".split()),
    ("compass", "direction", (
        "north south east west ne nw se sw n s e w northeast northwest southeast southwest").split()),
    ("age_groups", "age_group", (
        "infant toddler child adolescent teen teenager adult senior elderly youth minor juvenile").split()),
    ("gender", "gender", "male female man woman men women boy girl m f other nonbinary unknown".split()),
]


def enumerations(spark: SparkSession) -> DataFrame:
    """The known enumerations as (domain_name, domain_label, term)."""
    rows = [(name, label, term) for name, label, terms in ENUMERATIONS for term in terms]
    return spark.createDataFrame(rows, "domain_name string, domain_label string, term string")


def members(df: DataFrame, domain: str | Column, label: str | Column, term: Column) -> DataFrame:
    """Distinct (domain_name, domain_label, term); empty and NULL terms are dropped."""
    domain = F.lit(domain) if isinstance(domain, str) else domain
    label = F.lit(label) if isinstance(label, str) else label
    rows = df.select(domain.alias("domain_name"), label.alias("domain_label"), term.alias("term"))
    return rows.where(F.length("term") > 0).distinct()


def cardinality(sets: DataFrame) -> DataFrame:
    """Members per domain; ``sets`` holds distinct rows, as :func:`members` makes them."""
    return sets.groupBy("domain_name", "domain_label").agg(F.count("*").alias("n_members"))


STRATEGIES = ("whole", "tokens", "both")


def probe_terms(columns: DataFrame, key: list[str], name: str, strategy: str = "both",
                min_token: int = 1) -> DataFrame:
    """(key, term) of column names: whole, split at ``_``, or the union of both."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}")
    whole = F.lower(F.col(name))
    tokens = F.filter(F.split(whole, "_"), lambda t: F.length(t) >= min_token)
    terms = {"whole": F.array(whole), "tokens": tokens, "both": F.array_union(F.array(whole), tokens)}[strategy]
    return (columns.where(F.col(name).isNotNull()).select(*key, F.explode(terms).alias("term"))
            .where(F.length("term") > 0))


def containment(probes: DataFrame, sets: DataFrame, key: list[str],
                domain: list[str] | None = None) -> DataFrame:
    """Share and number of each probe's terms in each domain it meets.

    ``probes`` holds (key, term), repeats allowed; ``sets`` holds distinct rows.  Returns
    key, domain, containment, n_matches, n_terms.
    """
    domain = domain or ["domain_name", "domain_label"]
    hits = (probes.join(sets.select(*domain, "term"), "term")
            .groupBy(*key, *domain).agg(F.count_distinct("term").alias("n_matches")))
    totals = probes.groupBy(*key).agg(F.count_distinct("term").alias("n_terms"))
    return hits.join(totals, key).select(
        *key, *domain, F.round(F.col("n_matches") / F.col("n_terms"), 6).alias("containment"), "n_matches", "n_terms")


def containment_by_strategy(columns: DataFrame, sets: DataFrame, key: list[str], name: str,
                            min_token: int = 1) -> DataFrame:
    """:func:`containment` under all three strategies, from one shuffle of the terms.

    Returns strategy, key, domain_name, domain_label, containment, n_matches, n_terms.
    """
    whole = F.lower(F.col(name))
    tokens = F.filter(F.split(whole, "_"), lambda t: F.length(t) >= min_token)
    tag = lambda t, w, k: F.struct(t.alias("term"), w.alias("is_name"), k.alias("is_token"))
    # a name of one token is one row for both
    tagged = F.when(F.instr(whole, "_") == 0, F.array(tag(whole, F.lit(True), F.length(whole) >= min_token))).otherwise(
        F.concat(F.array(tag(whole, F.lit(True), F.lit(False))), F.transform(tokens, lambda t: tag(t, F.lit(False), F.lit(True)))))
    rows = columns.where(F.col(name).isNotNull()).select(*key, F.inline(tagged)).where(F.length("term") > 0)
    terms = rows.groupBy(*key, "term").agg(F.bool_or("is_name").alias("_whole"), F.bool_or("is_token").alias("_token"))
    counts = [F.count_if("_whole").alias("whole"), F.count_if("_token").alias("tokens"), F.count("*").alias("both")]
    per = lambda df, out: df.select(*[c for c in df.columns if c not in STRATEGIES], F.explode(F.array(*[
        F.struct(F.lit(s).alias("strategy"), F.col(s).alias(out)) for s in STRATEGIES])).alias("_s")).select("*", "_s.*").drop("_s")
    totals = per(terms.groupBy(*key).agg(*counts), "n_terms")
    domain = ["domain_name", "domain_label"]
    hits = per(terms.join(sets.select(*domain, "term"), "term").groupBy(*key, *domain).agg(*counts), "n_matches")
    return hits.where(F.col("n_matches") > 0).join(totals, [*key, "strategy"]).select(
        "strategy", *key, *domain, F.round(F.col("n_matches") / F.col("n_terms"), 6).alias("containment"),
        "n_matches", "n_terms")


def matches(columns: DataFrame, sets: DataFrame, key: list[str], name: str) -> DataFrame:
    """Columns whose whole lower-case name is a member: key, name, domain_name, domain_label."""
    cols = columns.select(*key, F.lower(F.col(name)).alias(name))
    return (cols.join(sets.withColumnRenamed("term", name), name)
            .select(*key, name, "domain_name", "domain_label").distinct())


def strip_matched(columns: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Columns whose lower-case name is in no enumeration."""
    cols = columns.withColumn(name, F.lower(F.col(name)))
    return cols.join(sets.select(F.col("term").alias(name)).distinct(), name, "left_anti").select(*columns.columns)


def best_level(values: DataFrame, value: str, sets: DataFrame, level_order: list[str],
               normalize=None) -> DataFrame:
    """Each distinct value with the first level (in the order given) that knows it.

    Returns value, best_level, score; a value no level knows has NULL and 0.0.
    """
    norm = normalize or F.lower
    order = F.coalesce(*[F.when(F.col("domain_name") == lv, F.lit(i)) for i, lv in enumerate(level_order)])
    ranked = (sets.withColumn("_o", order).where(F.col("_o").isNotNull())
              .groupBy("term").agg(F.min(F.struct("_o", "domain_name")).alias("_b")))
    terms = values.select(value).distinct().withColumn("term", norm(F.col(value)))
    return terms.join(ranked, "term", "left").select(
        value, F.col("_b.domain_name").alias("best_level"),
        F.when(F.col("_b").isNull(), 0.0).otherwise(1.0).alias("score"))


def insert_if_absent(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``new`` to append: one per key that ``existing`` lacks."""
    return new.dropDuplicates(key).join(existing.select(*key).distinct(), key, "left_anti").select(*new.columns)


def unrecognised(columns: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """How often each name occurs that no enumeration knows."""
    counted = columns.select(F.lower(F.col(name)).alias(name)).groupBy(name).agg(F.count("*").alias("n"))
    return counted.join(sets.select(F.col("term").alias(name)).distinct(), name, "left_anti")


# ---------------------------------------------------------------- compact stored form

# A term is stored as 15 hex digits of its MD5: 60 bits, so that sets of any size keep their counts.
HASH_DIGITS = 15
BUCKET_DIGITS = 2


def position(term: Column) -> Column:
    """A term's place among 2**60."""
    return F.conv(F.substring(F.md5(term), 1, HASH_DIGITS), 16, 10).cast("long")


def packed_store(sets: DataFrame, domain: str = "domain_name") -> DataFrame:
    """(domain, bucket, positions, n_members): sets as sorted positions, in 256 buckets by the first digits.

    Eight bytes a member; two sets are compared bucket by bucket.  A bucket's list is a 256th of one set.
    """
    placed = sets.select(domain, position(F.col("term")).alias("_p")).distinct()
    bucket = F.shiftright("_p", 4 * (HASH_DIGITS - BUCKET_DIGITS)).cast("int")
    return placed.groupBy(domain, bucket.alias("bucket")).agg(F.sort_array(F.collect_list("_p")).alias("positions")) \
        .withColumn("n_members", F.size("positions").cast("long"))


def packed_overlap(probes: DataFrame, stored: DataFrame, probe: str, domain: str = "domain_name") -> DataFrame:
    """Members that a probe's stored set shares with each stored set: probe, domain, n_shared."""
    a = probes.select(F.col(probe), "bucket", F.explode("positions").alias("_p"))
    b = stored.select(F.col(domain), "bucket", F.explode("positions").alias("_p"))
    return a.join(b, ["bucket", "_p"]).groupBy(probe, domain).agg(F.count("*").alias("n_shared"))
