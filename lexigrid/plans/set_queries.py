"""Enumerations: building, probing, stripping, storing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.operators import catalog, places, sets
from lexigrid.plans import checks as c
from lexigrid.plans import tables as t
from lexigrid.plans.registry import query

TABLE = catalog.TABLE
_ENUMS = c.enum_members(sets.ENUMERATIONS)

# table, column, domain label: value lists found in the tables themselves
VALUE_LISTS = [("customer", "c_mktsegment", "segment"), ("part", "p_brand", "brand"), ("part", "p_type", "part_type"),
               ("part", "p_name", "part_name"), ("orders", "o_orderpriority", "priority"),
               ("orders", "o_orderstatus", "status"), ("events", "event_type", "event"),
               ("nation", "n_name", "nation"), ("region", "r_name", "region")]

_VALUE_LISTS = " UNION ALL ".join(
    f"SELECT '{tab}_{col}', '{lab}', lower(strip_accents({col})) FROM {tab}" for tab, col, lab in VALUE_LISTS)


def known_sets(spark, d):
    """Fixed enumerations, value lists of the tables, and the words of each language."""
    out = sets.enumerations(spark)
    from lexigrid.functions.text import normalize_term

    for tab, col, label in VALUE_LISTS:
        out = out.unionByName(sets.members(t.table(spark, d, tab), f"{tab}_{col}", label, normalize_term(F.col(col))))
    return out.unionByName(language_sets(spark, d))


def language_sets(spark, d):
    from lexigrid.functions.text import names

    words = t.documents(spark, d).select("lang", F.explode(names(F.col("text"))).alias("w"))
    return sets.members(words, F.concat(F.lit("words_"), "lang"), F.lit("word"), F.col("w"))


_LANG = f"""lang_sets AS (SELECT DISTINCT 'words_' || lang AS domain_name, 'word' AS domain_label, term FROM
 (SELECT lang, unnest({c.names('text')}) AS term FROM documents))"""


@query(c.with_(_ENUMS, _LANG, f"""allsets AS (SELECT * FROM enums UNION ALL SELECT * FROM lang_sets
 UNION ALL SELECT DISTINCT * FROM ({_VALUE_LISTS}) v(domain_name, domain_label, term) WHERE len(term) > 0)""") + """
SELECT domain_name, domain_label, count(DISTINCT term) AS n_members FROM allsets GROUP BY ALL""")
def enum_build(spark, d):
    return sets.cardinality(known_sets(spark, d))


def _probe_sql(strategy: str) -> str:
    terms = {"whole": "[field_name]", "tokens": "string_split(field_name, '_')",
             "both": "list_concat([field_name], string_split(field_name, '_'))"}[strategy]
    return (f"SELECT DISTINCT '{strategy}' AS strategy, domain, resource_id, term FROM (SELECT domain, resource_id, "
            f"unnest({terms}) AS term FROM doc_cols) WHERE len(term) > 0")


@query(c.with_(_ENUMS, c.DOC_COLS, "probes AS (" + " UNION ALL ".join(_probe_sql(s) for s in sets.STRATEGIES) + ")",
               "total AS (SELECT strategy, domain, resource_id, count(*) AS n_terms FROM probes GROUP BY ALL)") + """
SELECT strategy, domain, resource_id, domain_name, domain_label, round(count(*) / any_value(n_terms), 6) AS containment,
 count(*) AS n_matches, any_value(n_terms) AS n_terms
FROM probes JOIN enums USING (term) JOIN total USING (strategy, domain, resource_id) GROUP BY ALL""")
def enum_containment(spark, d):
    """Share of each table's names in each enumeration, by the three ways to split names."""
    return sets.containment_by_strategy(t.document_columns(spark, d), sets.enumerations(spark), TABLE, "field_name")


@query(c.with_(_ENUMS, c.DOC_COLS, """targets AS (SELECT domain, resource_id, count(*) AS n_cols FROM doc_cols GROUP BY domain, resource_id
  HAVING count(*) BETWEEN 10 AND 100 QUALIFY row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, resource_id) <= 5)""",
               """probes AS (SELECT DISTINCT domain, resource_id, term FROM (SELECT domain, resource_id, field_name AS term FROM doc_cols
  UNION ALL SELECT domain, resource_id, tok FROM (SELECT domain, resource_id, unnest(string_split(field_name, '_')) AS tok FROM doc_cols)
  WHERE len(tok) > 1) WHERE len(term) > 0)""",
               "total AS (SELECT domain, resource_id, count(*) AS n_terms FROM probes GROUP BY ALL)") + """
SELECT domain, resource_id, domain_label, domain_name, n_cols, round(count(*) / any_value(n_terms), 6) AS containment, count(*) AS n_matches
FROM targets JOIN probes USING (domain, resource_id) JOIN enums USING (term) JOIN total USING (domain, resource_id)
GROUP BY domain, resource_id, domain_label, domain_name, n_cols HAVING round(count(*) / any_value(n_terms), 6) > 0.02
ORDER BY containment DESC, domain, resource_id, domain_name LIMIT 30""")
def enum_batch_probe(spark, d):
    """The thirty best (table, enumeration) matches among the widest tables of each domain."""
    cols = t.document_columns(spark, d)
    targets = catalog.target_tables(cols, 10, 100, 5).select(*TABLE, "n_cols")
    probes = sets.probe_terms(catalog.of_tables(cols, targets), TABLE, "field_name", "both", min_token=2)
    found = sets.containment(probes, sets.enumerations(spark), TABLE).where(F.col("containment") > 0.02)
    return (found.join(targets, TABLE).orderBy(F.desc("containment"), *TABLE, "domain_name").limit(30)
            .select(*TABLE, "domain_label", "domain_name", "n_cols", "containment", "n_matches"))


@query(c.with_(_ENUMS, c.DOC_COLS) + """SELECT DISTINCT domain, resource_id, field_name, domain_name, domain_label
FROM doc_cols JOIN enums ON field_name = term""")
def enum_matches(spark, d):
    return sets.matches(t.document_columns(spark, d), sets.enumerations(spark), TABLE, "field_name")


@query(c.with_(_ENUMS, c.CONV_COLS) + """SELECT domain, resource_id, field_name, data_type FROM conv_cols
WHERE field_name NOT IN (SELECT term FROM enums)""")
def enum_remaining(spark, d):
    cols = t.conversation_columns(spark, d).select(*TABLE, "field_name", "data_type")
    return sets.strip_matched(cols, sets.enumerations(spark), "field_name")


@query(c.with_(_ENUMS, c.DOC_COLS) + """SELECT field_name, count(*) AS n FROM doc_cols
WHERE field_name NOT IN (SELECT term FROM enums) GROUP BY field_name""")
def unrecognised_names(spark, d):
    return sets.unrecognised(t.document_columns(spark, d), sets.enumerations(spark), "field_name")


@query(c.with_(_ENUMS, _LANG) + """SELECT domain_name, ('0x' || substr(md5(term), 1, 2))::INT AS bucket, count(DISTINCT term) AS n_bits
FROM (SELECT domain_name, term FROM enums UNION ALL SELECT domain_name, term FROM lang_sets) GROUP BY ALL""")
def set_bitmap_store(spark, d):
    """Sets in their stored form; the check counts the terms themselves."""
    both = sets.enumerations(spark).unionByName(language_sets(spark, d))
    return sets.packed_store(both).select("domain_name", "bucket", F.col("n_members").alias("n_bits"))


@query(c.with_(_ENUMS, _LANG) + """SELECT probe, domain_name, count(*) AS n_shared FROM (SELECT DISTINCT domain_name AS probe, term FROM lang_sets)
JOIN (SELECT DISTINCT domain_name, term FROM enums) USING (term) GROUP BY ALL""")
def bitmap_overlap(spark, d):
    words = sets.packed_store(language_sets(spark, d)).withColumnRenamed("domain_name", "probe")
    return sets.packed_overlap(words, sets.packed_store(sets.enumerations(spark)), "probe")


@query(c.with_(_LANG) + """SELECT DISTINCT term FROM lang_sets
WHERE term NOT IN (SELECT term FROM lang_sets WHERE domain_name = 'words_en')""")
def vocabulary_growth(spark, d):
    """Words of all languages that an English vocabulary would gain."""
    words = language_sets(spark, d)
    english = words.where(F.col("domain_name") == "words_en")
    return sets.insert_if_absent(english, words.select("term"), ["term"])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def insert_if_absent(spark, d):
    """Nations to append to a table that already has those of the richest suppliers."""
    rich = t.table(spark, d, "supplier").where(F.col("s_acctbal") > 9000)
    have = rich.select(F.col("s_nationkey").alias("n_nationkey"))
    return sets.insert_if_absent(have, t.table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])


@query("""WITH terms AS (SELECT 'country' AS lv, 0 AS o, lower(r_name) AS term FROM region UNION ALL SELECT 'country', 0, lower(substr(r_name, 1, 3)) FROM region
  UNION ALL SELECT 'country', 0, r_regionkey::VARCHAR FROM region UNION ALL SELECT 'admin1', 1, lower(n_name) FROM nation
  UNION ALL SELECT 'admin2', 2, lower(c_mktsegment || ' ' || c_nationkey) FROM customer
  UNION ALL SELECT 'city', 3, lower(c_name) FROM customer UNION ALL SELECT 'city', 3, lower(s_name) FROM supplier),
 vals AS (SELECT DISTINCT v FROM (SELECT p_name AS v FROM part UNION ALL SELECT c_name FROM customer UNION ALL SELECT upper(s_name) FROM supplier
  UNION ALL SELECT r_name FROM region UNION ALL SELECT initcap_nation FROM (SELECT 'nation_' || n_nationkey AS initcap_nation FROM nation)
  UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT c_mktsegment || ' ' || c_nationkey FROM customer))
SELECT v AS val, arg_min(lv, o) AS best_level, CASE WHEN arg_min(lv, o) IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score
FROM vals LEFT JOIN terms ON lower(v) = term GROUP BY v""")
def value_levels(spark, d):
    """The level of the gazetteer each value belongs to, if any."""
    cols = [("part", F.col("p_name")), ("customer", F.col("c_name")), ("supplier", F.upper("s_name")),
            ("region", F.col("r_name")), ("nation", F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string"))),
            ("customer", F.col("c_mktsegment")),
            ("customer", F.concat("c_mktsegment", F.lit(" "), F.col("c_nationkey").cast("string")))]
    vals = None
    for tab, col in cols:
        part = t.table(spark, d, tab).select(col.alias("val"))
        vals = part if vals is None else vals.unionByName(part)
    terms = places.level_terms(t.countries(spark, d), t.admin1(spark, d), t.admin2(spark, d), t.cities(spark, d))
    return sets.best_level(vals, "val", terms, places.LEVELS)


@query("""SELECT n_nationkey, n_name AS label, a AS alt_label FROM (SELECT n_nationkey, n_name, unnest(list_distinct(
  [x for x in [r_name, 'N' || n_nationkey, 'land ' || n_nationkey, lower(n_name)] if x IS NOT NULL])) AS a
 FROM nation JOIN region ON n_regionkey = r_regionkey)""")
def members_from_bindings(spark, d):
    """Query results in JSON turned into members with their spellings."""
    from lexigrid.sources.files import members_from_bindings as read

    n, r = t.table(spark, d, "nation"), t.table(spark, d, "region")
    key = F.col("n_nationkey").cast("string")
    cell = lambda v, name: F.struct(v.alias("value")).alias(name)
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.to_json(F.struct(
        cell(F.col("n_name"), "label"), cell(F.concat(F.lit("N"), key), "code"), cell(F.col("r_name"), "symbol"),
        cell(F.concat(F.lit(" land "), key, F.lit(", ,"), F.lower("n_name"), F.lit(" , N"), key), "altLabels"))).alias("b"))
    found = rows.select("n_nationkey", read(F.col("b")).alias("m"))
    return found.select("n_nationkey", F.col("m.label").alias("label"), F.explode("m.alt_labels").alias("alt_label"))
