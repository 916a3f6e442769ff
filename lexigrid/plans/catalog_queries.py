"""Column catalogs: choosing tables, texts, types, and names taken apart."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexigrid.functions.text import names, words
from lexigrid.operators import catalog, encode, factoring, ranking, similarity
from lexigrid.plans import checks as c
from lexigrid.plans import tables as t
from lexigrid.plans.registry import query
from lexigrid.session import shared_folder
from lexigrid.sources import files

TABLE = catalog.TABLE

# columns per table and type first, then a table's types side by side
_SIZES = """kinds AS (SELECT domain, resource_id, data_type, count(*) AS n FROM doc_cols GROUP BY ALL),
 sizes AS (SELECT domain, resource_id, sum(n)::BIGINT AS n_cols, sum(CASE data_type WHEN 'Number' THEN n ELSE 0 END)::BIGINT AS n_numeric,
 sum(CASE data_type WHEN 'Text' THEN n ELSE 0 END)::BIGINT AS n_text FROM kinds GROUP BY domain, resource_id)"""


@query(c.with_(c.DOC_COLS, _SIZES) + """SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n_cols DESC, resource_id) AS rn
FROM sizes WHERE n_cols BETWEEN 30 AND 200 QUALIFY rn <= 3""")
def target_tables(spark, d):
    return catalog.target_tables(t.document_columns(spark, d), 30, 200, 3)


@query(c.with_(c.DOC_COLS, _SIZES) + """SELECT *, row_number() OVER (PARTITION BY domain ORDER BY md5(resource_id || '|7'), resource_id) AS rn
FROM sizes WHERE n_cols BETWEEN 10 AND 60 QUALIFY rn <= 3""")
def sampled_tables(spark, d):
    return catalog.target_tables(t.document_columns(spark, d), 10, 60, 3, sampled=True, seed=7)


@query("""SELECT c_mktsegment, c_custkey, c_name FROM customer
QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || '|0'), c_custkey) <= 5""")
def stratified_sample(spark, d):
    rows = t.table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_name")
    return ranking.stratified_sample(rows, ["c_mktsegment"], ["c_custkey"], 5)


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY md5(o_orderkey || '|0'), o_orderkey LIMIT 500")
def random_sample(spark, d):
    return ranking.sample_rows(t.table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 500)


_DOC_TEXTS = """doc_texts AS (SELECT domain, resource_id, domain || '.' || resource_id || ': ' ||
 string_agg(field_name || ' (' || data_type || ')', ', ' ORDER BY ordinal_position) AS table_text FROM doc_cols GROUP BY domain, resource_id)"""


def _doc_texts(spark, d):
    return catalog.table_text(t.document_columns(spark, d), F.concat_ws(".", "domain", F.col("resource_id").cast("string")))


@query(c.with_(c.DOC_COLS, _DOC_TEXTS) + "SELECT domain, resource_id, length(table_text) AS n_chars, md5(table_text) AS digest FROM doc_texts")
def table_text(spark, d):
    return _doc_texts(spark, d).select(*TABLE, F.length("table_text").alias("n_chars"), F.md5("table_text").alias("digest"))


@query(c.with_(c.CONV_COLS) + """SELECT domain, resource_id, field_name, domain || '.' || resource_id || '.' || field_name ||
 CASE WHEN data_type = 'Number' THEN ' (digits only)' ELSE '' END AS column_text FROM conv_cols""")
def column_text(spark, d):
    cols = t.conversation_columns(spark, d)
    note = F.when(F.col("data_type") == "Number", "digits only").otherwise("")
    return cols.select(*TABLE, "field_name", catalog.column_text(
        F.col("domain"), F.col("resource_id").cast("string"), F.col("field_name"), note).alias("column_text"))


_PATHS = f"""docs AS (SELECT lang, source, doc_id, array_to_string(list_distinct_ordered, ', ') AS content FROM
 (SELECT lang, source, doc_id, list(w ORDER BY p) AS list_distinct_ordered FROM (SELECT lang, source, doc_id, w, min(p) AS p FROM
  (SELECT lang, source, doc_id, unnest(l) AS w, unnest(range(len(l))) AS p FROM (SELECT lang, source, doc_id, {c.names('text')} AS l FROM documents))
  GROUP BY ALL) GROUP BY ALL)),
 paths AS (SELECT DISTINCT 'lang' AS level, lang AS path, lang AS text FROM docs
 UNION ALL SELECT DISTINCT 'source', lang || '.' || source, lang || '.' || source FROM docs
 UNION ALL SELECT 'doc_id', lang || '.' || source || '.' || doc_id, lang || '.' || source || '.' || doc_id || ': ' || content FROM docs)"""


def _paths(spark, d):
    docs = t.documents(spark, d).select("lang", "source", "doc_id", F.array_join(names(F.col("text")), ", ").alias("content"))
    return catalog.path_texts(docs.where(F.length("content") > 0), ["lang", "source", "doc_id"], "content")


@query(c.with_(_PATHS) + "SELECT level, path, md5(text) AS digest FROM paths")
def schema_text(spark, d):
    """Path text of every level: language (server), source (database), document (table)."""
    return _paths(spark, d).select("level", "path", F.md5("text").alias("digest"))


@query(c.with_(_PATHS, c.TAXONOMY, c.encoded("pv", "paths", "path", "text")) + f"""
SELECT path, category AS topic, hypernym AS topic_parent, score AS topic_score FROM (
 SELECT pv.path, x.category, x.hypernym, {c.cosine('pv', 'x')} AS score FROM pv, taxo x)
QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, category) = 1""")
def schema_topics(spark, d):
    """The topic of each node of the path hierarchy."""
    from lexigrid.operators.profile import label_columns

    nodes = encode.encode(_paths(spark, d).select("path", "text"), "text").drop("text")
    return label_columns(nodes, ["path"], taxonomy_vectors(spark, d)).drop("vec")


def taxonomy_vectors(spark, d):
    tax = t.taxonomy(spark, d)
    text = catalog.taxonomy_text(F.col("category"), F.col("gloss"))
    return encode.encode(tax.withColumn("_t", text), "_t").drop("_t", "gloss")


@query(c.with_(c.DOC_COLS, _DOC_TEXTS, c.encoded("tv", "doc_texts", "resource_id", "table_text")) + f"""
SELECT a.resource_id AS key_a, b.resource_id AS key_b, {c.cosine('a', 'b')} AS score FROM tv a JOIN tv b ON a.resource_id < b.resource_id
ORDER BY score DESC, key_a, key_b LIMIT 15""")
def table_similarity(spark, d):
    """The fifteen most similar pairs of tables."""
    vecs = encode.encode(_doc_texts(spark, d), "table_text").select("resource_id", "vec")
    return similarity.top_pairs(vecs, "resource_id", 15)


@query(c.with_(c.DOC_COLS, _DOC_TEXTS, c.encoded("tv", "doc_texts", "resource_id", "table_text"),
               f"""ask AS (SELECT item_id, string_agg(w, ', ' ORDER BY p) AS t FROM (SELECT item_id, w, min(p) AS p FROM (
  SELECT item_id, unnest(l) AS w, unnest(range(len(l))) AS p FROM (SELECT item_id, {c.names('text')} AS l FROM benchmark)) GROUP BY ALL) GROUP BY ALL)""",
               c.encoded("q", "ask", "item_id", "t")) + f"""
SELECT item_id, resource_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, resource_id) AS rank
 FROM (SELECT q.item_id, tv.resource_id, {c.cosine('q', 'tv')} AS score FROM q, tv)) WHERE rank <= 3""")
def table_match(spark, d):
    """The three tables nearest to a list of column names."""
    vecs = encode.encode(_doc_texts(spark, d), "table_text").select("resource_id", "vec")
    asks = t.table(spark, d, "benchmark").select("item_id", F.array_join(names(F.col("text")), ", ").alias("t"))
    return similarity.search(vecs, encode.encode(asks, "t").drop("t"), 3, "item_id", "resource_id")


# pattern -> source column type, first match wins: fixed values
_TYPE_RULES = [(r"^https?://", "URL"), (r"^[^@]+@[^@]+\.[a-z]+", "Email"), (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "Calendar date"),
               (r"^[0-9.]+%$", "Percent"), (r"^\$[0-9]", "Money"), (r"^\+?[0-9]+-[0-9-]+$", "Phone"),
               (r"^[0-9.,]+$", "Number"), (r"^(?:true|false)$", "Checkbox"), (r"^[{}<>|#*=_~-]+$", "Symbol")]
_TYPE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(w, '{p}') THEN '{k}'" for p, k in _TYPE_RULES) + " ELSE 'Text' END"
_MEDIUM_SQL = "CASE k " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in catalog.MEDIUM_TYPES.items()) + " ELSE 'other' END"


@query(f"""WITH w AS (SELECT source, unnest({c.words('text')}) AS w FROM documents), k AS (SELECT source, {_TYPE_SQL} AS k FROM w),
 m AS (SELECT source, {_MEDIUM_SQL} AS m FROM k)
SELECT source, count(*) AS n_cols, """ + ", ".join(
    f"count(*) FILTER (WHERE m = '{k}') AS n_{k}" for k in "string number date geo boolean url other".split()) + " FROM m GROUP BY source")
def type_mix(spark, d):
    """Words per medium type in each source, read from their shape."""
    rows = t.documents(spark, d).select("source", F.explode(words(F.col("text"))).alias("w"))
    kind = F.coalesce(*[F.when(F.col("w").rlike(p), F.lit(k)) for p, k in _TYPE_RULES], F.lit("Text"))
    return catalog.type_mix(rows.withColumn("data_type", kind), ["source"])


@query(" UNION ALL ".join(f"SELECT '{n}' AS what, count(*) AS n FROM {n}" for n in t.TABLES))
def catalog_summary(spark, d):
    out = None
    for name in t.TABLES:
        part = t.table(spark, d, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("""WITH n AS (SELECT user_id, epoch(ts)::BIGINT // 604800 AS week, event_type, count(*) AS n FROM events GROUP BY ALL),
 m AS (SELECT user_id, week, map_from_entries(list((event_type, n))) AS mix, sqrt(sum(n * n)) AS nrm FROM n GROUP BY user_id, week),
 s AS (SELECT *, lag(mix) OVER w AS mix_before, lag(nrm) OVER w AS nrm_before FROM m WINDOW w AS (PARTITION BY user_id ORDER BY week))
SELECT user_id, week, round(list_sum([mix[k] * coalesce(mix_before[k], 0) for k in map_keys(mix)]) / (nrm * nrm_before), 6) AS sim
FROM s WHERE mix_before IS NOT NULL""")
def snapshot_drift(spark, d):
    """How far a user's mix of events moved since the last week that had any."""
    week = F.expr("cast(floor(unix_date(cast(ts as date)) / 7) as bigint)")
    counts = t.table(spark, d, "events").groupBy("user_id", week.alias("week"), "event_type").agg(F.count("*").alias("n"))
    return catalog.drift(counts, ["user_id"], "week", "event_type", "n")


@query("""SELECT doc_id, source, lang FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 5)""")
def grouped_membership(spark, d):
    """Documents of the five largest sources."""
    return catalog.of_top_groups(t.table(spark, d, "documents").select("doc_id", "source", "lang"), ["source"], 5)


@query("""SELECT user_id AS domain, event_type AS field_name, arg_max(event_id, (ts, event_id)) AS version FROM events GROUP BY user_id, event_type""")
def current_columns(spark, d):
    """Every event opens a version of its user's column of that type and closes the one before; the open ones."""
    since = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    end = F.coalesce(F.date_format(F.lead("ts").over(since), "yyyy-MM-dd"), F.lit(catalog.OPEN_END))
    versions = t.table(spark, d, "events").select(F.col("user_id").alias("domain"), F.col("event_type").alias("field_name"),
                                                  F.col("event_id").alias("version"), end.alias("tt_end"))
    return catalog.current(versions).drop("tt_end")


@query("""SELECT 'item_' || item_id AS category, 'group_' || (item_id % 7) AS hypernym, md5(text) AS digest FROM benchmark""")
def taxonomy_document(spark, d):
    """A taxonomy written as one nested JSON document per hypernym, and read again."""
    path = shared_folder(spark, "taxonomy")
    rows = t.taxonomy(spark, d).select(F.struct("category", "hypernym", "gloss").alias("c"))
    documents = rows.groupBy(F.col("c.hypernym").alias("part")).agg(F.collect_list("c").alias("categories"))
    documents.repartition("part").write.partitionBy("part").json(path)  # a file holds one document
    return files.read_taxonomy(spark, path).select("category", "hypernym", F.md5("gloss").alias("digest"))


@query("""SELECT DISTINCT domain_name, term FROM (SELECT 'nations_' || n_regionkey AS domain_name, lower(x) AS term FROM (
 SELECT n_regionkey, unnest([n_name, 'N' || n_nationkey, 'land ' || n_nationkey]) AS x FROM nation))""")
def domain_document(spark, d):
    """Domains with members and other spellings as nested JSON, read again as terms."""
    path = shared_folder(spark, "domains")
    key = F.col("n_nationkey").cast("string")
    other = F.array(F.concat(F.lit("N"), key), F.concat(F.lit("land "), key))
    nation = t.table(spark, d, "nation").select(F.concat(F.lit("nations_"), F.col("n_regionkey").cast("string")).alias("domain_name"),
                                                F.struct(F.col("n_name").alias("label"), other.alias("alt_labels")).alias("m"))
    documents = nation.groupBy("domain_name").agg(F.collect_list("m").alias("members")).select(
        F.col("domain_name").alias("part"), F.array(F.struct("domain_name", "members")).alias("domains"))
    documents.repartition("part").write.partitionBy("part").json(path)  # a file holds one document
    return files.domain_terms(files.read_domains(spark, path)).select("domain_name", "term").distinct()


# ---------------------------------------------------------------- names taken apart

# the names cut at underscores; a year is a part of its own
_YEAR = "'^(?:19|20)[0-9]{2}$'"
_NAMES = f"""rows_ AS (SELECT l_linestatus AS domain, l_returnflag AS resource_id, year(l_shipdate) AS y, lower(p_type) AS t,
  lower(replace(p_brand, '#', '_')) AS brand, replace(p_name, ' ', '_') AS pname FROM lineitem JOIN part ON l_partkey = p_partkey),
 names AS (SELECT DISTINCT domain, resource_id, unnest(['cy_' || y || '_' || t, '_' || y || '_' || (y + 1) || '_change_' || t,
  t || '_' || y || '_total_' || (y + 1), brand, pname]) AS field_name FROM rows_),
 cut AS (SELECT *, string_split(field_name, '_') AS w FROM names),
 dated AS (SELECT *, list_position([regexp_matches(x, {_YEAR}) for x in w], true) AS ix FROM cut),
 tf AS (SELECT *, CASE WHEN ix > 0 THEN w[ix] ELSE '' END AS year_str, CASE WHEN ix > 0
  THEN array_to_string(w[1:ix - 1], '_') || '_YYYY_' || array_to_string(w[ix + 1:], '_') ELSE field_name END AS template FROM dated),
 digits AS (SELECT *, [regexp_matches(x, '^[0-9]{{4}}$') for x in w] AS four FROM cut),
 shaped AS (SELECT *, w[1] = 'cy' AND four[2] AND len(w) >= 3 AS yearly,
  w[1] = '' AND four[2] AND four[3] AND w[4] = 'change' AND len(w) >= 5 AS moved FROM digits)"""


def _names(spark, d):
    return t.measure_names(spark, d)


@query("WITH " + _NAMES + """ SELECT domain, resource_id, replace(template, '_YYYY_', '{year}') AS measure_template, count(*) AS n_year_columns,
 min(year_str::INT) AS from_year, max(year_str::INT) AS to_year, string_agg(DISTINCT year_str, ', ' ORDER BY year_str) AS years
FROM tf WHERE year_str <> '' GROUP BY domain, resource_id, template HAVING count(*) >= 2""")
def year_templates(spark, d):
    return factoring.year_templates(factoring.temporal_factors(_names(spark, d)), TABLE)


@query("WITH " + _NAMES + """, named AS (SELECT domain, resource_id, list(year_str) AS y, list(template) AS m FROM tf WHERE ix > 0 GROUP BY ALL),
 every AS (SELECT domain, resource_id, count(*) AS n FROM names GROUP BY ALL)
SELECT domain, resource_id, coalesce(len(y), 0) AS n_temporal, n - coalesce(len(y), 0) AS n_non_temporal,
 coalesce(len(list_distinct(y)), 0) AS n_distinct_years, coalesce(len(list_distinct(m)), 0) AS n_distinct_measures FROM every LEFT JOIN named USING (domain, resource_id)""")
def temporal_counts(spark, d):
    return factoring.temporal_counts(factoring.temporal_factors(_names(spark, d)), TABLE)


@query("WITH " + _NAMES + """ SELECT domain, resource_id, array_to_string(w[3:], '_') AS measure_name, list_min(list(w[2]::INT)) AS from_year,
 list_max(list(w[2]::INT)) AS to_year, count(*) AS n_years FROM shaped WHERE yearly AND len(w[3:]) > 0 GROUP BY ALL""")
def measure_years(spark, d):
    return factoring.measure_years(factoring.fixed_factors(_names(spark, d)), TABLE)


@query("WITH " + _NAMES + """ SELECT domain, resource_id, array_to_string(w[5:], '_') AS measure_name, array_to_string(w[2:3], ' to ') AS period, field_name
FROM shaped WHERE moved""")
def change_columns(spark, d):
    return factoring.change_columns(factoring.fixed_factors(_names(spark, d)), TABLE)


@query("WITH " + _NAMES + " SELECT domain, resource_id, field_name FROM names ANTI JOIN (SELECT * FROM shaped WHERE yearly OR moved) USING (domain, resource_id, field_name)")
def unmatched_names(spark, d):
    return factoring.unmatched(factoring.fixed_factors(_names(spark, d))).select(*TABLE, "field_name")


@query("WITH " + _NAMES + r""" SELECT domain, resource_id, stem, count(*) AS n_versions, min(n) AS first_version, max(n) AS last_version
FROM (SELECT domain, resource_id, regexp_extract(field_name, '^(.+)_(\d+)$', 1) AS stem,
 try_cast(regexp_extract(field_name, '^(.+)_(\d+)$', 2) AS BIGINT) AS n FROM names) WHERE stem <> '' GROUP BY ALL HAVING count(*) >= 2""")
def suffix_stems(spark, d):
    return factoring.suffix_stems(_names(spark, d), TABLE)


_RECIPE_EDGE = 0.7


_RECIPE_CTES = "WITH RECURSIVE " + _NAMES + ",\n" + ",\n".join([
    "un AS (SELECT DISTINCT field_name FROM names)", c.encoded("ne", "un", "field_name", "field_name"),
    "nv AS (SELECT * FROM names JOIN ne USING (field_name))",
    "types AS (SELECT DISTINCT lower(p_type) AS category, p_type || ' parts' AS hypernym FROM part)",
    "tt AS (SELECT category, category || ': ' AS t FROM types)", c.encoded("te", "tt", "category", "t"),
    f"""edge AS (SELECT a.domain, a.resource_id, a.field_name AS a, b.field_name AS b FROM nv a JOIN nv b
 ON a.domain = b.domain AND a.resource_id = b.resource_id AND a.field_name <> b.field_name WHERE {c.cosine('a', 'b')} >= {_RECIPE_EDGE})""",
    """reach(domain, resource_id, node, seen) AS (SELECT DISTINCT domain, resource_id, a, a FROM edge UNION
 SELECT e.domain, e.resource_id, e.b, r.seen FROM reach r JOIN edge e ON e.domain = r.domain AND e.resource_id = r.resource_id AND e.a = r.node)""",
    "comp AS (SELECT domain, resource_id, node AS field_name, min(seen) AS cluster_id FROM reach GROUP BY ALL)",
    "mem AS (SELECT domain || '|' || resource_id || '|' || cluster_id AS k, vec FROM comp JOIN nv USING (domain, resource_id, field_name))",
    c.centroid("cc", "mem", "k"),
    f"""best AS (SELECT k, category, score FROM (SELECT cc.k, te.category, {c.cosine('cc', 'te')} AS score FROM cc, te)
 QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, category) = 1)""",
    "inst AS (SELECT domain, resource_id, cluster_id, list(field_name ORDER BY field_name) AS ins FROM comp GROUP BY ALL)",
    """piv AS (SELECT domain, resource_id, list(field_name ORDER BY field_name) AS pv FROM names n
 WHERE NOT EXISTS (SELECT 1 FROM comp WHERE comp.domain = n.domain AND comp.resource_id = n.resource_id AND comp.field_name = n.field_name) GROUP BY ALL)"""])


@query(_RECIPE_CTES + """
SELECT domain, resource_id, cluster_id, category, round(score, 4) AS score, '{"category_name":"' || category || '","category_hypernym":"' || hypernym ||
 '","confidence":' || round(score, 4) || ',"instance_columns":["' || array_to_string(ins, '","') || '"],"pivot_columns":[' ||
 CASE WHEN pv IS NULL THEN '' ELSE '"' || array_to_string(pv, '","') || '"' END || '],"suggested_schema":["' ||
 array_to_string(list_sort(list_concat(coalesce(pv, []), [category, 'quantity'])), '","') || '"]}' AS unpivot_recipe
FROM inst JOIN best ON k = domain || '|' || resource_id || '|' || cluster_id JOIN types USING (category) LEFT JOIN piv USING (domain, resource_id)""")
def unpivot_recipe(spark, d):
    """Recipes for the yearly reports; part types serve as the taxonomy."""
    cols = encode.encode(_names(spark, d), "field_name")
    types = t.table(spark, d, "part").select(F.lower("p_type").alias("category"), F.concat("p_type", F.lit(" parts")).alias("hypernym")).distinct()
    text = catalog.taxonomy_text(F.col("category"), F.lit(None).cast("string"))
    taxonomy = encode.encode(types.withColumn("_t", text), "_t").drop("_t")
    return factoring.unpivot_recipe(cols, TABLE, "field_name", taxonomy, _RECIPE_EDGE)


@query("""WITH y AS (SELECT DISTINCT year(l_shipdate) AS year FROM lineitem), k AS (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem),
 s AS (SELECT l_returnflag, l_linestatus, year(l_shipdate) AS year, sum(l_quantity) AS quantity, sum(l_extendedprice) AS price FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, m.measure, year, round(CASE m.measure WHEN 'quantity' THEN quantity ELSE price END, 2) AS value
FROM k CROSS JOIN y CROSS JOIN (VALUES ('quantity'), ('price')) m(measure) LEFT JOIN s USING (l_returnflag, l_linestatus, year)""")
def unpivot_apply(spark, d):
    """A wide report with one column per measure and year, made long again."""
    ids = ["l_returnflag", "l_linestatus"]
    line = t.table(spark, d, "lineitem").select(*ids, F.year("l_shipdate").alias("y"), "l_quantity", "l_extendedprice")
    sums = line.where(F.col("y").isNotNull()).groupBy(*ids, "y").agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("p"))
    # a column for each year there is; more years than a table may have columns are an error, not a cut
    wide = sums.groupBy(*ids).pivot("y").agg(F.sum("q").alias("quantity"), F.sum("p").alias("price"))
    wide = wide.toDF(*ids, *[f"cy_{c}" for c in wide.columns[2:]])
    long = factoring.unpivot_years(wide, ids, wide.columns[2:])
    return long.withColumn("value", F.round("value", 2))


@query(_RECIPE_CTES + """, cell AS (SELECT domain, resource_id, line, field_name, CASE WHEN is_text THEN max(mode) ELSE count(*)::VARCHAR END AS v, is_text FROM (
  SELECT l_linestatus AS domain, l_returnflag AS resource_id, l_linenumber AS line, p_name AS mode, unnest(['cy_' || year(l_shipdate) || '_' || lower(p_type),
   lower(replace(p_brand, '#', '_'))]) AS field_name, unnest([false, true]) AS is_text FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE field_name IS NOT NULL
  GROUP BY domain, resource_id, line, field_name, is_text),
 stay AS (SELECT domain, resource_id, line, md5(string_agg(field_name || '=' || v, ';' ORDER BY field_name)) AS pivots FROM cell JOIN
  (SELECT domain, resource_id, unnest(pv) AS field_name FROM piv) USING (domain, resource_id, field_name) GROUP BY ALL)
SELECT cell.domain, cell.resource_id, line, cluster_id, category, field_name AS instance, CASE WHEN is_text THEN 'STRING' ELSE 'BIGINT' END AS kind, v AS quantity,
 coalesce(pivots, md5('')) AS pivots FROM cell JOIN comp USING (domain, resource_id, field_name) JOIN best ON k = cell.domain || '|' || cell.resource_id || '|' || cluster_id
 LEFT JOIN stay USING (domain, resource_id, line)""")
def recipe_apply(spark, d):
    """Yearly reports, a wide row per line number with numbers and texts, made long by the recipes found for them."""
    part = t.table(spark, d, "part").select("p_partkey", F.lower("p_type").alias("t"), F.lower(F.regexp_replace("p_brand", "#", "_")).alias("brand"), "p_name")
    line = t.table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    row = [F.col("l_linestatus").alias("domain"), F.col("l_returnflag").alias("resource_id"), F.col("l_linenumber").alias("line")]
    yearly = F.concat(F.lit("cy_"), F.year("l_shipdate").cast("string"), F.lit("_"), "t")
    counted = line.groupBy(*row, yearly.alias("name")).agg(F.count("*").cast("variant").alias("v"))
    texts = line.groupBy(*row, F.col("brand").alias("name")).agg(F.max("p_name").cast("variant").alias("v"))
    cells = counted.unionByName(texts).where(F.col("name").isNotNull())
    # as many cells as a table has columns: part types by years, and brands
    wide = cells.groupBy("domain", "resource_id", "line").agg(F.map_from_entries(F.collect_list(F.struct("name", "v"))).alias("cells"))
    long = factoring.apply_recipes(wide, factoring.read_recipes(unpivot_recipe(spark, d), TABLE), TABLE, ["line"])
    kept = F.array_sort(F.transform(F.map_entries("pivots"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return long.select(*TABLE, "line", "cluster_id", "category", "instance", F.schema_of_variant("quantity").alias("kind"),
                       F.col("quantity").cast("string").alias("quantity"), F.md5(F.array_join(kept, ";")).alias("pivots"))
