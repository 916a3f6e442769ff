"""Roles, clusters and topics of tables; conversations are the tables, their words the columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.operators import catalog, components, encode, factoring, profile, sets, similarity
from lexigrid.plans import checks as c
from lexigrid.plans import tables as t
from lexigrid.plans.catalog_queries import taxonomy_vectors
from lexigrid.plans.registry import query
from lexigrid.session import cut_lineage, keep

TABLE = catalog.TABLE
BELOW = 0.12
STAR = 0.65
TIGHT = 0.80
CONFIDENT = 0.3
OVERLAP = 0.8  # four of five topics shared
_ENUMS = c.enum_members(sets.ENUMERATIONS)


def _dealt(cols):
    """Columns dealt out by table, each table's side by side; kept, as several branches read them."""
    tasks = int(cols.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keep(cols.repartition(tasks, *TABLE))


def _encoded(cols):
    """Columns with the vectors of their names.  These are longer than names, so they are made where the columns are."""
    return encode.encode(cols, "field_name")


def _vectors(spark, d):
    return _encoded(_dealt(t.conversation_columns(spark, d)))


def _with_topics(cols, taxonomy):
    """Columns with the topics of their names; each distinct name is encoded and labelled once."""
    names = _encoded(cols.select("field_name").distinct())
    return similarity.join_groups(cols, profile.label_columns(names, ["field_name"], taxonomy).drop("vec"), ["field_name"])


# every ordered pair of columns of one table; what a column is follows from its pairs
_PAIRS = """pair AS (SELECT domain, resource_id, a.field_name, b.field_name AS other, list_dot_product(a.vec, b.vec) / (a.nrm * b.nrm) AS s
 FROM conv_vecs a JOIN conv_vecs b USING (domain, resource_id) WHERE a.field_name <> b.field_name)"""
_ROLES = c.CONV_VECS + f""",
{_PAIRS},
roles AS (SELECT domain, resource_id, field_name, data_type, avg_sim, ['dimension', 'measure_candidate'][1 + (avg_sim >= {BELOW})::INT] AS role
 FROM conv_cols LEFT JOIN (SELECT domain, resource_id, field_name, round(avg(s), 6) AS avg_sim FROM pair GROUP BY ALL) USING (domain, resource_id, field_name))"""


def _roles(spark, d):
    return profile.classify_roles(_vectors(spark, d), "field_name", TABLE, below=BELOW)


@query(c.with_(_ROLES) + "SELECT domain, resource_id, field_name, data_type, avg_sim, role FROM roles")
def column_roles(spark, d):
    return _roles(spark, d).select(*TABLE, "field_name", "data_type", "avg_sim", "role")


@query(c.with_(_ROLES, """side AS (SELECT domain, resource_id, role, count(*) AS n, round(min(avg_sim), 3) AS lo, round(max(avg_sim), 3) AS hi
 FROM roles WHERE role IS NOT NULL GROUP BY ALL)""") + """SELECT domain, resource_id, coalesce(d.n, 0) AS n_dim, coalesce(m.n, 0) AS n_meas,
 d.lo AS dim_min_sim, d.hi AS dim_max_sim, m.lo AS meas_min_sim, m.hi AS meas_max_sim FROM (SELECT DISTINCT domain, resource_id FROM roles)
 LEFT JOIN (SELECT * FROM side WHERE role = 'dimension') d USING (domain, resource_id)
 LEFT JOIN (SELECT * FROM side WHERE role <> 'dimension') m USING (domain, resource_id)""")
def role_summary(spark, d):
    return profile.role_summary(_roles(spark, d), TABLE)


@query(c.with_(_ROLES, """cand AS (SELECT domain, resource_id, field_name, vec, nrm FROM conv_vecs JOIN roles USING (domain, resource_id, field_name)
 WHERE role = 'measure_candidate' AND regexp_extract(field_name, '(?:^|_)((?:19|20)\\d{2})(?:_|$)', 1) = '')""") + f"""
SELECT domain, resource_id, key_a, key_b, score FROM (SELECT a.domain, a.resource_id, a.field_name AS key_a, b.field_name AS key_b, {c.cosine('a', 'b')} AS score
 FROM cand a JOIN cand b ON a.domain = b.domain AND a.resource_id = b.resource_id AND a.field_name < b.field_name)
WHERE score > {TIGHT} ORDER BY score DESC, domain, resource_id, key_a, key_b LIMIT 30""")
def tight_pairs(spark, d):
    """The thirty tightest pairs among measure candidates without a year."""
    cand = factoring.temporal_factors(_roles(spark, d)).where((F.col("role") == "measure_candidate") & (F.col("year_str") == ""))
    return similarity.top_pairs(cand, "field_name", 30, TABLE, above=TIGHT)


_TOPICS = c.TAXONOMY + f""",
name_topics AS (SELECT field_name, category AS topic, hypernym AS topic_parent, score AS topic_score FROM (
 SELECT nv.field_name, x.category, x.hypernym, {c.cosine('nv', 'x')} AS score FROM nv, taxo x)
 QUALIFY row_number() OVER (PARTITION BY field_name ORDER BY score DESC, category) = 1)"""


@query(c.with_(c.CONV_VECS, _TOPICS) + """SELECT domain, resource_id, field_name, topic, topic_parent, topic_score
FROM conv_cols JOIN name_topics USING (field_name)""")
def column_topics(spark, d):
    cols = keep(t.conversation_columns(spark, d).select(*TABLE, "field_name"))
    return _with_topics(cols, taxonomy_vectors(spark, d))


@query(c.with_(_ROLES, _TOPICS, """ct AS (SELECT roles.*, topic, topic_score, CASE data_type WHEN 'Text' THEN 'string' WHEN 'Number' THEN 'number' ELSE 'other' END AS m
 FROM roles JOIN name_topics USING (field_name))""",
               """tally AS (SELECT domain, resource_id, map_from_entries(list((what, n))) AS k FROM (SELECT domain, resource_id, what, count(*) AS n FROM (
  SELECT domain, resource_id, unnest([role, m]) AS what FROM ct) WHERE what IS NOT NULL GROUP BY ALL) GROUP BY ALL)""",
               f"""common AS (SELECT domain, resource_id, map_from_entries(list((role, named))) AS top FROM (
  SELECT domain, resource_id, role, array_to_string(list_sort(list(topic ORDER BY n DESC, topic)[1:3]), ', ') AS named FROM (
   SELECT domain, resource_id, role, topic, count(*) AS n FROM ct WHERE topic_score > {CONFIDENT} AND role IS NOT NULL GROUP BY ALL) GROUP BY ALL) GROUP BY ALL)""") + """
SELECT domain, resource_id, top['dimension'] AS dim_topics, top['measure_candidate'] AS meas_topics, """ + ", ".join(
    f"coalesce(k['{key}'], 0) AS n_{name}" for name, key in [("dim", "dimension"), ("meas", "measure_candidate"), ("string", "string"), ("number", "number"),
                                                            ("date", "date"), ("geo", "geo"), ("bool", "boolean")]) + """
FROM tally LEFT JOIN common USING (domain, resource_id)""")
def table_profile(spark, d):
    """Roles, types and the three commonest topics per role of each table."""
    typed = _roles(spark, d).withColumn("medium_type", catalog.medium_type(F.col("data_type")))
    cols = keep(typed.select(*TABLE, "field_name", "role", "medium_type"))
    return profile.table_profile(_with_topics(cols, taxonomy_vectors(spark, d)), TABLE, min_score=CONFIDENT)


# known columns and clusters of the others in one long table: a column, its topic, and the part of the table it belongs to
_LAYERS = (_ENUMS, c.CONV_VECS, _TOPICS, "other AS (SELECT * FROM conv_vecs ANTI JOIN (SELECT term AS field_name FROM enums) USING (field_name))", f"""
friend AS (SELECT domain, resource_id, field_name, min({{'far': -s, 'name': o}}).name AS o FROM (
 SELECT domain, resource_id, a.field_name, b.field_name AS o, {c.cosine('a', 'b')} AS s FROM other a JOIN other b USING (domain, resource_id)
 WHERE a.field_name <> b.field_name) WHERE s >= {STAR} GROUP BY ALL)""", """
col_topic AS (SELECT DISTINCT domain, resource_id, field_name, domain_label AS topic, 'enumeration' AS parent, 1.0::DOUBLE AS score, domain_label AS part, true AS known
  FROM conv_cols JOIN enums ON field_name = term
 UNION ALL SELECT domain, resource_id, s.field_name, topic, topic_parent, topic_score, part, false
  FROM (SELECT domain, resource_id, field_name, least(field_name, coalesce(o, field_name)) AS part FROM other LEFT JOIN friend USING (domain, resource_id, field_name)) s
  JOIN name_topics n ON n.field_name = part)""")


def _layers(spark, d):
    """(columns known to an enumeration, clusters of the others, topics of the clusters)"""
    known = sets.enumerations(spark)
    cols = _dealt(t.conversation_columns(spark, d))
    stripped = sets.matches(cols, known, TABLE, "field_name").select(*TABLE, "field_name", "domain_label").distinct()
    rest = _encoded(sets.strip_matched(cols, known, "field_name"))
    clusters = keep(components.star_clusters(rest, "field_name", STAR, TABLE))
    labels = profile.label_clusters(clusters, rest, "field_name", TABLE, taxonomy_vectors(spark, d))
    return stripped, clusters, labels


@query(c.with_(*_LAYERS) + "SELECT domain, resource_id, field_name, part AS cluster_id, topic, score AS topic_score FROM col_topic WHERE NOT known")
def column_clusters(spark, d):
    """Star clusters of the columns no enumeration knows, with their topics."""
    _, clusters, labels = _layers(spark, d)
    return clusters.join(labels, [*TABLE, "cluster_id"]).select(*TABLE, "field_name", "cluster_id", "topic", "topic_score")


@query(c.with_(*_LAYERS) + f"""SELECT domain, resource_id, string_agg(topic || ' (' || n || ')', ', ' ORDER BY n DESC, topic, known, score) AS topic_profile
FROM (SELECT domain, resource_id, topic, known, score, count(*) AS n FROM col_topic GROUP BY ALL) WHERE known OR round(score, 3) >= {CONFIDENT} GROUP BY ALL""")
def topic_profile(spark, d):
    """One line of topics per table: enumerations first stripped, the rest clustered."""
    return profile.topic_profile(profile.all_topics(*_layers(spark, d)), TABLE, CONFIDENT)


@query(c.with_(*_LAYERS) + """SELECT domain, resource_id, topic, parent AS topic_parent, round(score, 3) AS score, columns FROM (
 SELECT domain, resource_id, topic, parent, score, part, known, array_to_string(list(field_name ORDER BY field_name), ', ') AS columns FROM col_topic GROUP BY ALL)""")
def topic_detail(spark, d):
    return profile.topic_detail(*_layers(spark, d), "field_name", TABLE)


@query(c.with_(c.CONV_VECS, _TOPICS, f"""tt AS (SELECT DISTINCT domain || '.' || resource_id AS k, topic FROM conv_cols JOIN name_topics USING (field_name)
  WHERE topic_score > {CONFIDENT})""",
               "sets AS (SELECT k, list(topic ORDER BY topic) AS s FROM tt GROUP BY k)",
               "uniq AS (SELECT min(k) AS k, count(*) AS n, s FROM sets GROUP BY s)",
               f"""ov AS (SELECT a.k AS table_a, b.k AS table_b, a.n AS tables_a, b.n AS tables_b, len(a.s) AS n_a, len(b.s) AS n_b,
  len(list_intersect(a.s, b.s)) AS n_shared FROM uniq a JOIN uniq b ON a.k < b.k)""",
               "units AS (SELECT domain || '.' || resource_id AS k, list_transform(vec, lambda x: x / nrm) AS u FROM conv_vecs)",
               c.centroid("means", "units", "k", "u")) + f"""
SELECT ov.*, round(n_shared / (n_a + n_b - n_shared), 6) AS ratio, round(list_dot_product(x.vec, y.vec), 6) AS col_sim
FROM ov JOIN means x ON x.k = table_a JOIN means y ON y.k = table_b WHERE round(n_shared / (n_a + n_b - n_shared), 6) >= {OVERLAP}""")
def coarse_match(spark, d):
    """Tables that share most topics, then how alike their columns are."""
    key = F.concat_ws(".", "domain", F.col("resource_id").cast("string"))
    cols = _dealt(t.conversation_columns(spark, d)).select(key.alias("k"), "field_name")
    topics = _with_topics(cols, taxonomy_vectors(spark, d)).where(F.col("topic_score") > CONFIDENT)
    pairs = cut_lineage(catalog.topic_overlap(topics, "k", "topic", OVERLAP))
    return catalog.pair_similarity(pairs, _encoded(catalog.of_pairs(cols, pairs, "k")), "k")
