"""Searches, pairs, clusters and means over vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.functions.vectors import mean_vector
from lexigrid.operators import ann, components, encode, profile, similarity
from lexigrid.plans import checks as c
from lexigrid.plans import tables as t
from lexigrid.plans.registry import query

EDGE = 0.35
STAR = 0.25


@query(c.with_(c.EMB, c.centroid("cen", "emb", "label")) + f"""
SELECT vec_id, label, nearest, score FROM (SELECT e.vec_id, e.label, c.label AS nearest, {c.cosine('e', 'c')} AS score
 FROM emb e, cen c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, nearest) = 1""")
def nearest_label_centroid(spark, d):
    emb = t.embeddings(spark, d)
    middle = mean_vector(emb, ["label"]).withColumnRenamed("label", "nearest")
    return similarity.nearest(emb, middle, 1, ["vec_id"], "nearest").select("vec_id", "label", "nearest", "score")


@query(c.with_(c.encoded("q", "benchmark", "item_id", "text"), c.encoded("e", "documents", "doc_id", "text")) + f"""
SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
 FROM (SELECT q.item_id, e.doc_id, {c.cosine('q', 'e')} AS score FROM q, e)) WHERE rank <= 5""")
def knn_topk(spark, d):
    """The five documents nearest to each benchmark text."""
    docs = encode.encode(t.documents(spark, d).select("doc_id", "text"), "text").drop("text")
    items = encode.encode(t.table(spark, d, "benchmark"), "text").drop("text")
    return similarity.search(docs, items, 5, "item_id", "doc_id")


@query(c.with_(c.EMB) + f"""
SELECT vec_id, neighbour, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour) AS rank
 FROM (SELECT a.vec_id, b.vec_id AS neighbour, {c.cosine('a', 'b')} AS score FROM emb a JOIN emb b ON a.vec_id <> b.vec_id))
WHERE rank <= 3""")
def knn_neighbours(spark, d):
    """The three nearest other rows of every embedding."""
    return similarity.best_neighbour(t.embeddings(spark, d), "vec_id", k=3)


_DISTINCT = ("uniq AS (SELECT min(vec_id) AS vec_id, count(*) AS n, vec, any_value(nrm) AS nrm FROM emb GROUP BY vec)")


@query(c.with_(c.EMB, _DISTINCT) + f"""
SELECT a.vec_id AS key_a, b.vec_id AS key_b, a.n AS n_a, b.n AS n_b, {c.cosine('a', 'b')} AS score
FROM uniq a JOIN uniq b ON a.vec_id < b.vec_id WHERE {c.cosine('a', 'b')} >= {EDGE}
UNION ALL SELECT vec_id, vec_id, n, n, 1.0 FROM uniq WHERE n > 1 AND nrm > 0""")
def pairs_above(spark, d):
    return similarity.pairs_above(t.embeddings(spark, d), "vec_id", EDGE)


@query(c.with_(c.EMB) + f"""
SELECT label, key_a, key_b, score FROM (SELECT a.label, a.vec_id AS key_a, b.vec_id AS key_b, {c.cosine('a', 'b')} AS score
 FROM emb a JOIN emb b ON a.label = b.label AND a.vec_id < b.vec_id) ORDER BY score DESC, label, key_a, key_b LIMIT 20""")
def top_pairs_in_group(spark, d):
    return similarity.top_pairs(t.embeddings(spark, d), "vec_id", 20, ["label"])


@query(c.with_(c.EMB) + f"""
SELECT vec_id, label, round(avg(s), 6) AS avg_sim, CASE WHEN round(avg(s), 6) < 0.02 THEN 'dimension' ELSE 'measure_candidate' END AS role
FROM (SELECT a.vec_id, a.label, list_dot_product(a.vec, b.vec) / (a.nrm * b.nrm) AS s
 FROM emb a JOIN emb b ON a.label = b.label AND a.vec_id <> b.vec_id) GROUP BY vec_id, label""")
def avg_sim_roles(spark, d):
    return profile.classify_roles(t.embeddings(spark, d), "vec_id", ["label"], below=0.02).select(
        "vec_id", "label", "avg_sim", "role")


@query(c.with_(c.EMB, f"""s AS (SELECT a.label, a.vec_id, b.vec_id AS o, {c.cosine('a', 'b')} AS sim
 FROM emb a JOIN emb b ON a.label = b.label AND a.vec_id <> b.vec_id)""", f"""
 best AS (SELECT * FROM s WHERE sim >= {STAR} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, o) = 1)""") + """
SELECT e.label, e.vec_id, least(e.vec_id, coalesce(o, e.vec_id)) AS cluster_id, sim FROM emb e LEFT JOIN best USING (vec_id)""")
def star_clusters(spark, d):
    return components.star_clusters(t.embeddings(spark, d), "vec_id", STAR, ["label"])


_COMPONENTS = (c.EMB, f"""edge AS (SELECT a.vec_id AS a, b.vec_id AS b FROM emb a JOIN emb b ON a.vec_id <> b.vec_id
 WHERE {c.cosine('a', 'b')} >= {EDGE})""", """
 reach(node, seen) AS (SELECT DISTINCT a, a FROM edge UNION SELECT e.b, r.seen FROM reach r JOIN edge e ON e.a = r.node)""", """
 comp AS (SELECT node AS vec_id, min(seen) AS cluster_id FROM reach GROUP BY node)""")


@query("WITH RECURSIVE " + ",\n".join(_COMPONENTS) + " SELECT vec_id, cluster_id FROM comp")
def components_of_similar(spark, d):
    return components.similar_components(t.embeddings(spark, d), "vec_id", EDGE)


@query("WITH RECURSIVE " + ",\n".join([*_COMPONENTS, "mem AS (SELECT cluster_id, vec FROM comp JOIN emb USING (vec_id))",
                                       c.centroid("cc", "mem", "cluster_id"), c.centroid("cen", "emb", "label")]) + f"""
SELECT cluster_id, label, score FROM (SELECT cluster_id, l.label, {c.cosine('cc', 'l')} AS score FROM cc, cen l)
QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, label) = 1""")
def component_labels(spark, d):
    """The label whose mean is nearest to each component's mean."""
    emb = t.embeddings(spark, d)
    comp = components.similar_components(emb, "vec_id", EDGE)
    middle = mean_vector(comp.join(emb, "vec_id"), ["cluster_id"])
    return similarity.nearest(middle, mean_vector(emb, ["label"]), 1, ["cluster_id"], "label").drop("vec", "rank")


@query(c.with_(c.EMB, f"scored AS (SELECT a.vec_id AS probe_id, b.vec_id, {c.cosine('a', 'b')} AS score FROM emb a JOIN emb b ON a.vec_id <> b.vec_id)") + """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 3""")
def knn_certified(spark, d):
    """Exactly the three nearest other embeddings, from the cells that may hold them."""
    emb = t.embeddings(spark, d).select("vec_id", "vec")
    return ann.certified_search(emb, emb.withColumnRenamed("vec_id", "probe_id"), 3, "probe_id", "vec_id", same_keys=True).drop("cells_read")


@query()
def ann_join(spark, d):
    """Approximate: the three nearest other embeddings found in the nearest cells."""
    emb = t.embeddings(spark, d).select("vec_id", "vec")
    return ann.cell_search(emb, emb.withColumnRenamed("vec_id", "probe_id"), 3, "probe_id", "vec_id", same_keys=True)


@query("WITH RECURSIVE " + ",\n".join([c.EMB, f"""edge AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b FROM emb a JOIN emb b ON a.label = b.label AND a.vec_id <> b.vec_id
 WHERE {c.cosine('a', 'b')} >= {EDGE})""", """reach(label, node, seen) AS (SELECT DISTINCT label, a, a FROM edge
 UNION SELECT e.label, e.b, r.seen FROM reach r JOIN edge e ON e.label = r.label AND e.a = r.node)"""]) + """
SELECT label, node AS vec_id, min(seen) AS cluster_id FROM reach GROUP BY label, node""")
def components_in_groups(spark, d):
    """Components of the similar embeddings of each label."""
    return components.similar_components(t.embeddings(spark, d), "vec_id", EDGE, ["label"])
