"""Encoders compared: does a document lead back to its language, a part name to its type?"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.functions.vectors import mean_vector
from lexigrid.operators import encode, evaluate, profile, similarity
from lexigrid.plans import checks as c
from lexigrid.plans import tables as t
from lexigrid.plans.registry import query
from lexigrid.session import keep

ENCODERS = list(encode.DEFAULT_ENCODERS.values())
MODELS = [e.name for e in ENCODERS]


def _union(template) -> str:
    return " UNION ALL ".join(template(e) for e in ENCODERS)


_DOCS = ",\n".join(c.encoded(f"d_{e.name}", "documents", "doc_id", "text", e.dim, e.unit) for e in ENCODERS) + ",\n" + (
    "syms AS (" + _union(lambda e: f"SELECT '{e.name}' AS model, lang AS true_domain, doc_id AS symbol, vec, nrm FROM d_{e.name} JOIN documents USING (doc_id)")
    + "),\nkeyed AS (SELECT model || '|' || true_domain AS k, vec FROM syms),\n" + c.centroid("kc", "keyed", "k")
    + ",\ndoms AS (SELECT split_part(k, '|', 1) AS model, split_part(k, '|', 2) AS predicted_domain, vec, nrm FROM kc)") + f""",
found AS (SELECT * FROM (SELECT model, true_domain, symbol, predicted_domain, score,
  row_number() OVER (PARTITION BY model, true_domain, symbol ORDER BY score DESC, predicted_domain) AS rank FROM (
  SELECT s.model, s.true_domain, s.symbol, m.predicted_domain, {c.cosine('s', 'm')} AS score FROM syms s JOIN doms m ON s.model = m.model)) WHERE rank <= 3),
-- one row per symbol: its predictions in order, and whether the first and any of them is right
told AS (SELECT model, true_domain, symbol, p, s, p[1] = true_domain AS hit, list_contains(p, true_domain) AS any_hit FROM (
  SELECT model, true_domain, symbol, list(predicted_domain ORDER BY rank) AS p, list(score ORDER BY rank) AS s FROM found GROUP BY ALL))"""


def _matches(spark, d):
    """Three nearest languages of every document under every encoder."""
    docs = t.documents(spark, d).select(F.col("lang").alias("true_domain"), F.col("doc_id").alias("symbol"), "text")
    # the means and the predictions read the vectors: texts are encoded once
    symbols = keep(encode.encode_models(docs, "text", ENCODERS).drop("text"))
    means = mean_vector(symbols, ["model", "true_domain"]).withColumnRenamed("true_domain", "predicted_domain")
    return evaluate.predictions(symbols, means, 3)


@query(c.with_(_DOCS) + "SELECT * FROM found")
def model_predictions(spark, d):
    return _matches(spark, d)


@query(c.with_(_DOCS) + """SELECT model, count(*) AS total, sum(hit::INT)::BIGINT AS top1_correct, sum(any_hit::INT)::BIGINT AS topk_correct,
 round(100 * avg(hit::INT), 1) AS top1_pct, round(100 * avg(any_hit::INT), 1) AS topk_pct FROM told GROUP BY model""")
def model_accuracy(spark, d):
    return evaluate.accuracy(_matches(spark, d))


@query(c.with_(_DOCS) + ", size AS (SELECT true_domain, len(list_distinct(list(symbol))) AS out_of FROM told GROUP BY true_domain)" + "".join(
    f", hits_{m} AS (SELECT true_domain, sum(hit::INT)::BIGINT AS {m}_correct FROM told WHERE model = '{m}' GROUP BY true_domain)" for m in MODELS) +
       " SELECT * FROM size " + " ".join(f"JOIN hits_{m} USING (true_domain)" for m in MODELS))
def domain_accuracy(spark, d):
    return evaluate.domain_accuracy(_matches(spark, d), MODELS)


@query(c.with_(_DOCS) + """SELECT model, round(one, 3) AS avg_top1_score, round(two, 3) AS avg_top2_score, round(one - two, 3) AS avg_gap
FROM (SELECT model, avg(s[1]) AS one, avg(s[2]) AS two FROM told GROUP BY model)""")
def score_gap(spark, d):
    return evaluate.score_gap(_matches(spark, d))


@query(c.with_(_DOCS) + "SELECT model, true_domain, symbol, p[1] AS predicted_domain, round(s[1], 3) AS score FROM told WHERE NOT hit")
def misclassified(spark, d):
    return evaluate.misclassified(_matches(spark, d))


_PARTS = "pn AS (SELECT DISTINCT p_type, p_name, p_type || '|' || p_name AS k FROM part),\nun AS (SELECT DISTINCT p_name FROM pn),\n" + ",\n".join(
    c.encoded(f"p_{e.name}", "un", "p_name", "p_name", e.dim, e.unit) for e in ENCODERS) + ",\n" + (
    "pv AS (" + _union(lambda e: f"SELECT '{e.name}' AS model, p_type, p_name, vec, nrm FROM pn JOIN p_{e.name} USING (p_name)") + "),\n") + """
asim AS (SELECT a.model, a.p_type, a.p_name, round(avg(list_dot_product(a.vec, b.vec) / (a.nrm * b.nrm)), 6) AS avg_sim
 FROM pv a JOIN pv b ON a.model = b.model AND a.p_type = b.p_type AND a.p_name <> b.p_name GROUP BY ALL)"""


def _part_sims(spark, d):
    """Mean similarity of each part name to the others of its type, under every encoder."""
    names = t.table(spark, d, "part").select("p_type", "p_name").distinct()
    vecs = encode.encode_models(names, "p_name", ENCODERS)
    scored = similarity.mean_similarity(vecs, ["p_name"], ["model", "p_type"])
    return scored.where(F.col("avg_sim").isNotNull())


@query(c.with_(_PARTS) + ", cuts AS (SELECT model, quantile_cont(avg_sim, [0, 0.1, 0.25, 0.5, 0.75, 1]) AS q FROM asim GROUP BY model) SELECT model, " + ", ".join(
    f"round(q[{i}], 3) AS {name}" for i, name in enumerate("p_min p10 p25 p50 p75 p_max".split(), 1)) + " FROM cuts")
def model_spread(spark, d):
    return evaluate.spread(_part_sims(spark, d), ["model"], "avg_sim")


@query(c.with_(_PARTS) + """, wide AS (SELECT p_type, p_name, """ + ", ".join(f"max(avg_sim) FILTER (WHERE model = '{m}') AS {m}" for m in MODELS) + """ FROM asim GROUP BY ALL)
SELECT * EXCLUDE (up, down), CASE WHEN tri64 < 0.3 THEN 'dimension' ELSE 'measure_candidate' END AS role, CASE WHEN up <= 20 THEN 'lowest' ELSE 'highest' END AS extreme
FROM (SELECT *, row_number() OVER (ORDER BY tri64, p_type, p_name) AS up, row_number() OVER (ORDER BY tri64 DESC, p_type, p_name) AS down FROM wide)
WHERE up <= 20 OR down <= 20""")
def model_extremes(spark, d):
    """The twenty part names least like the others of their type, and the twenty most like them, all encoders side by side."""
    wide = evaluate.side_by_side(_part_sims(spark, d), ["p_type", "p_name"], MODELS).withColumn("role", profile.role(F.col("tri64"), 0.3))
    wide = keep(wide)
    low = wide.orderBy("tri64", "p_type", "p_name").limit(20).withColumn("extreme", F.lit("lowest"))
    high = wide.orderBy(F.desc("tri64"), "p_type", "p_name").limit(20).withColumn("extreme", F.lit("highest"))
    return low.unionByName(high.join(low.select("p_type", "p_name"), ["p_type", "p_name"], "left_anti"))


_GRID = ("pairs AS (SELECT DISTINCT p_name AS a, p_type AS b FROM part),\nta AS (SELECT DISTINCT a AS x FROM pairs UNION SELECT DISTINCT b FROM pairs),\n" + ",\n".join(
    c.encoded(f"g_{e.name}", "ta", "x", "x", e.dim, e.unit) for e in ENCODERS))


@query(c.with_(_GRID) + " UNION ALL ".join(
    f"SELECT '{e.name}' AS model, a, b, round({c.cosine('l', 'r')}, 6) AS sim FROM pairs JOIN g_{e.name} l ON l.x = a JOIN g_{e.name} r ON r.x = b" for e in ENCODERS))
def pair_grid(spark, d):
    """Similarity of each part name to its type's name under every encoder."""
    pairs = t.table(spark, d, "part").select(F.col("p_name").alias("a"), F.col("p_type").alias("b")).distinct()
    both = [F.struct(F.lit(e.name).alias("model"), encode.embed(F.col("a"), e).alias("va"), encode.embed(F.col("b"), e).alias("vb")) for e in ENCODERS]
    rows = pairs.select("a", "b", F.explode(F.array(*both)).alias("e")).select("a", "b", "e.*")
    return evaluate.pair_grid(rows, "va", "vb", ["model", "a", "b"])
