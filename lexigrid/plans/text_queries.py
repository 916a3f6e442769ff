"""Text normalisation, tokens, windows, packing and encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.functions import text, vectors
from lexigrid.operators import encode
from lexigrid.plans import checks as c
from lexigrid.plans import tables as t
from lexigrid.plans.registry import query
from lexigrid.sources import tables as stored

N_CTX = 128
BUDGET = 2048


@query("SELECT doc_id, length(s) AS n_chars, md5(s) AS digest FROM "
       "(SELECT doc_id, lower(strip_accents(text)) AS s FROM documents)")
def normalize_terms(spark, d):
    normal = t.documents(spark, d).select("doc_id", text.normalize_term(F.col("text")).alias("s"))
    return normal.select("doc_id", F.length("s").alias("n_chars"), F.md5("s").alias("digest"))


_SPELLED = """CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'City of St ' || c_name WHEN 'BUILDING' THEN 'Republic of Mt. ' || c_name
  WHEN 'FURNITURE' THEN 'Ft Saint-' || c_name WHEN 'HOUSEHOLD' THEN 'São-' || c_name ELSE 'Province of ' || c_name END"""


@query(f"""WITH b AS (SELECT c_custkey, trim(lower(strip_accents({_SPELLED}))) AS v0 FROM customer),
 b1 AS (SELECT *, regexp_replace(v0, '^(?:city|republic|state|province|kingdom) of ', '') AS v1 FROM b),
 b2 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(v1, '(^|[ -])st\\.? ', '\\1saint ', 'g'),
   '(^|[ -])ft\\.? ', '\\1fort ', 'g'), '(^|[ -])mt\\.? ', '\\1mount ', 'g') AS v2 FROM b1),
 b3 AS (SELECT *, replace(v2, '-', ' ') AS v3 FROM b2)
SELECT c_custkey, term, min(i) AS first_try FROM (
 SELECT c_custkey, unnest([v0, v1, v2, v3]) AS term, unnest([0, 1, 2, 3]) AS i FROM b3) GROUP BY ALL""")
def term_variants(spark, d):
    spelled = t.table(spark, d, "customer").select("c_custkey", F.expr(_SPELLED).alias("name"))
    base = text.name_variants(F.col("name"))
    # array_distinct drops repeats: give each spelling the place of its first appearance
    rows = spelled.select("c_custkey", F.explode(F.transform(
        base, lambda v: F.struct(v.alias("term")))).alias("s"), F.trim(text.normalize_term(F.col("name"))).alias("b"))
    v1 = F.regexp_replace("b", r"^(?:city|republic|state|province|kingdom) of ", "")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(
        v1, r"(^|[ -])st\.? ", "$1saint "), r"(^|[ -])ft\.? ", "$1fort "), r"(^|[ -])mt\.? ", "$1mount ")
    first = (F.when(F.col("s.term") == F.col("b"), 0).when(F.col("s.term") == v1, 1)
             .when(F.col("s.term") == plain, 2).otherwise(3))
    return rows.select("c_custkey", F.col("s.term").alias("term"), first.alias("first_try"))


@query(f"""SELECT lang, count(*) AS n_docs, sum(n) AS n_tokens, min(n) AS min_tokens, max(n) AS max_tokens,
 round(avg(n), 6) AS avg_tokens FROM (SELECT lang, len({c.words('text')}) + 2 AS n FROM documents) GROUP BY lang""")
def token_stats(spark, d):
    docs = t.documents(spark, d).select("lang", text.token_count(F.col("text")).cast("long").alias("n"))
    return docs.groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.min("n").alias("min_tokens"),
        F.max("n").alias("max_tokens"), F.round(F.avg("n"), 6).alias("avg_tokens"))


_WINDOWS = f"""dt AS (SELECT doc_id, {c.words('{0}')} AS l FROM documents),
 dw AS (SELECT doc_id, l, unnest(range(0, CASE WHEN len(l) <= {N_CTX} THEN 1
   ELSE ceil((len(l) - {N_CTX}) / {N_CTX // 2}.0)::BIGINT + 1 END)) AS window_no FROM dt),
 win AS (SELECT doc_id, window_no, window_no * {N_CTX // 2} AS start_token,
   l[window_no * {N_CTX // 2} + 1 : window_no * {N_CTX // 2} + {N_CTX}] AS w FROM dw)"""


@query("WITH " + _WINDOWS.replace("{0}", "text") + """
SELECT doc_id, window_no, start_token, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS digest FROM win""")
def doc_windows(spark, d):
    rows = encode.text_windows(t.documents(spark, d), ["doc_id"], "text", N_CTX)
    return rows.select("doc_id", "window_no", "start_token", "n_tokens", F.md5("window_text").alias("digest"))


@query(f"""WITH RECURSIVE r AS (SELECT doc_id, len({c.words('text')}) + 2 AS n_tokens, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
 p AS (SELECT i, doc_id, n_tokens, 0 AS bin_no, n_tokens AS used FROM r WHERE i = 1
  UNION ALL SELECT r.i, r.doc_id, r.n_tokens, p.bin_no + (p.used + r.n_tokens > {BUDGET})::INT,
   r.n_tokens + CASE WHEN p.used + r.n_tokens > {BUDGET} THEN 0 ELSE p.used END
  FROM p JOIN r ON r.i = p.i + 1)
SELECT bin_no, doc_id, n_tokens FROM p""")
def pack_sequences(spark, d):
    docs = t.documents(spark, d).select("doc_id", text.token_count(F.col("text")).alias("n_tokens"))
    return encode.pack_texts(docs, [], "doc_id", "n_tokens", BUDGET).select("bin_no", "doc_id", "n_tokens")


def _cells(df, key: str):
    """Non-zero vector entries as rows."""
    flat = df.select(key, F.posexplode("vec").alias("dim", "value"))
    return flat.where(F.col("value") != 0).select(key, "dim", F.round(F.col("value").cast("double"), 6).alias("value"))


def _cells_sql(name: str, key: str) -> str:
    return (f"SELECT {key}, dim, round(value, 6) AS value FROM (SELECT {key}, unnest(vec) AS value, "
            f"unnest(range(len(vec))) AS dim FROM {name}) WHERE value <> 0")


@query(c.with_(c.encoded("e", "documents", "doc_id", "text")) + _cells_sql("e", "doc_id"))
def encode_docs(spark, d):
    docs = t.documents(spark, d).select("doc_id", "text")
    return _cells(encode.encode(docs, "text").drop("text"), "doc_id")


@query(c.with_(_WINDOWS.replace("{0}", "lower(strip_accents(text))"),
               "wt AS (SELECT doc_id * 1000000 + window_no AS k, array_to_string(w, ' ') AS t FROM win)",
               c.counts("e", "wt", "k", "t"),
               "pooled AS (SELECT k // 1000000 AS doc_id, b, sum(n) AS n FROM e_c GROUP BY ALL)",
               "pooled_m AS (SELECT doc_id, b, n / m AS n FROM pooled JOIN (SELECT doc_id, count(*) AS m FROM win GROUP BY doc_id) USING (doc_id))",
               c.dense("v", "documents", "doc_id", "pooled_m")) + _cells_sql("v", "doc_id"))
def window_pool(spark, d):
    docs = t.documents(spark, d).select("doc_id", "text")
    return _cells(encode.encode(docs, "text", n_ctx=N_CTX).drop("text"), "doc_id")


@query(c.with_(c.encoded("e", "part", "p_partkey", "p_name")) + _cells_sql("e", "p_partkey"))
def vector_store(spark, d):
    """Vectors packed as the store keeps them, and read back."""
    part = t.table(spark, d, "part").select("p_partkey", "p_name")
    packed = encode.encode(part, "p_name").select("p_partkey", stored.pack(F.col("vec")).alias("b64"))
    return _cells(packed.select("p_partkey", stored.unpack(F.col("b64"), encode.DEFAULT.dim).alias("vec")), "p_partkey")


@query(c.with_(c.EMB, c.centroid("cen", "emb", "label")) + """
SELECT e.vec_id, round(e.nrm, 6) AS norm, round(list_dot_product(e.vec, c.vec), 6) AS dot,
 round(list_dot_product(e.vec, c.vec) / (e.nrm * c.nrm), 6) AS sim,
 round((1 - list_dot_product(e.vec, c.vec) / (e.nrm * c.nrm))::FLOAT::DOUBLE, 5) AS distance,
 round(sqrt(list_dot_product(u, u)), 5) AS unit_norm
FROM (SELECT *, list_transform(vec, lambda x: (x / nrm)::FLOAT::DOUBLE) AS u FROM emb) e JOIN cen c USING (label)""")
def vector_scalars(spark, d):
    """The SQL functions on every embedding and its label's mean."""
    from lexigrid import register
    from lexigrid.operators.similarity import join_groups

    register(spark)
    emb = t.embeddings(spark, d)
    rows = join_groups(emb, vectors.mean_vector(emb, ["label"], out="mean"), ["label"])
    return rows.select(
        "vec_id", F.round(F.expr("sqrt(dot_product(vec, vec))"), 6).alias("norm"),
        F.round(F.expr("dot_product(vec, mean)"), 6).alias("dot"), F.round(F.expr("cosine_sim(vec, mean)"), 6).alias("sim"),
        F.round(F.expr("double(cosine_distance(vec, mean))"), 5).alias("distance"),
        F.round(F.expr("sqrt(dot_product(l2_normalize(vec), l2_normalize(vec)))"), 5).alias("unit_norm"))
