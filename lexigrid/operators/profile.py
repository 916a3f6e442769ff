"""What a table is about: roles, topics and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.operators import similarity
from lexigrid.operators.catalog import TABLE
from lexigrid.operators.ranking import joined_list, top_per_group


def role(avg_sim: Column, below: float = 0.55) -> Column:
    """A column unlike its neighbours is a dimension, otherwise it may be a measure; NULL without neighbours."""
    return F.when(avg_sim < below, "dimension").when(avg_sim >= below, "measure_candidate")


def classify_roles(columns: DataFrame, name: str, group: list[str], vec: str = "vec", below: float = 0.55) -> DataFrame:
    """Adds ``avg_sim`` and ``role``; both are NULL for a column alone in its table."""
    scored = similarity.mean_similarity(columns, [name], group, vec)
    return scored.withColumn("role", role(F.col("avg_sim"), below))


def role_summary(classified: DataFrame, group: list[str]) -> DataFrame:
    """Dimensions and measure candidates per table with the range of their mean similarity."""
    dim, meas = F.col("role") == "dimension", F.col("role") == "measure_candidate"
    sim = F.col("avg_sim")
    return classified.groupBy(*group).agg(
        F.count_if(dim).alias("n_dim"), F.count_if(meas).alias("n_meas"),
        F.round(F.min(F.when(dim, sim)), 3).alias("dim_min_sim"), F.round(F.max(F.when(dim, sim)), 3).alias("dim_max_sim"),
        F.round(F.min(F.when(meas, sim)), 3).alias("meas_min_sim"), F.round(F.max(F.when(meas, sim)), 3).alias("meas_max_sim"))


def label_columns(columns: DataFrame, key: list[str], taxonomy: DataFrame, vec: str = "vec") -> DataFrame:
    """Nearest category of each column: adds topic, topic_parent, topic_score."""
    topics = taxonomy.select(F.col("category").alias("topic"), F.col("hypernym").alias("topic_parent"), F.col("vec").alias(vec))
    return similarity.nearest(columns, topics, 1, key, "topic", vec, "topic_score", corpus_cols=["topic_parent"]).drop("rank")


def label_clusters(clusters: DataFrame, columns: DataFrame, key: str, group: list[str], taxonomy: DataFrame,
                   vec: str = "vec") -> DataFrame:
    """Nearest category of each cluster, judged by the column that names it.

    Returns group, cluster_id, topic, topic_parent, topic_score.
    """
    ids = clusters.select(*group, "cluster_id").distinct()
    reps = ids.join(columns.select(*group, F.col(key).alias("cluster_id"), vec), [*group, "cluster_id"])
    return label_columns(reps, [*group, "cluster_id"], taxonomy, vec).drop(vec)


def table_profile(topics: DataFrame, group: list[str] | None = None, min_score: float = 0.5, n: int = 3) -> DataFrame:
    """Per table: roles, medium types, and the ``n`` commonest topics of each role.

    ``topics`` has role, medium_type, topic and topic_score per column.
    """
    group = group or TABLE
    kinds = {"n_string": "string", "n_number": "number", "n_date": "date", "n_geo": "geo", "n_bool": "boolean"}
    counts = topics.groupBy(*group).agg(
        F.count_if(F.col("role") == "dimension").alias("n_dim"),
        F.count_if(F.col("role") == "measure_candidate").alias("n_meas"),
        *[F.count_if(F.col("medium_type") == k).alias(c) for c, k in kinds.items()])
    used = topics.where((F.col("topic_score") > min_score) & F.col("role").isNotNull()).groupBy(*group, "role", "topic").agg(F.count("*").alias("_n"))
    top = top_per_group(used, [*group, "role"], [F.desc("_n"), F.asc("topic")], n)
    lists = top.groupBy(*group).agg(
        joined_list(F.when(F.col("role") == "dimension", F.col("topic")), [F.col("topic")]).alias("dim_topics"),
        joined_list(F.when(F.col("role") == "measure_candidate", F.col("topic")), [F.col("topic")]).alias("meas_topics"))
    return counts.join(lists, group, "left").withColumns({
        c: F.nullif(F.col(c), F.lit("")) for c in ("dim_topics", "meas_topics")})


def all_topics(stripped: DataFrame, clusters: DataFrame, labels: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Topics of both sources: group, topic, source, n_cols, confidence.

    ``stripped`` has one row per (group, column, domain_label) that an enumeration knows.
    """
    group = group or TABLE
    known = stripped.groupBy(*group, F.col("domain_label").alias("topic")).agg(
        F.count("*").alias("n_cols")).select(*group, "topic", F.lit("enumeration").alias("source"), "n_cols",
                                             F.lit(1.0).alias("confidence"))
    seen = clusters.join(labels, [*group, "cluster_id"]).groupBy(*group, "topic", "topic_score").agg(
        F.count("*").alias("n_cols")).select(*group, "topic", F.lit("embedding").alias("source"), "n_cols",
                                             F.round("topic_score", 3).alias("confidence"))
    return known.unionByName(seen)


def topic_profile(topics: DataFrame, group: list[str] | None = None, min_confidence: float = 0.5) -> DataFrame:
    """One line per table: ``topic (n), topic (n), …``, most columns first."""
    group = group or TABLE
    kept = topics.where((F.col("confidence") >= min_confidence) | (F.col("source") == "enumeration"))
    entry = F.concat("topic", F.lit(" ("), F.col("n_cols").cast("string"), F.lit(")"))
    order = [-F.col("n_cols"), F.col("topic"), F.col("source"), F.col("confidence")]
    return kept.groupBy(*group).agg(joined_list(entry, order).alias("topic_profile"))


def topic_detail(stripped: DataFrame, clusters: DataFrame, labels: DataFrame, name: str,
                 group: list[str] | None = None) -> DataFrame:
    """Every cluster and every enumeration of a table with its columns."""
    group = group or TABLE
    cols = joined_list(F.col(name), [F.col(name)]).alias("columns")
    seen = clusters.join(labels, [*group, "cluster_id"]).groupBy(
        *group, "topic", "topic_parent", "topic_score", "cluster_id").agg(cols).select(
        *group, "topic", "topic_parent", F.round("topic_score", 3).alias("score"), "columns")
    known = stripped.groupBy(*group, F.col("domain_label").alias("topic")).agg(cols).select(
        *group, "topic", F.lit("enumeration").alias("topic_parent"), F.lit(1.0).alias("score"), "columns")
    return seen.unionByName(known)
