"""Test tables and the shapes the queries read them in."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.operators import catalog

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def spread_out(df: DataFrame) -> DataFrame:
    """Deal out the rows of a table that is read in fewer parts than there are cores.

    Costly steps on a handful of parts would keep most cores idle.  A large table has more
    parts than that and is read as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread_out(table(spark, folder, "documents"))


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").withColumnRenamed("embedding", "vec")


def document_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as tables: domain = source, resource_id = doc_id, columns = distinct words."""
    return catalog.text_catalog(documents(spark, folder), F.col("source"), F.col("doc_id"), F.col("text"))


def conversation_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as tables: domain = role, resource_id = conv_id, columns = distinct words."""
    turns = table(spark, folder, "conversations")
    words = catalog.text_catalog(turns.withColumn("_at", F.struct("conv_id", "turn")), F.col("role"), F.col("_at"), F.col("text"))
    rows = words.select("domain", F.col("resource_id.conv_id").alias("resource_id"), "field_name", "data_type",
                        F.struct(F.col("resource_id.turn").alias("turn"), F.col("ordinal_position").alias("at")).alias("ordinal_position"))
    return catalog.merge_catalog(rows)


def taxonomy(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items as categories: category, hypernym, gloss."""
    items = table(spark, folder, "benchmark")
    return items.select(F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("category"),
                        F.concat(F.lit("group_"), (F.col("item_id") % 7).cast("string")).alias("hypernym"),
                        F.col("text").alias("gloss"))


def countries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "region").select(
        F.col("r_regionkey").cast("string").alias("iso"), F.substring("r_name", 1, 3).alias("iso3"),
        F.col("r_name").alias("country"), F.substring("r_name", 1, 2).alias("continent"),
        (F.col("r_regionkey") + 1_000_000).cast("string").alias("geonameid"))


def admin1(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(
        F.concat_ws(".", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")).alias("code"),
        F.col("n_name").alias("name"), F.col("n_name").alias("asciiname"),
        (F.col("n_nationkey") + 2_000_000).cast("long").alias("geonameid"))


def admin2(spark: SparkSession, folder: str) -> DataFrame:
    """Market segments as counties; only customers have one."""
    segments = table(spark, folder, "customer").select("c_nationkey", "c_mktsegment").distinct()
    nation = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    rows = segments.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    code = F.concat_ws(".", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"),
                       F.substring("c_mktsegment", 1, 1))
    return rows.select(code.alias("code"), F.concat("c_mktsegment", F.lit(" "), F.col("n_nationkey").cast("string")).alias("name"),
                       F.col("c_mktsegment").alias("asciiname"),
                       (F.lit(3_000_000) + F.col("n_nationkey") * 100 + F.ascii("c_mktsegment")).cast("long").alias("geonameid"))


def cities(spark: SparkSession, folder: str) -> DataFrame:
    """Customers and suppliers as places, with the codes of the levels above."""
    customer = table(spark, folder, "customer").select(
        (F.col("c_custkey") + 10_000_000).alias("geonameid"), F.col("c_name").alias("place_name"),
        F.lit("CUST").alias("feature_code"), F.col("c_nationkey").alias("_n"),
        F.substring("c_mktsegment", 1, 1).alias("admin2_code"))
    supplier = table(spark, folder, "supplier").select(
        (F.col("s_suppkey") + 20_000_000_000).alias("geonameid"), F.col("s_name").alias("place_name"),
        F.lit("SUPP").alias("feature_code"), F.col("s_nationkey").alias("_n"),
        F.lit(None).cast("string").alias("admin2_code"))
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("_n"), "n_regionkey")
    rows = customer.unionByName(supplier).join(nation, "_n", "left")
    return rows.select("geonameid", "place_name", F.col("place_name").alias("place_ascii"), "feature_code",
                       F.col("n_regionkey").cast("string").alias("country_code"),
                       F.col("_n").cast("string").alias("admin1_code"), "admin2_code")


def alternate_names(spark: SparkSession, folder: str) -> DataFrame:
    """Other spellings of every region, nation and customer, and some for ids nobody knows."""
    region = table(spark, folder, "region").select(
        (F.col("r_regionkey") + 1_000_000).cast("long").alias("geonameid"), F.concat(F.lit("The "), "r_name").alias("alt_name"))
    nation = table(spark, folder, "nation").select(
        (F.col("n_nationkey") + 2_000_000).cast("long").alias("geonameid"),
        F.concat(F.lit("Nátion "), F.col("n_nationkey").cast("string")).alias("alt_name"))
    customer = table(spark, folder, "customer").select(
        (F.col("c_custkey") + 10_000_000).alias("geonameid"),
        F.concat(F.lit("Cust-"), F.col("c_custkey").cast("string")).alias("alt_name"))
    stray = table(spark, folder, "part").select(
        (F.col("p_partkey") + 90_000_000_000).alias("geonameid"), F.col("p_name").alias("alt_name"))
    return region.unionByName(nation).unionByName(customer).unionByName(stray)


def city_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as rows to resolve: a city spelled in one of four ways, its nation and region."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    key = F.col("c_custkey").cast("string")
    spelled = (F.when(F.col("o_orderstatus") == "F", F.col("c_name"))
               .when(F.col("o_orderstatus") == "O", F.concat(F.lit("Cust-"), key))
               .when(F.col("o_orderpriority").startswith("1"), F.concat(F.lit("City of "), "c_name"))
               .otherwise(F.concat(F.lit("Custumer "), key)))
    rows = (o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(r, F.col("n_regionkey") == F.col("r_regionkey")))
    return rows.select(
        F.col("o_orderkey").alias("row_id"), spelled.alias("name"),
        F.when(F.col("o_orderpriority").startswith("2"), F.concat(F.lit("NATION "), F.col("n_nationkey").cast("string")))
        .otherwise(F.col("n_name")).alias("subcountry"),
        F.when(F.col("o_orderpriority").startswith("3"), F.concat(F.lit("Greater "), "r_name"))
        .otherwise(F.lower("r_name")).alias("country"),
        F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


def misspelt_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as rows to resolve level by level: many names with a letter lost, wrong or too many, some of no place, some null."""
    c, n, r = table(spark, folder, "customer"), table(spark, folder, "nation"), table(spark, folder, "region")
    key, rows = F.col("c_custkey"), c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    lost = lambda x: F.concat(F.substr(x, F.lit(1), F.lit(1)), F.substr(x, F.lit(3)))
    wrong = lambda x: F.concat(F.substr(x, F.lit(1), F.lit(1)), F.lit("x"), F.substr(x, F.lit(3)))
    segment = F.concat("c_mktsegment", F.when(key % 5 == 2, "x ").otherwise(" "), F.col("n_nationkey").cast("string"))
    return rows.select(
        F.when(key % 11 == 0, "Atlantis").when(key % 3 == 0, lost(F.col("r_name"))).otherwise(F.lower("r_name")).alias("country"),
        F.when(key % 4 == 1, wrong(F.col("n_name"))).otherwise(F.col("n_name")).alias("admin1"),
        F.when(key % 13 != 0, segment).alias("admin2"),
        F.when(key % 3 == 1, F.replace("c_name", F.lit("stom"), F.lit("stm"))).when(key % 3 == 2, F.replace("c_name", F.lit("Cu"), F.lit("Cvv")))
        .otherwise(F.col("c_name")).alias("city"))


def measure_names(spark: SparkSession, folder: str) -> DataFrame:
    """Column names of a yearly report, one table per return flag and line status.

    Years and part types come from the line items; a name carries a year, a change between
    two years, a version number, or nothing of the kind.
    """
    line = table(spark, folder, "lineitem").select(
        F.col("l_linestatus").alias("domain"), F.col("l_returnflag").alias("resource_id"), "l_partkey",
        F.year("l_shipdate").alias("y"))
    part = table(spark, folder, "part").select(
        "p_partkey", F.lower("p_type").alias("t"), F.lower(F.regexp_replace("p_brand", "#", "_")).alias("brand"),
        F.regexp_replace("p_name", " ", "_").alias("pname"))
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    y, y1 = F.col("y").cast("string"), (F.col("y") + 1).cast("string")
    names = F.array(F.concat(F.lit("cy_"), y, F.lit("_"), "t"),
                    F.concat(F.lit("_"), y, F.lit("_"), y1, F.lit("_change_"), "t"),
                    F.concat("t", F.lit("_"), y, F.lit("_total_"), y1),
                    F.col("brand"), F.col("pname"))
    return (rows.select("domain", "resource_id", F.explode(names).alias("field_name")).distinct())
