"""Taking column names apart: years, changes, versions; and turning wide tables long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.text import YEAR_TOKEN, replace_first
from lexigrid.functions.vectors import mean_vector
from lexigrid.operators import similarity
from lexigrid.operators.components import similar_components
from lexigrid.session import keep

# the two shapes of yearly names: fixed values
CHANGE = r"^_(\d{4})_(\d{4})_change_(.*)"
YEARLY = r"^cy_(\d{4})_(.*)"


def year_of(name: Column) -> Column:
    """First year token of a name; '' without one."""
    return F.regexp_extract(name, YEAR_TOKEN, 1)


def year_template(name: Column) -> Column:
    """The name with its first year token replaced by ``_YYYY_``."""
    return replace_first(name, YEAR_TOKEN, "_YYYY_")


def temporal_factors(columns: DataFrame, name: str = "field_name") -> DataFrame:
    """Adds ``year_str`` and ``template``."""
    return columns.withColumn("year_str", year_of(F.col(name))).withColumn("template", year_template(F.col(name)))


def temporal_counts(factors: DataFrame, group: list[str]) -> DataFrame:
    """Names with and without a year, distinct years and templates per group."""
    dated = F.col("year_str") != ""
    return factors.groupBy(*group).agg(
        F.count_if(dated).alias("n_temporal"), F.count_if(~dated).alias("n_non_temporal"),
        F.count_distinct(F.when(dated, F.col("year_str"))).alias("n_distinct_years"),
        F.count_distinct(F.when(dated, F.col("template"))).alias("n_distinct_measures"))


def year_templates(factors: DataFrame, group: list[str], at_least: int = 2) -> DataFrame:
    """Templates that occur with ``at_least`` names: their span and list of years."""
    years = F.array_join(F.array_sort(F.collect_set("year_str")), ", ")
    found = factors.where(F.col("year_str") != "").groupBy(*group, "template").agg(
        F.count("*").alias("n_year_columns"),
        F.min(F.expr("try_cast(year_str as int)")).alias("from_year"),
        F.max(F.expr("try_cast(year_str as int)")).alias("to_year"), years.alias("years"))
    measure = replace_first(F.col("template"), "_YYYY_", "{year}")
    return found.where(F.col("n_year_columns") >= at_least).select(
        *group, measure.alias("measure_template"), "n_year_columns", "from_year", "to_year", "years")


def fixed_factors(columns: DataFrame, name: str = "field_name") -> DataFrame:
    """The two fixed shapes ``cy_YYYY_measure`` and ``_YYYY_YYYY_change_measure``; '' where absent."""
    col = F.col(name)
    return (columns.withColumn("year", F.regexp_extract(col, YEARLY, 1))
            .withColumn("measure", F.regexp_extract(col, YEARLY, 2))
            .withColumn("change_from", F.regexp_extract(col, CHANGE, 1))
            .withColumn("change_to", F.regexp_extract(col, CHANGE, 2))
            .withColumn("change_measure", F.regexp_extract(col, CHANGE, 3)))


def measure_years(factors: DataFrame, group: list[str]) -> DataFrame:
    return factors.where(F.col("measure") != "").groupBy(*group, F.col("measure").alias("measure_name")).agg(
        F.min(F.expr("try_cast(year as int)")).alias("from_year"),
        F.max(F.expr("try_cast(year as int)")).alias("to_year"), F.count("*").alias("n_years"))


def change_columns(factors: DataFrame, group: list[str], name: str = "field_name") -> DataFrame:
    return factors.where(F.col("change_measure") != "").select(
        *group, F.col("change_measure").alias("measure_name"),
        F.concat("change_from", F.lit(" to "), "change_to").alias("period"), name)


def unmatched(factors: DataFrame) -> DataFrame:
    """Names of neither fixed shape."""
    return factors.where((F.col("measure") == "") & (F.col("change_measure") == ""))


def suffix_stems(columns: DataFrame, group: list[str], name: str = "field_name", at_least: int = 2) -> DataFrame:
    """Names that differ in a trailing ``_number`` only: stem, how many, from and to."""
    stem = F.regexp_extract(name, r"^(.+)_(\d+)$", 1)
    number = F.expr(f"try_cast(regexp_extract({name}, '^(.+)_([0-9]+)$', 2) as bigint)")
    found = columns.select(*group, stem.alias("stem"), number.alias("_n")).where(F.col("stem") != "")
    return found.groupBy(*group, "stem").agg(
        F.count("*").alias("n_versions"), F.min("_n").alias("first_version"),
        F.max("_n").alias("last_version")).where(F.col("n_versions") >= at_least)


def json_list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, _quoted), ","), F.lit("]"))


def _quoted(value: Column) -> Column:
    """One string as JSON."""
    return F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1)


def unpivot_recipe(columns: DataFrame, table: list[str], name: str, taxonomy: DataFrame, threshold: float,
                   vec: str = "vec") -> DataFrame:
    """How to unpivot each table: one JSON recipe per cluster of similar column names.

    ``taxonomy`` holds (category, hypernym, vec).  A cluster is named after the category
    nearest to the mean of its vectors; the columns outside every cluster stay as they are.
    Returns table, cluster_id, category, score, unpivot_recipe.
    """
    columns = keep(columns.select(*table, name, vec))
    clusters = similar_components(columns, name, threshold, table, vec)
    placed = clusters.join(columns.select(*table, name, vec), [*table, name])
    centroids = mean_vector(placed, [*table, "cluster_id"], vec, "_centroid").withColumnRenamed("_centroid", vec)
    named = similarity.nearest(centroids, taxonomy, 1, [*table, "cluster_id"], "category", vec,
                               corpus_cols=["hypernym"]).drop(vec, "rank")
    instances = clusters.groupBy(*table, "cluster_id").agg(F.array_sort(F.collect_list(name)).alias("_inst"))
    plain = columns.select(*table, name).join(clusters.select(*table, name), [*table, name], "left_anti")
    pivots = plain.groupBy(*table).agg(F.array_sort(F.collect_list(name)).alias("_piv"))
    rows = named.join(instances, [*table, "cluster_id"]).join(pivots, table, "left")
    none = F.expr("cast(array() as array<string>)")
    piv = F.coalesce("_piv", none)
    schema = F.array_sort(F.concat(piv, F.array(F.col("category"), F.lit("quantity"))))
    recipe = F.to_json(F.struct(
        F.col("category").alias("category_name"), F.col("hypernym").alias("category_hypernym"),
        F.round("score", 4).alias("confidence"), F.col("_inst").alias("instance_columns"),
        piv.alias("pivot_columns"), schema.alias("suggested_schema")))
    return rows.select(*table, "cluster_id", "category", F.round("score", 4).alias("score"), recipe.alias("unpivot_recipe"))


RECIPE = "category_name string, instance_columns array<string>, pivot_columns array<string>"


def read_recipes(recipes: DataFrame, table: list[str], recipe: str = "unpivot_recipe") -> DataFrame:
    """The recipes of ``unpivot_recipe`` read from their JSON: table, cluster_id, category, instances, pivots, problem.

    ``problem`` tells what is wrong with a recipe (null: nothing), which is kept but not applied.  Fields other than the three
    used may be absent; a recipe without pivot columns has none.
    """
    read = recipes.select(*table, "cluster_id", F.from_json(recipe, RECIPE).alias("_r"), F.col(recipe).isNull().alias("_none"))
    problem = (F.when(F.col("_none"), "no recipe").when(F.col("_r.category_name").isNull() & F.col("_r.instance_columns").isNull(), "not a recipe")
               .when(F.col("_r.category_name").isNull(), "no category").when(F.coalesce(F.size("_r.instance_columns"), F.lit(0)) < 1, "no instance columns"))
    none = F.expr("cast(array() as array<string>)")
    return read.select(*table, "cluster_id", F.col("_r.category_name").alias("category"), F.array_distinct(F.coalesce("_r.instance_columns", none)).alias("instances"),
                       F.array_distinct(F.coalesce("_r.pivot_columns", none)).alias("pivots"), problem.alias("problem"))


def apply_recipes(wide: DataFrame, recipes: DataFrame, table: list[str], row: list[str], cells: str = "cells") -> DataFrame:
    """Wide rows of any number of tables made long, each by the recipes of its own table.

    ``cells`` is a VARIANT object or a map from column name to VARIANT, so tables of any columns share one frame and a value keeps
    its type.  A row gives one row per instance column that it has: table, row, cluster_id, category (of the recipe), instance (the column), quantity
    (VARIANT) and pivots (map of the cells that stay as they are).  An absent cell gives no row, a null one a row with null.
    Tables without a recipe, rows without cells and recipes with a problem give none.  Recipes are few against rows: they are broadcast when counted small, else
    the rows of a table are salted; cells are never shuffled by name.
    """
    usable = recipes.where(F.col("problem").isNull()).groupBy(*table).agg(
        F.collect_list(F.struct("cluster_id", "category", "instances", "pivots")).alias("_recipes"))
    held = F.col(cells).cast("map<string,variant>").alias("_cells")
    met = similarity.join_groups(wide.select(*table, *row, held), usable, table)
    each = met.select(*table, *row, "_cells", F.explode("_recipes").alias("_r"))
    present = F.expr("transform(filter(_r.instances, c -> map_contains_key(_cells, c)), c -> struct(c as instance, _cells[c] as quantity))")
    stay = F.expr("map_from_entries(transform(filter(_r.pivots, c -> map_contains_key(_cells, c)), c -> struct(c, _cells[c])))")
    long = each.select(*table, *row, F.col("_r.cluster_id").alias("cluster_id"), F.col("_r.category").alias("category"), stay.alias("pivots"), F.explode(present).alias("_c"))
    return long.select(*table, *row, "cluster_id", "category", F.col("_c.instance").alias("instance"), F.col("_c.quantity").alias("quantity"), "pivots")


def unpivot_years(wide: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """A wide table's year columns as rows: ids, measure, year, value."""
    long = wide.unpivot(ids, values, "_name", "value")
    return long.select(*ids, F.regexp_extract("_name", YEARLY, 2).alias("measure"),
                       F.expr(f"try_cast(regexp_extract(_name, '{_sql(YEARLY)}', 1) as int)").alias("year"), "value")


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\")
