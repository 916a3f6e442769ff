"""Readers for gazetteer dumps, truth tables, taxonomies and enumeration documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Column layouts of the dumps: fixed values.
COUNTRY_SCHEMA = ", ".join(f"{c} string" for c in (
    "iso iso3 iso_numeric fips country capital area_sq_km population continent tld currency_code currency_name "
    "phone postal_code_format postal_code_regex languages geonameid neighbours equivalent_fips_code").split())
ADMIN_SCHEMA = "code string, name string, asciiname string, geonameid int"
ALT_NAME_SCHEMA = ("alt_id int, geonameid int, lang string, alt_name string, is_preferred string, is_short string, "
                   "is_colloquial string, is_historic string, from_date string, to_date string")
# Position of each field in a city file whose columns are named 0, 1, 2 ...: fixed values.
CITY_FIELDS = {
    "geonameid": (0, "int"), "name": (1, "string"), "asciiname": (2, "string"), "alternatenames": (3, "string"),
    "latitude": (4, "double"), "longitude": (5, "double"), "feature_class": (6, "string"),
    "feature_code": (7, "string"), "country_code": (8, "string"), "admin1_code": (10, "string"),
    "admin2_code": (11, "string"), "admin3_code": (12, "string"), "population": (14, "bigint"),
    "timezone": (17, "string"),
}


def read_tsv(spark: SparkSession, path: str, schema: str, comment: str | None = None) -> DataFrame:
    """Tab-separated lines without header or quoting; lines that begin with ``comment`` are left out."""
    reader = spark.read.schema(schema).option("sep", "\t").option("quote", "")
    return (reader.option("comment", comment) if comment else reader).csv(path)


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """The country file, the only one with comment lines."""
    return read_tsv(spark, path, COUNTRY_SCHEMA, comment="#")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header.  Without a schema the types are inferred, which reads the file twice."""
    reader = spark.read.option("header", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_cities(spark: SparkSession, path: str, min_population: int = 1000) -> DataFrame:
    """Populated places from parquet with numbered columns; filter and columns reach the scan."""
    raw = spark.read.parquet(path)
    kept = raw.where((F.col("`6`") == "P") & (F.col("`14`").cast("bigint") >= min_population))
    return kept.select(*[F.col(f"`{i}`").cast(t).alias(c) for c, (i, t) in CITY_FIELDS.items()])


TAXONOMY_SCHEMA = ("categories array<struct<synset_id: string, category: string, hypernym: string, "
                   "depth: int, gloss: string>>")
DOMAINS_SCHEMA = ("domains array<struct<domain_name: string, domain_label: string, source: string, "
                  "wikidata_qid: string, member_count: bigint, "
                  "members: array<struct<label: string, alt_labels: array<string>>>>>")


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """A nested JSON document as (synset_id, category, hypernym, depth, gloss)."""
    return spark.read.schema(TAXONOMY_SCHEMA).json(path, multiLine=True).select(F.inline("categories"))


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """A nested JSON document as (domain_name, domain_label, source, label, alt_label).

    One row per member and spelling; a member without spellings has one row with NULL.
    """
    domains = spark.read.schema(DOMAINS_SCHEMA).json(path, multiLine=True).select(F.inline("domains"))
    each = domains.select("domain_name", "domain_label", "source", F.explode("members").alias("_m"))
    return each.select("domain_name", "domain_label", "source", F.col("_m.label").alias("label"),
                       F.explode_outer("_m.alt_labels").alias("alt_label"))


def domain_terms(rows: DataFrame, normalize=F.lower) -> DataFrame:
    """Labels and spellings of :func:`read_domains` as (domain_name, domain_label, term)."""
    both = rows.select("domain_name", "domain_label", F.explode(F.array("label", "alt_label")).alias("_t"))
    return both.select("domain_name", "domain_label", normalize(F.trim("_t")).alias("term")) \
        .where(F.length("term") > 0).distinct()


CELL = "struct<value: string>"
BINDING_SCHEMA = f"struct<label: {CELL}, code: {CELL}, symbol: {CELL}, altLabels: {CELL}>"


def members_from_bindings(bindings: Column) -> Column:
    """(label, alt_labels) of one result binding in JSON.

    Spellings are the comma parts of ``altLabels``, trimmed, empty ones left out; code and
    then symbol go in front unless already listed.
    """
    b = F.from_json(bindings, BINDING_SCHEMA)
    split = F.filter(F.transform(F.split(F.coalesce(b["altLabels"]["value"], F.lit("")), ","), lambda a: F.trim(a)),
                     lambda a: F.length(a) > 0)
    out = split
    for field in ("code", "symbol"):
        value = b[field]["value"]
        fresh = value.isNotNull() & (value != "") & ~F.array_contains(out, value)
        out = F.when(fresh, F.concat(F.array(value), out)).otherwise(out)
    return F.struct(b["label"]["value"].alias("label"), out.alias("alt_labels"))
