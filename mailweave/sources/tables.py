"""Sources: page tables, contact files, maps, seed lists, literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas, siteprofile
from ..functions import text as t
from ..operators import domains, extract


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages, without failed or non-HTML responses where those are recorded."""
    return extract.usable_pages(spark.read.parquet(path))


def read_contacts_csv(spark: SparkSession, path: str, schema=schemas.DEPARTMENT_CONTACTS, multi_line: bool = False) -> DataFrame:
    """CSV with header; every column is read as a string, empty fields as NULL.

    Files are split among tasks, unless ``multi_line`` says that quoted fields may hold line breaks.
    An empty string and NULL are the same in these files.
    """
    return spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)


def read_clean(spark: SparkSession, path: str, named_only: bool = False, schema=schemas.DEPARTMENT_CONTACTS) -> DataFrame:
    """K6 read back: all rows, or those with a name, whose folder alone is read then."""
    files = read_contacts_csv(spark, path, T.StructType([*schema.fields, T.StructField("has_name", T.BooleanType())]))
    return (files.filter("has_name") if named_only else files).drop("has_name")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """S3: one URL per line, trimmed, blank lines dropped."""
    lines = spark.read.text(path).select(t.strip(F.col("value")).alias("value"))
    return lines.filter(F.length("value") > 0)


def default_seeds(spark: SparkSession, urls=siteprofile.SEED_URLS) -> DataFrame:
    """S4."""
    return spark.createDataFrame([(i, url) for i, url in enumerate(urls)], "seed_no int, url string")


def read_department_map(spark: SparkSession, path: str) -> DataFrame:
    """``{id: name}`` entries as two columns, from what K7 writes or from one object with an entry on each line.

    A line is read by itself, its outer braces and comma set aside, so files are split among tasks.
    """
    inner = F.regexp_replace(F.trim("value"), r"^\{|[},]\s*$", "")
    return json_map(spark.read.text(path).select(F.concat(F.lit("{"), inner, F.lit("}")).alias("value")), "value")


def json_map(df: DataFrame, column: str, keys=()) -> DataFrame:
    """One row per entry of the JSON objects in a column."""
    return df.select(*keys, F.explode(F.from_json(column, "map<string,string>")).alias("dep_id", "nombre"))


def read_table(spark: SparkSession, path: str, columns=None) -> DataFrame:
    """A stored contact or profile table; unused columns are never read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def keyword_table(spark: SparkSession, words=siteprofile.DEPARTMENT_KEYWORDS) -> DataFrame:
    """A literal word list as a table."""
    return spark.createDataFrame([(i, w) for i, w in enumerate(words)], "key_order int, word string")


def keyword_counts(df: DataFrame, text: str, words) -> DataFrame:
    """S7 applied: in how many rows each of the words occurs; one expression, no join."""
    found = F.filter(t.lit_array(words), lambda w: F.contains(F.lower(text), w))
    return df.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("rows"))


def read_suffix_table(spark: SparkSession, path: str) -> DataFrame:
    """The public suffix list as ``(suffix, kind)``, for :func:`mailweave.operators.domains.registered_domains`."""
    return domains.suffix_rules(_suffix_lines(spark, path))


def _suffix_lines(spark: SparkSession, path: str) -> DataFrame:
    rules = spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias("rule"))
    return rules.filter((F.col("rule") != "") & ~F.col("rule").startswith("//"))


def read_suffixes(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The public suffix list's rules, one per line; comments and blank lines dropped. The list has some 10,000 rules."""
    return tuple(r.rule.lower() for r in _suffix_lines(spark, path).collect())
