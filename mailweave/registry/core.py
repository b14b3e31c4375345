"""Registration and the inputs that both engines derive from the given tables.

Derived inputs are written once, as SQL that Spark and DuckDB read alike. Tables are
written ``{customer}``; Spark gets a DataFrame for it, DuckDB the view's name.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_CHECKS: dict[str, str] = {}

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its check (``{table}`` placeholders, derived inputs included)."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            _CHECKS[name] = sql
        return fn

    return wrap


def oracle_sql() -> dict[str, str]:
    """The checks with all derived inputs written out."""
    return {name: duck(sql) for name, sql in _CHECKS.items()}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Input of fewer bytes for a core lies in too few files to be parsed by all of them
_FEW = 8 << 20
_STORED: dict[tuple[str, str, str], str] = {}


def dealt(df: DataFrame, sf_dir: str, *tables: str, parts: int | None = None) -> DataFrame:
    """``df``, which comes from ``tables``, over all cores, or in ``parts``, where those tables' files are small.

    Decided on the files' lengths. Larger tables keep their splits, so that no HTML is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts or cores) if _bytes(df.sparkSession, sf_dir, *tables) < cores * _FEW else df


def _bytes(spark: SparkSession, sf_dir: str, *tables: str) -> int:
    """Length of the tables' files."""
    files = spark.read.format("binaryFile").load([f"{sf_dir}/{table}.parquet" for table in tables]).select("length")
    return files.groupBy().sum("length").first()[0] or 0


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages, ready for the parser."""
    return dealt(load(spark, sf_dir, "pages").select("page_id", "html"), sf_dir, "pages")


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[SparkSession, str], DataFrame], table: str = "customer") -> DataFrame:
    """Pages that ``make`` derives from the given tables, written once for an application and read from there.

    Rows of a narrow table become pages of many times their size, so the pages of a large table, too, lie where few tasks
    read its few row groups. They are dealt out at every size, to a multiple of all cores that grows with ``table``.
    """
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _STORED:
        path = scratch(spark)
        cores = spark.sparkContext.defaultParallelism
        parts = cores * (_bytes(spark, sf_dir, table) // (cores * _FEW) + 1)
        make(spark, sf_dir).repartition(parts).write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def scratch(spark: SparkSession) -> str:
    """A new folder next to the checkpoints, on storage that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run portable SQL over the given tables."""
    sql = expand(sql)
    names = [t for t in TABLES if "{" + t + "}" in sql]
    return spark.sql(sql, **{t: load(spark, sf_dir, t) for t in names})


def expand(sql: str) -> str:
    """Replace ``{@name}`` by the derived input of that name, as a sub-query."""
    while "{@" in sql:
        sql = re.sub(r"\{@(\w+)\}", lambda m: "(" + DERIVED[m.group(1)].strip() + ")", sql)
    return sql


def duck(sql: str) -> str:
    sql = expand(sql)
    for name in TABLES:
        sql = sql.replace("{" + name + "}", name)
    return sql


# people: one per customer; names with accents, apostrophes, particles
_FIRST = "Ana|José|María|Łukasz|Íñigo|Zoë|Søren|John|Chloé|Bjørn"
_FIRST_ASCII = "ana|jose|maria|lukasz|inigo|zoe|soren|john|chloe|bjorn"
_LAST = "Pérez|Muñoz-Ríos|O''Neil|García|Straße|Núñez|Ångström|Smith|de la Cruz|Œuvre|Þórsson"
_LAST_ASCII = "perez|munozrios|oneil|garcia|strasse|nunez|angstrom|smith|delacruz|oeuvre|thorsson"

DERIVED: dict[str, str] = {
    "people": f"""
SELECT c_custkey AS k, c_nationkey AS dep,
       split_part('{_FIRST}', '|', CAST(c_custkey % 10 + 1 AS INT)) AS first_name,
       split_part('{_LAST}', '|', CAST(CAST(floor(c_custkey / 10) AS BIGINT) % 11 + 1 AS INT)) AS last_name,
       split_part('{_FIRST_ASCII}', '|', CAST(c_custkey % 10 + 1 AS INT)) AS first_ascii,
       split_part('{_LAST_ASCII}', '|', CAST(CAST(floor(c_custkey / 10) AS BIGINT) % 11 + 1 AS INT)) AS last_ascii,
       concat(split_part('{_FIRST_ASCII}', '|', CAST(c_custkey % 10 + 1 AS INT)), '.',
              split_part('{_LAST_ASCII}', '|', CAST(CAST(floor(c_custkey / 10) AS BIGINT) % 11 + 1 AS INT)), '.',
              CAST(c_custkey AS STRING), '@mail', CAST(c_custkey % 4 AS STRING), '.example.com') AS email
FROM {{customer}}""",
    # raw department contacts: two rows per address, messy names, glued and missing addresses
    "contacts": """
SELECT p.k AS seq,
       CAST(p.dep AS STRING) AS departamento,
       CASE WHEN p.k % 5 = 0 THEN NULL
            WHEN p.k % 17 = 0 THEN 'Departamento'
            WHEN p.k % 11 = 0 THEN p.first_name
            WHEN p.k % 7 = 0 THEN concat('  ', upper(p.first_name), '   ', lower(p.last_name), ' ')
            ELSE concat(p.first_name, ' ', p.last_name) END AS profesor,
       CASE WHEN p.k % 13 = 0 THEN NULL
            WHEN p.k % 19 = 0 THEN 'sin correo'
            WHEN p.k % 7 = 0 THEN concat('Correo: ', upper(q.email), '. ')
            WHEN p.k % 23 = 0 THEN concat(q.email, '.Ficha')
            ELSE q.email END AS email
FROM {@people} p JOIN {@people} q ON q.k = p.k - p.k % 2""",
    # department map without some of the ids, so that fallbacks are needed
    "dep_map": "SELECT CAST(n_nationkey AS STRING) AS dep_id, n_name AS nombre FROM {nation} WHERE n_nationkey % 6 <> 0",
    # names as strings in assorted shapes
    "names": """
SELECT k, CASE k % 9
    WHEN 0 THEN concat('(', first_name, ' ', last_name, ')')
    WHEN 1 THEN concat(upper(first_name), '  ', last_name)
    WHEN 2 THEN first_name
    WHEN 3 THEN concat(' ', lower(first_name), chr(9), lower(last_name), ' 2nd')
    WHEN 4 THEN 'Departamento'
    WHEN 5 THEN concat(first_name, ' a b c d e f g ', last_name)
    WHEN 6 THEN ''
    WHEN 7 THEN NULL
    ELSE concat(first_name, ' ', last_name, ', ', last_ascii) END AS name
FROM {@people}""",
    # contact rows in the stored shape: one per order, sources are customers
    "stored": """
SELECT o.o_orderkey AS seq,
       concat('https://dir.example.edu/people/', CAST(o.o_custkey AS STRING)) AS source_url,
       CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE concat(p.first_name, ' ', p.last_name) END AS full_name,
       CASE WHEN o.o_orderkey % 4 = 1 THEN p.first_name END AS first_name,
       CASE WHEN o.o_orderkey % 4 = 1 THEN p.last_name END AS last_name,
       CASE WHEN o.o_orderkey % 5 < 2 THEN p.email END AS email_found,
       CASE WHEN o.o_orderkey % 5 IN (1, 2) THEN concat(substring(p.first_ascii, 1, 1), p.last_ascii, '@example.edu') END AS email_generated,
       CASE WHEN o.o_orderkey % 5 < 2 THEN 'email_found_list' ELSE 'card_name_generated' END AS method,
       CASE WHEN o.o_orderkey % 5 < 2 THEN CAST(1.0 AS DOUBLE) WHEN o.o_orderkey % 5 = 2 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END AS confidence,
       o.o_orderpriority AS notes
FROM {orders} o JOIN {@people} p ON p.k = o.o_custkey""",
    "profiles": """
SELECT concat('https://dir.example.edu/people/', CAST(k AS STRING)) AS source_url,
       CASE WHEN k % 8 = 1 THEN NULL ELSE concat(first_name, ' ', last_name) END AS full_name,
       CASE WHEN k % 8 < 4 THEN NULL ELSE first_name END AS first_name,
       CASE WHEN k % 8 < 4 THEN NULL ELSE last_name END AS last_name,
       CASE WHEN k % 3 = 0 THEN NULL ELSE 'Example University' END AS university,
       CASE WHEN k % 5 = 0 THEN NULL ELSE n_name END AS department
FROM {@people} JOIN {nation} ON n_nationkey = dep WHERE k % 4 <> 0""",
    # upsert log: values come and go with the event type
    "log": """
SELECT event_id AS seq, concat('https://dir.example.edu/u/', CAST(user_id AS STRING)) AS source_url,
       CASE WHEN event_type = 'view' THEN NULL ELSE concat('Name ', CAST(event_id % 97 AS STRING)) END AS full_name,
       CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE concat('F', CAST(event_id % 89 AS STRING)) END AS first_name,
       CASE WHEN event_type = 'error' THEN concat('L', CAST(event_id % 83 AS STRING)) END AS last_name,
       CASE WHEN event_type = 'signup' THEN 'Example University' END AS university,
       CASE WHEN event_type = 'purchase' THEN concat('D', CAST(event_id % 7 AS STRING)) END AS department
FROM {events}""",
    # addresses in free text, with the text's key
    "texts": """
SELECT concat('doc:', CAST(doc_id AS STRING)) AS src, source AS url, text FROM {documents}
UNION ALL SELECT concat('page:', CAST(page_id AS STRING)) AS src, url, html AS text FROM {pages}""",
}
