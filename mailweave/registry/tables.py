"""Sources and sinks (S*, K*): written to the shared scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import siteprofile as sp
from ..operators import extract as X
from ..operators import merge as M
from ..plans import crm, curate
from ..sources import sinks, tables
from . import pipelines
from .core import derived, load, query, scratch


_CLEAN_CSV = "SELECT departamento, profesor, email FROM {@final}"


@query("s2_csv_scan", _CLEAN_CSV)
def s2(spark, d):
    path = scratch(spark)
    derived(spark, d, _CLEAN_CSV).write.option("header", True).csv(path)
    return tables.read_contacts_csv(spark, path)


@query("s3_seed_list", "SELECT url AS value FROM {pages}")
def s3(spark, d):
    """One URL per line with blanks and empty lines around."""
    path = scratch(spark)
    lines = load(spark, d, "pages").select(F.concat(F.lit("  "), "url", F.lit(" \t\n   \n")).alias("value"))
    lines.write.text(path)
    return tables.read_seeds(spark, path)


_SEED_CASES = "SELECT k, CASE k % 4 " + " ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(sp.SEED_URLS)) + " ELSE concat('https://www.example.edu/', CAST(k AS STRING)) END AS url FROM {@people}"


@query("s4_default_seeds", f"SELECT k, url FROM ({_SEED_CASES}) WHERE k % 4 < 3")
def s4(spark, d):
    """Stored links that lead to one of the literal seeds."""
    return derived(spark, d, _SEED_CASES).join(tables.default_seeds(spark).select("url"), "url").select("k", "url")


@query("s5_json_map", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS nombre FROM {events}")
def s5(spark, d):
    """JSON objects as key-value rows."""
    return tables.json_map(load(spark, d, "events"), "props", ("event_id",)).select("event_id", "nombre")


@query("s6_table_scan", "SELECT o_orderkey, o_custkey FROM {orders}")
def s6(spark, d):
    return tables.read_table(spark, f"{d}/orders.parquet", ["o_orderkey", "o_custkey"])


@query("s7_keyword_counts", "SELECT w AS word, count(*) AS documents FROM (SELECT unnest(['the', 'und', 'eau', 'ción']) AS w, lower(text) AS t FROM {documents}) WHERE contains(t, w) GROUP BY w")
def s7(spark, d):
    """A literal word list applied to every document."""
    words = [r.word for r in tables.keyword_table(spark, ("the", "und", "eau", "ción")).orderBy("key_order").collect()]
    return tables.keyword_counts(load(spark, d, "documents"), "text", words).withColumnRenamed("rows", "documents")


def _read_csv(spark, path, columns):
    # file order is the sort order: the range-partitioned parts are numbered
    schema = ", ".join(f"{c} STRING" for c in columns)
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


@query("k1_email_index_csv", "SELECT email, string_agg(url, ' | ' ORDER BY url) AS found_on_urls FROM (SELECT DISTINCT email, url FROM {@emails}) GROUP BY email")
def k1(spark, d):
    path = scratch(spark)
    sinks.write_email_index(X.inverted_index(X.emails_in(derived(spark, d, "{@texts}"), "text", ("url",))), path)
    return _read_csv(spark, path, ["email", "found_on_urls"])


@query("k2_contacts_csv", "SELECT profesor AS nombre, email AS correo, departamento FROM {@final}")
def k2(spark, d):
    path = scratch(spark)
    rows = derived(spark, d, "SELECT profesor AS nombre, email AS correo, departamento FROM {@final}")
    sinks.write_contacts(rows, path)
    return _read_csv(spark, path, ["nombre", "correo", "departamento"])


@query("k3_arrival_order_csv", _CLEAN_CSV)
def k3(spark, d):
    path = scratch(spark)
    sinks.write_arrival_order(derived(spark, d, "{@final}"), path, ["seq"])
    return _read_csv(spark, path, ["departamento", "profesor", "email"])


@query("k4_raw_csv", "SELECT source_url, full_name, email_found, email_generated, method, CAST(seq AS STRING) AS seq FROM {@stored}")
def k4(spark, d):
    path = scratch(spark)
    sinks.write_raw(derived(spark, d, "SELECT source_url, full_name, email_found, email_generated, method, seq FROM {@stored}"), path)
    return _read_csv(spark, path, ["source_url", "full_name", "email_found", "email_generated", "method", "seq"])


@query("k5_crm_csv", 'SELECT id, nullif("Nombre", \'\') AS "Nombre", nullif("Email", \'\') AS "Email" FROM (' + pipelines._crm_sql() + ")")
def k5(spark, d):
    path = scratch(spark)
    rows = crm.export_crm(pipelines._stored_with_id(spark, d), derived(spark, d, "{@profiles}"), "Default U")
    sinks.write_crm(rows, path)
    return _read_csv(spark, path, rows.columns).select("id", "Nombre", "Email")


@query("k6_clean_csvs", "SELECT 'all' AS file, departamento, profesor, email FROM {@curated} UNION ALL SELECT 'named', departamento, profesor, email FROM {@curated} WHERE profesor IS NOT NULL")
def k6(spark, d):
    path = scratch(spark)
    sinks.write_clean(curate.curate(derived(spark, d, "{@contacts}"), derived(spark, d, "{@dep_map}")), path)
    parts = [tables.read_clean(spark, path, only).withColumn("file", F.lit(name)) for name, only in (("all", False), ("named", True))]
    return parts[0].unionByName(parts[1])


@query("k7_json_map", "SELECT dep_id, nombre FROM {@full_map}")
def k7(spark, d):
    """The map is written because the contacts held ids that it did not know."""
    path = scratch(spark)
    contacts, old = derived(spark, d, "{@contacts}"), derived(spark, d, "{@dep_map}")
    new = M.complete_map(old, derived(spark, d, "{@new_map}"), None, contacts)
    sinks.write_department_map(new, path, M.missing_keys(contacts, old))
    return tables.read_department_map(spark, path)


@query("s5_k7_j2_map_round_trip", """
SELECT c.seq, coalesce(m.nombre, c.departamento) AS departamento_clean FROM {@contacts} c LEFT JOIN {@full_map} m ON m.dep_id = c.departamento""")
def s5_k7_j2(spark, d):
    """The map is brought up to date, written, read back and applied to the contacts."""
    path = scratch(spark)
    contacts, old = derived(spark, d, "{@contacts}"), derived(spark, d, "{@dep_map}")
    sinks.write_department_map(M.complete_map(old, derived(spark, d, "{@new_map}"), None, contacts), path)
    return M.map_departments(contacts, tables.read_department_map(spark, path)).select("seq", "departamento_clean")


