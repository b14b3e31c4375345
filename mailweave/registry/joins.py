"""Joins, de-duplication, upserts, set operations and the CRM projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import emails as em
from ..functions import text as t
from ..operators import dedup
from ..operators import merge as M
from ..plans import crm, curate
from ..sources import sinks
from . import sqlkit as q
from .core import DERIVED, derived, load, query

# -- first one wins ---------------------------------------------------------------------
DERIVED["event_rows"] = "SELECT user_id, event_id AS seq, event_type, CASE WHEN event_type = 'view' THEN NULL ELSE concat('n', CAST(event_id % 13 AS STRING)) END AS name, value FROM {events}"


def _winner(keys: str, order: str, cols: str, source: str = "event_rows") -> str:
    return f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {{@{source}}}) WHERE rn = 1"


_ROW = "user_id, seq, event_type, name, value"


@query("w1_first_contact_by_id", """
SELECT id, seq, source_url, method FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM (
  SELECT *, sha256(concat(coalesce(source_url, ''), '|', coalesce(full_name, ''), '|', coalesce(email_found, ''), '|', coalesce(email_generated, ''))) AS id FROM {@stored})) WHERE rn = 1""")
def w1(spark, d):
    return dedup.first_contact_by_id(M.with_contact_id(derived(spark, d, "{@stored}"))).select("id", "seq", "source_url", "method")


@query("w2_first_per_page_email", _winner("user_id, event_type", "name NULLS FIRST, seq", _ROW))
def w2(spark, d):
    return dedup.first_per_page_email(derived(spark, d, "{@event_rows}"), "user_id", "event_type", ("name", "seq"))


@query("w3_first_per_email", _winner("name", "value, seq", _ROW) + " AND name IS NOT NULL")
def w3(spark, d):
    return dedup.first_per_email(derived(spark, d, "{@event_rows}"), "name", ("value", "seq"))


@query("w4_first_named_per_email", _winner("user_id", "name IS NULL, seq", _ROW))
def w4(spark, d):
    return dedup.first_named_per_email(derived(spark, d, "{@event_rows}"), "user_id", "name")


@query("m3_upsert_on_email", _winner("user_id", "name IS NULL, seq", _ROW))
def m3(spark, d):
    """Keep the first contact of each key; a nameless one gives way to the first with a name."""
    return dedup.first_named_per_email(derived(spark, d, "{@event_rows}"), "user_id", "name")


@query("w5_best_named_per_email", _winner("user_id", "name ASC NULLS LAST, seq", _ROW))
def w5(spark, d):
    return dedup.best_named_per_email(derived(spark, d, "{@event_rows}"), "user_id", "name")


DERIVED["link_texts"] = "SELECT event_id AS seq, concat('u', CAST(user_id AS STRING)) AS url, concat('t', CAST(event_id % 400 AS STRING)) AS text FROM {events}"


@query("w6_url_text_dictionary", """
SELECT url, text, seq FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq DESC) AS r2 FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY seq) AS r1 FROM {@link_texts}) WHERE r1 = 1)) WHERE r2 = 1""")
def w6(spark, d):
    return dedup.url_text_dictionary(derived(spark, d, "{@link_texts}"), order=("seq",))


@query("w8_previous_cell", "SELECT l_orderkey, l_linenumber, l_partkey, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS previous FROM {lineitem}")
def w8(spark, d):
    items = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    out = dedup.previous_in_group(items, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "l_returnflag")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "previous")


# -- upserts ------------------------------------------------------------------------------
_LATEST = ", ".join(
    f"max_by({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("full_name", "first_name", "last_name", "university", "department")
)


@query("a13_last_non_null", f"SELECT source_url, {_LATEST} FROM {{@log}} GROUP BY source_url")
def a13(spark, d):
    return dedup.last_non_null(derived(spark, d, "{@log}"), "source_url", M.PROFILE_VALUES)


@query("m1_upsert_contacts", """
WITH c AS (SELECT *, sha256(concat(coalesce(source_url, ''), '|', coalesce(full_name, ''), '|', coalesce(email_found, ''), '|', coalesce(email_generated, ''))) AS id FROM {@stored})
SELECT id, min(seq) AS seq FROM c WHERE seq % 2 = 1 AND id NOT IN (SELECT id FROM c WHERE seq % 2 = 0) GROUP BY id""")
def m1(spark, d):
    """Rows to append when the odd-numbered half arrives after the even-numbered one."""
    rows = derived(spark, d, "{@stored}")
    stored = M.upsert_contacts(None, rows.filter("seq % 2 = 0"))
    return M.upsert_contacts(stored, rows.filter("seq % 2 = 1")).select("id", "seq")


@query("m2_upsert_profiles", """
SELECT source_url, """ + _LATEST.replace("seq)", "CASE WHEN seq % 3 = 0 THEN seq - 1000000000 ELSE seq END)") + " FROM {@log} GROUP BY source_url")
def m2(spark, d):
    """A third of the log is stored first; the rest is merged into it."""
    rows = derived(spark, d, "{@log}")
    stored = M.upsert_profiles(None, rows.filter("seq % 3 = 0"))
    return M.upsert_profiles(stored, rows.filter("seq % 3 <> 0"))


# -- joins ----------------------------------------------------------------------------------
@query("j1_contacts_with_profiles", """
SELECT c.seq, c.source_url, c.full_name, p.full_name AS prof_full_name, p.university AS prof_university, p.department AS prof_department
FROM {@stored} c LEFT JOIN {@profiles} p ON c.source_url = p.source_url""")
def j1(spark, d):
    out = M.with_profiles(derived(spark, d, "{@stored}"), derived(spark, d, "{@profiles}"))
    return out.select("seq", "source_url", "full_name", "prof_full_name", "prof_university", "prof_department")


@query("j2_department_lookup", """
SELECT c.seq, c.departamento, coalesce(m.nombre, c.departamento) AS departamento_clean FROM {@contacts} c LEFT JOIN {@dep_map} m ON m.dep_id = c.departamento""")
def j2(spark, d):
    return M.map_departments(derived(spark, d, "{@contacts}"), derived(spark, d, "{@dep_map}")).select("seq", "departamento", "departamento_clean")


_HALVES = "SELECT seq, email AS correo, profesor AS nombre FROM {@contacts} WHERE email IS NOT NULL"


@query("j3_add_unseen", f"""
WITH a AS ({_HALVES} AND seq % 4 = 0), b AS ({_HALVES} AND seq % 4 <> 0)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE correo NOT IN (SELECT correo FROM a)""")
def j3(spark, d):
    rows = derived(spark, d, _HALVES)
    return M.add_unseen(rows.filter("seq % 4 = 0"), rows.filter("seq % 4 <> 0"))


@query("j4_unseen_emails", f"""
WITH a AS ({_HALVES} AND seq % 4 = 0), b AS ({_HALVES} AND seq % 4 <> 0)
SELECT * FROM b WHERE correo NOT IN (SELECT correo FROM a)""")
def j4(spark, d):
    rows = derived(spark, d, _HALVES)
    return M.unseen(rows.filter("seq % 4 <> 0"), rows.filter("seq % 4 = 0"), "correo")


@query("j11_missing_ids", "SELECT DISTINCT departamento AS dep_id FROM {@contacts} WHERE departamento NOT IN (SELECT dep_id FROM {@dep_map})")
def j11(spark, d):
    return M.missing_keys(derived(spark, d, "{@contacts}"), derived(spark, d, "{@dep_map}"))


# -- sets -----------------------------------------------------------------------------------
@query("u1_union_all_tagged", "SELECT seq, email_found AS email, 'found' AS method FROM {@stored} WHERE email_found IS NOT NULL UNION ALL SELECT seq, email_generated, 'generated' FROM {@stored} WHERE email_generated IS NOT NULL")
def u1(spark, d):
    rows = derived(spark, d, "{@stored}")

    def part(column, method):
        return rows.filter(F.col(column).isNotNull()).select("seq", F.col(column).alias("email"), F.lit(method).alias("method"))

    return part("email_found", "found").unionByName(part("email_generated", "generated"))


@query("u2_append_departments", """
SELECT CAST(n_nationkey AS STRING) AS departamento, 'Departamento' AS profesor, concat(lower(n_name), '@mail0.example.com') AS email FROM {nation}
UNION ALL SELECT departamento, profesor, email FROM {@contacts} WHERE email IS NOT NULL""")
def u2(spark, d):
    """Mailboxes and people of all departments appended in one plan, with no loop over departments."""
    boxes = load(spark, d, "nation").select(
        F.col("n_nationkey").cast("string").alias("departamento"), F.lit("Departamento").alias("profesor"),
        F.concat(F.lower("n_name"), F.lit("@mail0.example.com")).alias("email"),
    )
    people = derived(spark, d, "{@contacts}").filter(F.col("email").isNotNull()).select(*boxes.columns)
    return boxes.unionByName(people)


@query("u3_union_distinct", "SELECT email_found AS email FROM {@stored} WHERE email_found IS NOT NULL UNION SELECT email_generated FROM {@stored} WHERE email_generated IS NOT NULL")
def u3(spark, d):
    rows = derived(spark, d, "{@stored}")
    both = rows.select(F.col("email_found").alias("email")).unionByName(rows.select(F.col("email_generated").alias("email")))
    return both.filter(F.col("email").isNotNull()).distinct()


DERIVED["new_map"] = "SELECT CAST(s_suppkey AS STRING) AS dep_id, s_name AS nombre FROM {supplier} WHERE s_suppkey % 3 = 0"


@query("u4_update_map", "SELECT coalesce(n.dep_id, o.dep_id) AS dep_id, coalesce(n.nombre, o.nombre) AS nombre FROM {@dep_map} o FULL JOIN {@new_map} n ON o.dep_id = n.dep_id")
def u4(spark, d):
    return M.update_map(derived(spark, d, "{@dep_map}"), derived(spark, d, "{@new_map}"))


@query("u5_difference", "SELECT c_custkey FROM {customer} EXCEPT SELECT user_id FROM {events}")
def u5(spark, d):
    keys = load(spark, d, "customer").select("c_custkey")
    return M.unseen(keys, load(spark, d, "events").select(F.col("user_id").alias("c_custkey")), "c_custkey")


# -- projections of the curated and CRM tables --------------------------------------------------
@query("p13_valid_emails", f"SELECT seq, {q.clean_email('email')} AS email_clean FROM {{@contacts}} WHERE {q.clean_email('email')} IS NOT NULL")
def p13(spark, d):
    return curate.cleaned(derived(spark, d, "{@contacts}")).select("seq", "email_clean")


@query("p14_rows_with_name", "SELECT seq, profesor FROM {@contacts} WHERE profesor IS NOT NULL")
def p14(spark, d):
    return sinks.with_name(derived(spark, d, "{@contacts}")).select("seq", "profesor")


@query("p17_reorder_and_rename", "SELECT email AS correo, profesor AS nombre, departamento AS dep FROM {@contacts}")
def p17(spark, d):
    named = curate.final_columns(derived(spark, d, "{@contacts}").select("seq", "email", "profesor", "departamento"), "departamento", "profesor", "email")
    return named.toDF("dep", "nombre", "correo")


@query("p18_prefix_columns", "SELECT source_url AS prof_source_url, full_name AS prof_full_name, first_name AS prof_first_name, last_name AS prof_last_name, university AS prof_university, department AS prof_department FROM {@profiles}")
def p18(spark, d):
    return M.prefixed(derived(spark, d, "{@profiles}"), "prof_")


_CRM_FROM = "FROM {@stored} c LEFT JOIN {@profiles} p ON c.source_url = p.source_url"
_W = q.words("coalesce(p.full_name, c.full_name)")
_NEED = f"coalesce(p.first_name, c.first_name) IS NULL AND coalesce(p.last_name, c.last_name) IS NULL AND len({_W}) >= 2"
_FIRST = f"CASE WHEN {_NEED} THEN ({_W})[1] ELSE coalesce(p.first_name, c.first_name) END"
_LAST = f"CASE WHEN {_NEED} THEN ({_W})[-1] ELSE coalesce(p.last_name, c.last_name) END"


def _joined(spark, d):
    return M.with_profiles(derived(spark, d, "{@stored}"), derived(spark, d, "{@profiles}"))


@query("p21_prefer_found_email", "SELECT seq, coalesce(email_found, email_generated) AS email FROM {@stored}")
def p21(spark, d):
    return crm.preferred_fields(_joined(spark, d)).select("seq", F.col("_email").alias("email"))


@query("p22_prefer_profile_fields", f"SELECT c.seq, coalesce(p.full_name, c.full_name) AS full_name, coalesce(p.first_name, c.first_name) AS first_name, coalesce(p.last_name, c.last_name) AS last_name {_CRM_FROM}")
def p22(spark, d):
    return _joined(spark, d).select("seq", *[crm.preferred(c).alias(c) for c in ("full_name", "first_name", "last_name")])


@query("p23_names_from_full_name", f"SELECT c.seq, {_FIRST} AS first_name, {_LAST} AS last_name {_CRM_FROM}")
def p23(spark, d):
    return crm.preferred_fields(_joined(spark, d)).select("seq", F.col("_first").alias("first_name"), F.col("_last").alias("last_name"))


@query("ud2_split_to_columns", f"SELECT c.seq, {_FIRST} AS first_name, {_LAST} AS last_name {_CRM_FROM}")
def ud2(spark, d):
    """One row function that yields two columns, as a native struct."""
    return p23(spark, d)


@query("p19_p24_crm_defaults", f"""
SELECT c.seq, coalesce(p.university, 'Default U') AS "Universidad", coalesce(p.department, '') AS "Departamento", 'FALSE' AS "Desuscrito", 'FALSE' AS "Enviado", 0 AS open_count, '' AS first_open {_CRM_FROM}""")
def p24(spark, d):
    j = _joined(spark, d)
    columns = crm.default_columns("Default U")
    return j.select("seq", *[columns[c].alias(c) for c in ("Universidad", "Departamento", "Desuscrito", "Enviado", "open_count", "first_open")])


@query("p25_fill_missing_names", f"SELECT seq, coalesce({q.clean_name('profesor')}, {q.infer(q.clean_email('email'))}) AS profesor_clean FROM {{@contacts}} WHERE {q.clean_email('email')} IS NOT NULL")
def p25(spark, d):
    return curate.with_inferred_names(curate.cleaned(derived(spark, d, "{@contacts}"))).select("seq", "profesor_clean")


@query("p20_method_and_confidence", """
SELECT k, email, method, confidence FROM (
  SELECT k, email, 'email_found_list' AS method, CAST(1.0 AS DOUBLE) AS confidence FROM {@people} UNION ALL
  SELECT k, CASE WHEN k % 9 IN (0, 1, 3, 5, 8) THEN concat(""" + f"substr({q.ascii_('lower(fn)')}, 1, 1), regexp_replace({q.ascii_('lower(ln)')}, '[^a-z0-9]', '', 'g')" + """, '@example.edu') END, 'card_name_generated',
         CAST(CASE WHEN k % 9 IN (0, 1, 3, 5, 8) THEN 0.5 ELSE 0.25 END AS DOUBLE)
  FROM (SELECT k, """ + f"({q.words('name')})[1] AS fn, ({q.words('name')})[-1] AS ln" + """ FROM {@names} WHERE k % 9 IN (0, 1, 2, 3, 4, 5, 8)))""")
def p20(spark, d):
    from ..plans import directory as PD

    found = PD.found_rows(derived(spark, d, "{@people}").withColumn("url", F.col("k").cast("string")), "email_found_list", "list page")
    names = derived(spark, d, "{@names}").filter(F.col("name") != "").select(F.col("k").cast("string").alias("url"), F.col("name").alias("full_name"))
    named = PD.named_rows(names, "example.edu", "card_name_generated", "name from list card", 0.5, 0.25)
    rows = PD.union_contacts(found, named)
    return rows.select(F.col("source_url").cast("long").alias("k"), F.coalesce("email_found", "email_generated").alias("email"), "method", "confidence")


@query("p28_mailbox_contacts", "SELECT CAST(dep AS STRING) AS departamento, 'Departamento' AS profesor, email FROM {@people} WHERE k % 5 <> 0")
def p28(spark, d):
    from .. import siteprofile as sp
    from ..operators import departments as DP

    cards = derived(spark, d, "{@people}").select(F.col("dep").cast("string").alias("dep"), F.when(F.col("k") % 5 != 0, F.col("email")).alias("mail"))
    return DP.mailbox_contacts(cards, "dep", sp.UC3M)
