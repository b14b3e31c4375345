"""The composed pipelines Q1-Q8 and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import emails as em
from ..functions import ids
from ..functions import text as t
from ..operators import dedup
from ..operators import extract as X
from ..operators import html as H
from ..operators import merge as M
from ..plans import crm, curate, departments, directory, email_index, quality
from . import graph, webs
from . import sqlkit as q
from .core import DERIVED, derived, query, scratch

SITE = webs.SITE

# -- flagship: addresses in all texts, one per person, in the CRM's shape ------------------------
DERIVED["first_seen"] = """
SELECT email, src FROM (SELECT email, src, row_number() OVER (PARTITION BY email ORDER BY src) AS rn FROM {@emails}) WHERE rn = 1"""
_LANG = "SELECT concat('doc:', CAST(doc_id AS STRING)) AS src, lang FROM {documents} UNION ALL SELECT concat('page:', CAST(page_id AS STRING)), 'page' FROM {pages}"


@query("flagship_contact_table", f"""
SELECT {q.uuid5('f.email')} AS id, coalesce({q.infer('f.email')}, '') AS "Nombre", f.email AS "Email", l.lang AS "Departamento", 'FALSE' AS "Desuscrito"
FROM {{@first_seen}} f JOIN ({_LANG}) l ON l.src = f.src ORDER BY f.email""")
def flagship(spark, d):
    """Documents and pages -> addresses -> first sighting -> inferred name -> CRM columns."""
    found = X.emails_in(derived(spark, d, "{@texts}"), "text", ("src",))
    first = dedup.first_per_key(found, "email", "src")
    joined = first.join(derived(spark, d, _LANG), "src")
    email = em.clean_email(F.col("email"))
    return joined.select(
        ids.crm_id(F.col("email"), F.lit(None).cast("string"), F.col("src")).alias("id"), F.coalesce(t.infer_name(email), F.lit("")).alias("Nombre"),
        F.col("email").alias("Email"), F.col("lang").alias("Departamento"), F.lit("FALSE").alias("Desuscrito"),
    ).orderBy("Email")


# -- Q1 -------------------------------------------------------------------------------------------
def _directory(spark, d):
    lists = webs.directory_lists(spark, d)
    return directory.extract_directory(lists.unionByName(webs.directory_profiles(spark, d)), lists.select("url"), SITE)


_GUESS = f"concat(substr({q.ascii_('lower(fn)')}, 1, 1), regexp_replace({q.ascii_('lower(ln)')}, '[^a-z0-9]', '', 'g'), '@example.edu')"
_Q1 = f"""
SELECT source_url, full_name, email_found, email_generated, method, confidence FROM (
  SELECT list_url AS source_url, NULL AS full_name, email AS email_found, NULL AS email_generated, 'email_found_list' AS method, CAST(1.0 AS DOUBLE) AS confidence FROM {{@cards}} WHERE k % 3 = 0
  UNION ALL SELECT list_url, name, NULL, {_GUESS}, 'card_name_generated', 0.5 FROM (SELECT DISTINCT list_url, name, ({q.words('name')})[1] AS fn, ({q.words('name')})[-1] AS ln FROM {{@cards}} WHERE len({q.words('name')}) BETWEEN 2 AND 4)
  UNION ALL SELECT link, NULL, concat('p', CAST(k AS STRING), '@example.edu'), NULL, 'email_found_profile', 1.0 FROM {{@cards}} WHERE link IS NOT NULL AND k % 7 <> 3 AND k % 2 = 0
  UNION ALL SELECT link, full_name, NULL, {_GUESS}, 'profile_name_generated', 0.6 FROM (SELECT link, full_name, ({q.words('full_name')})[1] AS fn, ({q.words('full_name')})[-1] AS ln FROM {{@cards}} WHERE link IS NOT NULL AND k % 7 <> 3))"""


@query("q1_directory_contacts", _Q1)
def q1_contacts(spark, d):
    return _directory(spark, d).contacts.select("source_url", "full_name", "email_found", "email_generated", "method", "confidence")


@query("q1_directory_profiles", f"""
SELECT link AS source_url, full_name, ({q.words('full_name')})[1] AS first_name, ({q.words('full_name')})[-1] AS last_name, 'Example University' AS university,
       CASE WHEN k % 5 < 3 THEN n_name END AS department FROM {{@cards}} JOIN {{nation}} ON n_nationkey = dep WHERE link IS NOT NULL AND k % 7 <> 3""")
def q1_profiles(spark, d):
    return _directory(spark, d).profiles


@query("a9_directory_counters", """
SELECT count(*) AS profiles_visited, count(*) FILTER (WHERE k % 2 = 0) AS emails_on_profiles FROM {@cards} WHERE link IS NOT NULL AND k % 7 <> 3""")
def a9_directory(spark, d):
    return directory.run_counters(_directory(spark, d))


# -- Q2 -------------------------------------------------------------------------------------------
_CRM_ID = f"CASE WHEN email <> '' THEN {q.uuid5('lower(trim(email))')} ELSE {q.uuid5('email_key')} END"
DERIVED["crm_best"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(email, ''), email_key) ORDER BY full_name IS NULL, confidence DESC, cid) AS rn FROM (
  SELECT c.*, p.university, p.department, coalesce(p.full_name, c.full_name0) AS full_name, coalesce(p.first_name, c.first_name0) AS f0, coalesce(p.last_name, c.last_name0) AS l0,
         coalesce(c.email_found, c.email_generated, '') AS email, concat(coalesce(p.full_name, c.full_name0, ''), '|', c.source_url) AS email_key
  FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY seq) AS rn0 FROM (SELECT seq, source_url, full_name AS full_name0, first_name AS first_name0, last_name AS last_name0, email_found, email_generated, confidence,
               sha256(concat(coalesce(source_url, ''), '|', coalesce(full_name, ''), '|', coalesce(email_found, ''), '|', coalesce(email_generated, ''))) AS cid FROM {@stored})) WHERE rn0 = 1) c
  LEFT JOIN {@profiles} p ON p.source_url = c.source_url)) WHERE rn = 1"""
_W = q.words("full_name")


def _crm_sql(where: str = "true") -> str:
    return f"""
SELECT {_CRM_ID} AS id, coalesce(CASE WHEN f0 IS NULL AND l0 IS NULL AND len({_W}) >= 2 THEN ({_W})[1] ELSE f0 END, '') AS "Nombre",
       coalesce(CASE WHEN f0 IS NULL AND l0 IS NULL AND len({_W}) >= 2 THEN ({_W})[-1] ELSE l0 END, '') AS "Apellidos", email AS "Email",
       coalesce(university, 'Default U') AS "Universidad", coalesce(department, '') AS "Departamento", 'FALSE' AS "Desuscrito", 'FALSE' AS "Enviado", 0 AS open_count,
       '' AS first_open, '' AS last_open, 0 AS click_count, '' AS first_click, '' AS last_click, '' AS last_ip, '' AS last_ua, '' AS last_clicked_url
FROM {{@crm_best}} WHERE {where}"""


def _stored_with_id(spark, d):
    """Stored contacts hold each row once, so the log is taken through M1 first."""
    return M.upsert_contacts(None, derived(spark, d, "{@stored}"))


@query("q2_crm_export", _crm_sql())
def q2(spark, d):
    return crm.export_crm(_stored_with_id(spark, d), derived(spark, d, "{@profiles}"), "Default U")


@query("w7_crm_dedup", "SELECT coalesce(nullif(email, ''), " + _CRM_ID + ") AS key, confidence FROM {@crm_best}")
def w7(spark, d):
    rows = crm.crm_rows(_stored_with_id(spark, d), derived(spark, d, "{@profiles}"), "Default U")
    best = dedup.best_crm_row(rows, ["_unnamed", "_doubt", "_cid"])
    return best.select(F.col("_k").alias("key"), (-F.col("_doubt")).alias("confidence"))


@query("q2_crm_export_found_only", _crm_sql("email_found IS NOT NULL").replace("{@crm_best}", "{@crm_found}"))
def q2_found(spark, d):
    """Published addresses only; guesses stay out of the export."""
    return crm.export_crm(_stored_with_id(spark, d), derived(spark, d, "{@profiles}"), "Default U", found_only=True)


DERIVED["crm_found"] = DERIVED["crm_best"].replace("WHERE rn0 = 1", "WHERE rn0 = 1 AND email_found IS NOT NULL")

# -- Q3 -------------------------------------------------------------------------------------------
# every link resolves against the main site, so the walk sees lists, cards, and what hangs off them
_MAIN = "https://www.example.edu"
DERIVED["index_pairs"] = f"""
SELECT mail AS email, dept_url AS url FROM {{@depts}} WHERE mail IS NOT NULL
UNION SELECT email, concat('{_MAIN}/listado/de/personal/', CAST(s AS STRING)) FROM {{@staff}} WHERE j = 0 AND s % 7 <> 3
UNION SELECT concat('web', CAST(s AS STRING), '@mail.example.edu'), concat('{_MAIN}/listado/de/personal/', CAST(s AS STRING)) FROM {{@staff}} WHERE j = 0 AND s % 7 <> 3 AND s % 2 = 0 AND layout IN (0, 2)"""


@query("q3_email_index", "SELECT email, string_agg(url, ' | ' ORDER BY url) AS found_on_urls FROM {@index_pairs} GROUP BY email")
def q3(spark, d):
    rules = derived(spark, d, "SELECT concat('d', CAST(s AS STRING), '.example.edu') AS host, '*' AS agent, '/' AS path_prefix, false AS allow, 1 AS rule_no FROM {@depts} UNION ALL SELECT 'www.example.edu', '*', '/private/', false, 1 FROM {@depts} WHERE s = 0")
    seeds = graph._site_seeds(spark, d).select("url", "seed_no")
    return email_index.email_index(webs.everything(spark, d), seeds, SITE, rules, None, "testbot/1.0").index.select("email", "found_on_urls")


# -- Q4 -------------------------------------------------------------------------------------------
DERIVED["q4_main"] = f"""
SELECT nombre, correo, dept_name AS departamento FROM {{@layout_contacts}} c JOIN {{@v2_depts}} v ON v.s = c.s WHERE c.j = 0 AND c.s % 7 <> 3
UNION ALL SELECT concat('Titular ', n_name), concat(lower(n_name), '@mail.example.edu'), (SELECT min_by(dept_name, s) FROM {{@v2_depts}} WHERE s % 4 = 0) FROM {{nation}}"""


@query("q4_department_contacts_by_structure", f"""
SELECT * FROM {{@q4_main}} UNION ALL SELECT {q.symbols('display')}, email, 'Varios' FROM {{@staff}} WHERE k % 4 = 0 AND email NOT IN (SELECT correo FROM {{@q4_main}})""")
def q4(spark, d):
    lists = webs.department_lists(spark, d).select("url")
    return departments.contacts_by_structure(webs.everything(spark, d), lists, webs.directory_pages(spark, d).select("url"), SITE).contacts


# -- Q5, Q6 ------------------------------------------------------------------------------------------
@query("q5_department_contacts_by_walk", """
SELECT CAST(s AS STRING) AS departamento, 'Departamento' AS profesor, mail AS email FROM {@depts} WHERE mail IS NOT NULL
UNION ALL SELECT CAST(s AS STRING), profesor, email FROM {@climbed} WHERE email NOT LIKE 'web%' AND s % 6 <> 5
UNION ALL SELECT DISTINCT CAST(s AS STRING), profesor, email FROM {@climbed} WHERE email LIKE 'web%' AND s % 6 <> 5""")
def q5(spark, d):
    return departments.contacts_by_walk(webs.everything(spark, d), webs.department_lists(spark, d).select("url"), SITE).contacts


DERIVED["q6_rows"] = f"""
SELECT dept_name AS departamento, 'Departamento' AS profesor, mail AS email FROM {{@v4_depts}} WHERE mail IS NOT NULL
UNION ALL SELECT DISTINCT dept_name, coalesce(profesor, {q.infer('email')}), email FROM {{@near}} n JOIN {{@v4_depts}} v ON v.s = n.s WHERE web IS NOT NULL"""


def _q6(spark, d):
    return departments.contacts_clean(webs.everything(spark, d), webs.department_lists(spark, d).select("url"), SITE)


@query("q6_department_contacts_clean", "SELECT * FROM {@q6_rows}")
def q6(spark, d):
    return _q6(spark, d).contacts


@query("a9_department_counters", """
SELECT count(*) AS total_registros, count(DISTINCT email) AS emails_unicos, count(*) FILTER (WHERE profesor <> 'Departamento') AS con_nombre,
       count(*) FILTER (WHERE coalesce(profesor, 'Departamento') = 'Departamento') AS sin_nombre, count(*) FILTER (WHERE profesor = 'Departamento') AS emails_departamento,
       count(*) FILTER (WHERE coalesce(profesor, '') <> 'Departamento') AS emails_personal, (SELECT count(*) FROM {@v4_depts}) AS departamentos,
       (SELECT count(*) FROM {@v4_depts} WHERE web IS NULL) AS sin_web FROM {@q6_rows}""")
def a9_departments(spark, d):
    return departments.run_summary(_q6(spark, d), SITE)


# -- Q7, Q8 ------------------------------------------------------------------------------------------
DERIVED["curated"] = f"""
SELECT coalesce(m.nombre, b.departamento) AS departamento, b.name AS profesor, b.e AS email FROM (
  SELECT *, row_number() OVER (PARTITION BY e ORDER BY name ASC NULLS LAST, seq) AS rn FROM (
    SELECT seq, departamento, coalesce({q.clean_name('profesor')}, {q.infer('e')}) AS name, e FROM (SELECT *, {q.clean_email('email')} AS e FROM {{@contacts}}) WHERE e IS NOT NULL)) b
LEFT JOIN {{@dep_map}} m ON m.dep_id = b.departamento WHERE rn = 1"""


def _curated(spark, d):
    return curate.curate(derived(spark, d, "{@contacts}"), derived(spark, d, "{@dep_map}"))


@query("q7_curate", "SELECT * FROM {@curated} ORDER BY departamento, profesor NULLS LAST, email")
def q7(spark, d):
    return _curated(spark, d)


DERIVED["full_map"] = """
SELECT dep_id, nombre FROM {@dep_map} WHERE dep_id NOT IN (SELECT dep_id FROM {@new_map}) UNION ALL SELECT dep_id, nombre FROM {@new_map}
UNION ALL SELECT DISTINCT departamento, concat('Departamento_', departamento) FROM {@contacts}
  WHERE departamento NOT IN (SELECT dep_id FROM {@dep_map}) AND departamento NOT IN (SELECT dep_id FROM {@new_map})"""


@query("q7_complete_map", "SELECT dep_id, nombre FROM {@full_map}")
def q7_map(spark, d):
    """The map after the list page's names and the generated ones came in."""
    return M.complete_map(derived(spark, d, "{@dep_map}"), derived(spark, d, "{@new_map}"), None, derived(spark, d, "{@contacts}"))


DERIVED["refreshed_map"] = """
SELECT dep_id, nombre FROM {@list_map} UNION ALL SELECT dep_id, nombre FROM {@dep_map} WHERE dep_id NOT IN (SELECT dep_id FROM {@list_map})
UNION ALL SELECT g.dep_id, coalesce(p.nombre, concat('Departamento_', g.dep_id)) AS nombre FROM (
  SELECT DISTINCT departamento AS dep_id FROM {@contacts} WHERE departamento NOT IN (SELECT dep_id FROM {@list_map}) AND departamento NOT IN (SELECT dep_id FROM {@dep_map})) g
LEFT JOIN (SELECT CAST(s AS STRING) AS dep_id, name AS nombre FROM {@depts}) p ON p.dep_id = g.dep_id"""
DERIVED["list_map"] = """
SELECT CAST(s AS STRING) AS dep_id, CASE WHEN s % 3 = 0 THEN concat(name, ' bis') ELSE name END AS nombre FROM {@depts} WHERE s % 3 = 0 OR s % 10 <> 7"""
DERIVED["curated_refreshed"] = DERIVED["curated"].replace("{@dep_map}", "{@refreshed_map}")


def _refreshed(spark, d):
    docs = H.dom(webs.department_lists(spark, d)), H.dom(webs.department_cards(spark, d))
    return derived(spark, d, "{@contacts}"), derived(spark, d, "{@dep_map}"), *docs, SITE


@query("q7_refreshed_map", "SELECT dep_id, nombre FROM {@refreshed_map}")
def q7_pages(spark, d):
    """The map after list names, names of single pages and generated ones."""
    return curate.refreshed_map(*_refreshed(spark, d))


@query("q7_curate_and_refresh", "SELECT * FROM {@curated_refreshed} ORDER BY departamento, profesor NULLS LAST, email")
def q7_whole(spark, d):
    """One pipeline: the map is brought up to date from pages, stored, and used."""
    return curate.curate_and_refresh(*_refreshed(spark, d), scratch(spark))


_FIG = "SELECT 'summary' AS section, '{0}' AS item, CAST({1} AS DOUBLE) AS value FROM {{@curated}}"
_GLUED = "regexp_matches(email, '\\.(ficha|basic|alvarado|anton)')"
_FOREIGN = "NOT (split_part(email, '@', 2) = 'mail1.example.com' OR split_part(email, '@', 2) LIKE '%.mail1.example.com')"


@query("q8_quality_report", " UNION ALL ".join([
    _FIG.format("total_registros", "count(*)"), _FIG.format("profesores_con_nombre", "count(profesor)"), _FIG.format("profesores_sin_nombre", "count(*) - count(profesor)"),
    _FIG.format("departamentos_unicos", "count(DISTINCT departamento)"), _FIG.format("emails_unicos", "count(DISTINCT email)"),
    _FIG.format("foreign_emails", f"count(*) FILTER (WHERE {_FOREIGN})"), _FIG.format("malformed_emails", f"count(*) FILTER (WHERE {_GLUED})"),
    "SELECT 'coverage', departamento, round_even(100.0::DOUBLE * count(profesor) / count(*), 1) FROM {@curated} WHERE departamento IS NOT NULL GROUP BY departamento",
    "SELECT 'size', departamento, CAST(count(email) AS DOUBLE) FROM {@curated} WHERE departamento IS NOT NULL GROUP BY departamento",
]))
def q8(spark, d):
    return quality.quality_report(_curated(spark, d), "mail1.example.com")
