"""Structure-aware extraction (X11, X13-X32) over page tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import association as A
from ..operators import departments as DP
from ..operators import directory as D
from ..operators import extract as X
from ..operators import html as H
from ..operators import staff
from . import sqlkit as q
from . import webs
from .core import DERIVED, derived, pages_of, query

SITE = webs.SITE


def _wc(x: str) -> str:
    return f"len({q.words(x)})"


# -- directory -----------------------------------------------------------------------------
@query("x13_card_names", f"SELECT DISTINCT page AS page_id, name AS full_name FROM {{@cards}} WHERE {_wc('name')} BETWEEN 2 AND 4")
def x13(spark, d):
    return D.card_names(H.dom(webs.directory_lists(spark, d)), ("page_id",))


@query("x14_card_links", "SELECT page AS page_id, link FROM {@cards} WHERE link IS NOT NULL")
def x14(spark, d):
    return D.card_links(H.dom(webs.directory_lists(spark, d)), SITE.domain).select("page_id", "link")


_PROFILE = "SELECT link AS url, {c} FROM {{@cards}} JOIN {{nation}} ON n_nationkey = dep WHERE link IS NOT NULL AND k % 7 <> 3"


@query("x15_profile_titles", _PROFILE.format(c="full_name"))
def x15_profiles(spark, d):
    return H.dom(webs.directory_profiles(spark, d)).select("url", D.page_title().alias("full_name"))


@query("x16_profile_departments", _PROFILE.format(c="CASE WHEN k % 5 < 3 THEN n_name ELSE '' END AS department"))
def x16(spark, d):
    return H.dom(webs.directory_profiles(spark, d)).select("url", D.page_department().alias("department"))


@query("x7_directory_emails", """
SELECT page AS page_id, email FROM {@cards} WHERE k % 3 = 0""")
def x7_directory(spark, d):
    return X.emails_at_domain(webs.directory_lists(spark, d), SITE.domain, ("page_id",))


# -- departments -----------------------------------------------------------------------------
DERIVED["v2_depts"] = """
SELECT s, page, dept_url, CASE WHEN s % 3 = 0 THEN concat(name, ' bis') ELSE name END AS dept_name FROM {@depts} WHERE s % 4 <> 2 AND (s % 3 = 0 OR s % 10 <> 7)"""
DERIVED["v4_depts"] = """
SELECT s, page, dept_url, CASE WHEN s % 10 <> 7 THEN name ELSE concat(name, ' bis') END AS dept_name, mail, web FROM {@depts} WHERE s % 10 <> 7 OR s % 3 = 0"""


@query("x17_departments_by_keyword", "SELECT dept_url, dept_name FROM {@v2_depts}")
def x17(spark, d):
    return DP.by_keyword(H.dom(webs.department_lists(spark, d)), SITE).select("dept_url", "dept_name")


@query("x18_departments_by_marker", "SELECT dept_url FROM {@depts}")
def x18(spark, d):
    return DP.by_marker(H.dom(webs.department_lists(spark, d)), SITE)


@query("x19_departments_with_names", "SELECT dept_url, dept_name FROM {@v4_depts}")
def x19(spark, d):
    return DP.by_marker_named(H.dom(webs.department_lists(spark, d)), SITE).select("dept_url", "dept_name")


@query("x20_department_ids", "SELECT CAST(s AS STRING) AS dep_id, CASE WHEN s % 3 = 0 THEN concat(name, ' bis') ELSE name END AS nombre FROM {@depts} WHERE s % 3 = 0 OR s % 10 <> 7")
def x20(spark, d):
    return DP.id_names(H.dom(webs.department_lists(spark, d)), SITE)


@query("x21_department_page_names", "SELECT CAST(s AS STRING) AS dep_id, name AS nombre FROM {@depts}")
def x21_pages(spark, d):
    return DP.single_page_names(H.dom(webs.department_cards(spark, d)), SITE)


@query("x22_department_cards", "SELECT dept_url AS url, mail, web FROM {@depts}")
def x22(spark, d):
    return DP.cards(H.dom(webs.department_cards(spark, d)), SITE, ("url",))


@query("x22_department_mail_text", "SELECT dept_url AS url, CASE WHEN mail IS NOT NULL THEN 'writetous' END AS mail FROM {@depts}")
def x22_text(spark, d):
    """The earlier variant: the mail link's text instead of its target."""
    cards = DP.cards(H.dom(webs.department_cards(spark, d)), SITE, ("url",), from_text=True)
    return cards.select("url", F.replace("mail", F.lit(" "), F.lit("")).alias("mail"))


@query("x11_mailto_emails", "SELECT dept_url AS url, mail AS email FROM {@depts} WHERE mail IS NOT NULL")
def x11(spark, d):
    return X.mailto_emails(H.dom(webs.department_cards(spark, d)), ("url",)).select("url", "email")


_PATTERN = "https://www.example.edu/ss/Satellite/DeptEconomia/es/ListadoPersonalDept/1371321047774/Profesores_Titulares"
DERIVED["v2_staff"] = f"""
SELECT s, dept_url, dept_name, concat('https://www.example.edu/listado/de/personal/', CAST(s AS STRING)) AS staff_url FROM {{@v2_depts}} WHERE s % 7 <> 3
UNION ALL SELECT s, dept_url, dept_name, '{_PATTERN}' FROM {{@v2_depts}} WHERE s % 4 = 0
UNION ALL SELECT s, dept_url, dept_name, dept_url FROM {{@v2_depts}} WHERE s % 7 = 3 AND s % 4 <> 0"""


@query("x23_staff_pages", "SELECT dept_url, dept_name, staff_url FROM {@v2_staff}")
def x23(spark, d):
    depts = DP.by_keyword(H.dom(webs.department_lists(spark, d)), SITE)
    return DP.staff_pages(depts, H.dom(webs.department_cards(spark, d)), H.dom(webs.listed_staff_pages(spark, d)), SITE)


@query("j8_existing_contact_pages", f"SELECT dept_url, '{_PATTERN}' AS staff_url FROM {{@depts}} WHERE s % 4 = 0")
def j8(spark, d):
    depts = derived(spark, d, "{@depts}")
    guesses = depts.select("dept_url", F.explode(DP.pattern_urls(F.col("name"), SITE)).alias("staff_url"))
    return DP.existing_contact_pages(guesses, H.dom(webs.listed_staff_pages(spark, d)), SITE)


# -- whose address is this: page layout ----------------------------------------------------------
_TAIL = q.symbols("concat('Prof. ', display, ':')")
_BLOCK_NAME = f"CASE WHEN k % 2 = 0 THEN display WHEN {_wc(_TAIL)} > 4 THEN array_to_string(({q.words(_TAIL)})[-4:], ' ') ELSE {_TAIL} END"
_WEB = "s % 2 = 0 AND layout IN (0, 2)"
_WEB_ROWS = "SELECT DISTINCT s, j, layout, url, concat('web', CAST(s AS STRING), '@mail.example.edu') AS email FROM {@staff} WHERE " + _WEB

DERIVED["layout_contacts"] = f"""
SELECT s, j, k, url, CASE layout WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END AS branch,
       CASE layout WHEN 1 THEN {q.symbols("concat(display, ',')")} WHEN 2 THEN {_BLOCK_NAME} ELSE {q.symbols('display')} END AS nombre, email AS correo
FROM {{@staff}} WHERE layout <> 4
UNION ALL SELECT s, j, NULL, url, 2, 'Webmaster one', email FROM ({_WEB_ROWS}) WHERE layout = 2"""


def _staff_doc(spark, d):
    return H.dom(webs.staff_pages(spark, d))


@query("x24_table_row_contacts", f"SELECT url, CAST(idx AS INT) AS idx, {q.symbols('display')} AS nombre, email AS correo FROM {{@staff}} WHERE layout = 0")
def x24(spark, d):
    return staff.branch_contacts(_staff_doc(spark, d), staff.row_contacts(), ("url",))


@query("x25_list_item_contacts", f"""
SELECT url, CAST(idx AS INT) AS idx, {q.symbols("concat(display, ',')")} AS nombre, email AS correo FROM {{@staff}} WHERE layout = 1
UNION ALL SELECT url, 0, 'Webmaster one', email FROM ({_WEB_ROWS})""")
def x25(spark, d):
    return staff.branch_contacts(_staff_doc(spark, d), staff.list_contacts(), ("url",))


@query("x26_profile_block_contacts", f"SELECT url, {_BLOCK_NAME} AS nombre, email AS correo FROM {{@staff}} WHERE layout = 2")
def x26(spark, d):
    return staff.branch_contacts(_staff_doc(spark, d), staff.block_contacts(), ("url",)).drop("idx").distinct()


@query("x27_free_text_contacts", f"SELECT url, CAST(idx AS INT) AS idx, {q.symbols('display')} AS nombre, email AS correo FROM {{@staff}} WHERE layout = 3")
def x27(spark, d):
    """Plain text, on pages where the layout branches find nothing."""
    doc = _staff_doc(spark, d)
    found = F.size(staff.row_contacts()) + F.size(staff.list_contacts()) + F.size(staff.block_contacts())
    return staff.branch_contacts(doc.filter(found == 0), staff.free_text_contacts(), ("url",))


@query("x31_page_contacts", "SELECT url, branch, nombre, correo FROM {@layout_contacts}")
def x31(spark, d):
    return staff.page_contacts(_staff_doc(spark, d), ("url",)).select("url", "branch", "nombre", "correo")


@query("ud5_html_to_rows", "SELECT url, branch, nombre, correo FROM {@layout_contacts}")
def ud5(spark, d):
    """HTML in, many contact rows out: one parsing step, the rest native."""
    return x31(spark, d)


@query("p30_directory_contacts", f"SELECT {q.symbols('display')} AS nombre, email AS correo, 'Varios' AS departamento FROM {{@staff}} WHERE k % 4 = 0")
def p30(spark, d):
    from ..plans import departments as P

    return P.directory_contacts(H.dom(webs.directory_pages(spark, d)), SITE)


# -- whose address is this: climbing -----------------------------------------------------------------
_CLIMB = f"""CASE layout
  WHEN 0 THEN CASE WHEN {_wc('display')} >= 3 THEN display WHEN k % 2 = 1 THEN concat(display, '  x') END
  WHEN 1 THEN CASE WHEN {_wc('display')} >= 3 THEN concat(display, ',') END
  WHEN 2 THEN CASE WHEN k % 2 = 1 THEN concat('Prof. ', display, ':') WHEN {_wc('display')} >= 3 THEN display END
  WHEN 4 THEN concat(display, ' e-mail') END"""
DERIVED["climbed"] = f"""
SELECT s, j, url, CASE WHEN layout = 4 THEN 1 ELSE 2 END AS branch, {_CLIMB} AS profesor, email FROM {{@staff}}
UNION ALL SELECT s, j, url, 2, NULL, email FROM ({_WEB_ROWS})"""

_NEAR = f"""CASE layout WHEN 1 THEN {q.normal_name("concat(display, ',')")} WHEN 3 THEN NULL
  WHEN 2 THEN CASE WHEN k % 2 = 1 THEN {q.normal_name("concat('Prof. ', display, ':')")} ELSE {q.normal_name('display')} END
  ELSE {q.normal_name('display')} END"""
DERIVED["near"] = f"""
SELECT s, j, k, url, CASE WHEN layout = 4 THEN 1 ELSE 2 END AS branch, {_NEAR} AS profesor, email FROM {{@staff}} WHERE k % 7 <> 0
UNION ALL SELECT s, j, NULL, url, 2, 'Webmaster One', email FROM ({_WEB_ROWS})"""


@query("x28_climbed_names", "SELECT url, branch, profesor, email FROM {@climbed}")
def x28(spark, d):
    return A.climbed_contacts(_staff_doc(spark, d), ("url",)).select("url", "branch", "profesor", "email")


@query("j5_new_text_emails", "SELECT s, branch, email FROM {@climbed} WHERE email NOT LIKE 'web%' UNION ALL SELECT DISTINCT s, 2, email FROM {@climbed} WHERE email LIKE 'web%'")
def j5(spark, d):
    """A text address only where its department has not shown it before."""
    rows = A.climbed_contacts(_staff_doc(spark, d), ("url",))
    rows = rows.withColumn("s", F.regexp_extract("url", r"//d(\d+)\.", 1).cast("long"))
    return A.drop_known_text_emails(rows, "s", ["url", "branch", "idx"]).select("s", "branch", "email")


@query("x29_near_names", "SELECT url, branch, profesor, email FROM {@near}")
def x29(spark, d):
    return A.near_names(_staff_doc(spark, d), SITE.email_domains, ("url",), SITE.strict).filter(F.col("branch") < 3).select("url", "branch", "profesor", "email")


@query("x30_staff_table_rows", f"SELECT url, CASE WHEN k % 2 = 0 THEN {q.normal_name('display')} END AS profesor, email FROM {{@staff}} WHERE layout = 0 AND k % 7 <> 0")
def x30(spark, d):
    return A.near_names(_staff_doc(spark, d), SITE.email_domains, ("url",), SITE.strict).filter(F.col("branch") == 3).select("url", "profesor", "email")


@query("x32_page_contacts", f"SELECT url, branch, coalesce(profesor, {q.infer('email')}) AS profesor, email FROM {{@near}}")
def x32(spark, d):
    return A.page_contacts(_staff_doc(spark, d), SITE.email_domains, ("url",), strict=SITE.strict).select("url", "branch", "profesor", "email")


# -- containment and neighbours on the given pages ------------------------------------------------------
@query("j10_subtree_members", r"""
SELECT page_id, root, len(regexp_extract_all(nav, '<a href=')) AS links FROM (
  SELECT page_id, unnest(['nav', 'ul']) AS root, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM {pages}) WHERE nav <> ''""")
def j10(spark, d):
    dom = H.nodes(H.dom(pages_of(spark, d))).select("page_id", "node_id", "last_id", "tag")
    roots = dom.filter(F.col("tag").isin("nav", "ul"))
    links = H.subtree_members(dom.filter(F.col("tag") == "a"), roots)
    named = links.join(roots.select("page_id", F.col("node_id").alias("root_id"), F.col("tag").alias("root")), ["page_id", "root_id"])
    return named.groupBy("page_id", "root").agg(F.count("*").alias("links"))
