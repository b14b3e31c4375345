"""Scalar functions (F*) and predicates (P*) over names, addresses and URLs of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import siteprofile as sp
from ..functions import emails as em
from ..functions import ids
from ..functions import text as t
from ..functions import urls as u
from ..operators import departments as DP
from ..operators import html as H
from ..operators import merge as M
from ..plans import quality
from . import sqlkit as q
from .core import DERIVED, derived, load, query


def _text_query(name: str, expr, sql_expr: str, source: str = "names", key: str = "k", column: str = "name") -> None:
    @query(name, f"SELECT {key}, {sql_expr} AS result FROM {{@{source}}}")
    def run(spark, d):
        return derived(spark, d, f"{{@{source}}}").select(key, expr(F.col(column)).alias("result"))


# -- names ---------------------------------------------------------------------------
_text_query("f5_to_ascii", t.to_ascii, q.ascii_("name"))
_text_query("f6_normalize_name", t.normalize_name, q.normal_name("name"))
_text_query("f6b_clean_name", t.clean_name, q.clean_name("name"))
_text_query("f12_title_case", t.title_case, f"CASE WHEN name IS NOT NULL THEN coalesce({q.title('name')}, '') END")
_text_query("f13_strip_symbols", t.strip_symbols, q.symbols("name"))
_text_query("f14_collapse_whitespace", t.collapse_ws, q.squeeze("name"))
_text_query("f15_last_words", t.last_words, f"array_to_string(({q.words('name')})[greatest(len({q.words('name')}) - 3, 1):], ' ')")
_text_query("f18_capitalize", t.capitalize, "upper(substr(name, 1, 1)) || lower(substr(name, 2))")
_text_query("f19_word_count", t.word_count, f"CAST(len({q.words('name')}) AS INT)")
_text_query("f20_short_key", t.short_key, "translate(" + q.ascii_("lower(name)") + ", ' :,', '')")
_text_query("p15_name_length", t.good_name_length, "length(name) BETWEEN 3 AND 99")


@query("f3_split_first_last", f"""
SELECT k, CASE WHEN len({q.words('name')}) >= 2 THEN ({q.words('name')})[1] END AS first_name,
       CASE WHEN len({q.words('name')}) >= 2 THEN ({q.words('name')})[-1] END AS last_name FROM {{@names}}""")
def f3_split(spark, d):
    return derived(spark, d, "{@names}").select("k", t.split_first_last(F.col("name")).alias("s")).select("k", "s.*")


@query("f4_generate_email", f"""
SELECT k, concat(substr({q.ascii_('lower(first_name)')}, 1, 1), regexp_replace({q.ascii_('lower(last_name)')}, '[^a-z0-9]', '', 'g'), '@example.edu') AS email
FROM {{@people}}""")
def f4_generate(spark, d):
    return derived(spark, d, "{@people}").select("k", em.generate_email(F.col("first_name"), F.col("last_name"), "example.edu").alias("email"))


@query("p16_plausible_lines", r"""
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE length(l) BETWEEN 3 AND 99 AND NOT contains(l, '@')
       AND NOT regexp_matches(regexp_replace(l, '[.,\-]', '', 'g'), '^\p{N}+$')
       AND NOT regexp_matches(lower(l), '^(email|correo|tel|phone|fax)')) AS plausible
FROM (SELECT doc_id, """ + q.strip("unnest(string_split(text, chr(10)))") + r""" AS l FROM {documents}) GROUP BY doc_id""")
def p16_plausible(spark, d):
    lines = load(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    lines = lines.withColumn("l", t.strip(F.col("l")))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(t.plausible_line(F.col("l"))).alias("plausible"))


@query("f16_text_before", """
SELECT doc_id, substr(text, 1, position(lower(e) IN lower(text)) - 1) AS before
FROM (SELECT doc_id, text, regexp_extract(text, '""" + q.TEXT_EMAIL + """', 0) AS e FROM {documents}) WHERE e <> ''""")
def f16_before(spark, d):
    rows = load(spark, d, "documents").select("doc_id", "text", em.find_all(F.col("text")).alias("es")).filter(F.size("es") > 0)
    return rows.select("doc_id", t.text_before(F.col("text"), F.col("es")[0]).alias("before"))


@query("f17_text_without", "SELECT doc_id, " + q.strip("replace(text, e, '')") + """ AS rest
FROM (SELECT doc_id, text, regexp_extract(text, '""" + q.TEXT_EMAIL + """', 0) AS e FROM {documents}) WHERE e <> ''""")
def f17_without(spark, d):
    rows = load(spark, d, "documents").select("doc_id", "text", em.find_all(F.col("text")).alias("es")).filter(F.size("es") > 0)
    return rows.select("doc_id", t.text_without(F.col("text"), F.col("es")[0]).alias("rest"))


# -- addresses -----------------------------------------------------------------------
@query("f1_clean_email", f"SELECT seq, {q.clean_email('email')} AS email_clean FROM {{@contacts}}")
def f1_clean(spark, d):
    return derived(spark, d, "{@contacts}").select("seq", em.clean_email(F.col("email")).alias("email_clean"))


@query("f2_clean_domain_email", f"""
SELECT seq, CASE WHEN contains(e, '@mail1.example.com') OR contains(e, '@mail2.example.com') THEN e END AS email_clean
FROM (SELECT seq, {q.clean_email('email')} AS e FROM {{@contacts}})""")
def f2_clean(spark, d):
    """The loose rule, which lets longer endings pass."""
    c = em.clean_domain_email(F.col("email"), ("mail1.example.com", "mail2.example.com"), strict=False)
    return derived(spark, d, "{@contacts}").select("seq", c.alias("email_clean"))


@query("f7_infer_name", f"SELECT seq, {q.infer('e')} AS name FROM (SELECT seq, {q.clean_email('email')} AS e FROM {{@contacts}})")
def f7_infer(spark, d):
    return derived(spark, d, "{@contacts}").select("seq", t.infer_name(em.clean_email(F.col("email"))).alias("name"))


@query("ud1_row_functions", f"""
SELECT seq, {q.clean_email('email')} AS email_clean, {q.clean_name('profesor')} AS profesor_clean FROM {{@contacts}}""")
def ud1_row_functions(spark, d):
    """The per-row functions, as native expressions."""
    rows = derived(spark, d, "{@contacts}")
    return rows.select("seq", em.clean_email(F.col("email")).alias("email_clean"), t.clean_name(F.col("profesor")).alias("profesor_clean"))


@query("p10_institution_domain", f"""
SELECT seq, e AS email FROM (SELECT seq, {q.clean_email('email')} AS e FROM {{@contacts}})
WHERE split_part(e, '@', 2) IN ('mail1.example.com', 'mail2.example.com')""")
def p10_domain(spark, d):
    rows = derived(spark, d, "{@contacts}").select("seq", em.clean_email(F.col("email")).alias("email"))
    return rows.filter(em.at_domains(F.col("email"), ("mail1.example.com", "mail2.example.com")))


@query("p11_foreign_domain", f"""
SELECT seq, e AS email FROM (SELECT seq, {q.clean_email('email')} AS e FROM {{@contacts}})
WHERE e IS NOT NULL AND NOT (split_part(e, '@', 2) = 'mail1.example.com' OR split_part(e, '@', 2) LIKE '%.mail1.example.com')""")
def p11_foreign(spark, d):
    rows = derived(spark, d, "{@contacts}").select("seq", em.clean_email(F.col("email")).alias("email")).filter(F.col("email").isNotNull())
    return quality.foreign_contacts(rows, "mail1.example.com")


# -- ids -----------------------------------------------------------------------------
@query("f10_contact_id", """
SELECT seq, sha256(concat(coalesce(source_url, ''), '|', coalesce(full_name, ''), '|', coalesce(email_found, ''), '|', coalesce(email_generated, ''))) AS id
FROM {@stored}""")
def f10_id(spark, d):
    return M.with_contact_id(derived(spark, d, "{@stored}")).select("seq", "id")


_CRM_KEY = "CASE WHEN coalesce(email_found, email_generated, '') <> '' THEN lower(trim(coalesce(email_found, email_generated))) ELSE concat(coalesce(full_name, ''), '|', source_url) END"


@query("f11_crm_id", f"SELECT seq, {q.uuid5('key')} AS id FROM (SELECT seq, {_CRM_KEY} AS key FROM {{@stored}})")
def f11_id(spark, d):
    rows = derived(spark, d, "{@stored}")
    return rows.select("seq", ids.crm_id(F.coalesce("email_found", "email_generated"), F.col("full_name"), F.col("source_url")).alias("id"))


query("ud3_row_id", f"SELECT seq, {q.uuid5('key')} AS id FROM (SELECT seq, {_CRM_KEY} AS key FROM {{@stored}})")(f11_id)


# -- URLs ----------------------------------------------------------------------------
# every anchor of the page table, resolved against its page
DERIVED["anchors"] = r"""
SELECT page_id, url, pos, replace(href, '&amp;', '&') AS href FROM (
  SELECT page_id, url, unnest(range(len(hs))) AS pos, unnest(hs) AS href
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs FROM {pages}))"""
# page URLs against each other: absolute, scheme-relative, rooted, relative, dotted, query, fragment, empty
_HREF_CASES = ("//cdn.example.org/x", "/root/page", "child/page", "../up", "./same?q=1", "?page=3", "#top", "", "mailto:a@b.cc", "a/../b/./c", "https://other.example.net/z#f")
DERIVED["hrefs"] = "\nUNION ALL ".join(
    f"SELECT page_id, url, '{h}' AS href, {i} AS case_no FROM {{pages}}" for i, h in enumerate(_HREF_CASES)
)
_ROOT = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"
_DIR = "regexp_extract(url, '^https?://[^/?#]*([^?#]*/)', 1)"
_UP = "regexp_extract(regexp_extract(url, '^https?://[^/?#]*([^?#]*/)', 1), '^(.*/)[^/]*/$', 1)"
_NO_FRAG = "regexp_extract(url, '^([^#]*)', 1)"
_NO_QUERY = "regexp_extract(url, '^([^?#]*)', 1)"
_JOINED = f"""CASE case_no
  WHEN 0 THEN concat(regexp_extract(url, '^(https?:)', 1), href) WHEN 1 THEN concat({_ROOT}, href)
  WHEN 2 THEN concat({_ROOT}, {_DIR}, href) WHEN 3 THEN concat({_ROOT}, CASE WHEN {_UP} = '' THEN '/' ELSE {_UP} END, 'up')
  WHEN 4 THEN concat({_ROOT}, {_DIR}, 'same?q=1') WHEN 5 THEN concat({_NO_QUERY}, href) WHEN 6 THEN concat({_NO_FRAG}, href)
  WHEN 7 THEN url WHEN 9 THEN concat({_ROOT}, {_DIR}, 'b/c') ELSE href END"""


@query("f8_netloc", f"SELECT page_id, {q.netloc('url')} AS netloc FROM {{pages}}")
def f8_netloc(spark, d):
    return load(spark, d, "pages").select("page_id", u.netloc(F.col("url")).alias("netloc"))


@query("f9_url_join", f"SELECT page_id, case_no, {_JOINED} AS joined FROM {{@hrefs}}")
def f9_join(spark, d):
    return derived(spark, d, "{@hrefs}").select("page_id", "case_no", u.url_join(F.col("url"), F.col("href")).alias("joined"))


def _anchors(spark, d):
    links = H.anchor_links(load(spark, d, "pages"))
    return links.withColumn("target", u.url_join(F.col("url"), F.col("href")))


_TARGET = f"concat({_ROOT}, href)"  # every href of the page table is rooted


@query("p1_registered_domain", """
SELECT page_id, concat(split_part(h, '.', -2), '.', split_part(h, '.', -1)) AS domain, h LIKE '%.example.com' AS same
FROM (SELECT page_id, lower(""" + q.netloc("url") + """) AS h FROM {pages})""")
def p1_domain(spark, d):
    url = F.col("url")
    return load(spark, d, "pages").select("page_id", u.registered_domain(url).alias("domain"), u.same_registered_domain(url, "example.com").alias("same"))


def _page_filter(name: str, predicate, sql: str) -> None:
    @query(name, f"SELECT page_id, url FROM {{pages}} WHERE {sql}")
    def run(spark, d):
        return load(spark, d, "pages").select("page_id", "url").filter(predicate(F.col("url")))


def _anchor_filter(name: str, predicate, sql: str) -> None:
    @query(name, f"SELECT page_id, pos, href FROM {{@anchors}} WHERE {sql}")
    def run(spark, d):
        return _anchors(spark, d).filter(predicate()).select("page_id", F.col("pos").cast("long").alias("pos"), "href")


_page_filter("p2_internal_url", lambda c: u.is_internal(c, "example.com"), f"{q.netloc('url')} = 'example.com' OR {q.netloc('url')} LIKE '%.example.com'")
_page_filter("p3_under_base", lambda c: u.under_base(c, "https://www."), "url LIKE 'https://www.%'")
_page_filter("p5_mentions_domain", lambda c: u.mentions_domain(c, "example.org"), "contains(url, 'example.org')")
_anchor_filter("p4_same_host", lambda: u.same_host(F.col("target"), F.col("url")), f"{q.netloc(_TARGET)} = {q.netloc('url')}")
_anchor_filter("p7_usable_href", lambda: u.usable_href(F.col("href")), "href <> '' AND NOT href LIKE '#%'")
_anchor_filter("p8_keyword_link", lambda: u.has_keyword(("the", "tion", "sch"), F.col("href")), "contains(lower(href), 'the') OR contains(lower(href), 'tion') OR contains(lower(href), 'sch')")
_anchor_filter(
    "p9_internal_and_specific",
    lambda: u.internal_and_specific(F.col("target"), F.col("href"), "http", ("the", "ment", "en"), 8),
    "length(href) > 8 AND (contains(lower(href), 'the') OR contains(lower(href), 'ment') OR contains(lower(href), 'en'))",
)

# customers' profile addresses, some under other paths
DERIVED["profile_urls"] = """
SELECT k, concat('https://dir.example.edu', CASE k % 8 WHEN 0 THEN '/faculty/' WHEN 1 THEN '/People/' WHEN 2 THEN '/news/' WHEN 3 THEN '/user/'
  WHEN 4 THEN '/profile-' WHEN 5 THEN '/about/' WHEN 6 THEN '/Detalle/Organismo_C/' ELSE '/directory/' END, CAST(k AS STRING), '/x') AS url FROM {@people}"""


@query("p6_profile_like", "SELECT k, url FROM {@profile_urls} WHERE k % 8 IN (0, 1, 3, 4, 7)")
def p6_profile(spark, d):
    return derived(spark, d, "{@profile_urls}").filter(u.profile_like(F.col("url")))


@query("p27_second_last_segment", "SELECT k, split_part(url, '/', -2) AS segment FROM {@profile_urls}")
def p27_segment(spark, d):
    return derived(spark, d, "{@profile_urls}").select("k", u.second_last_segment(F.col("url")).alias("segment"))


@query("f21_department_id", "SELECT k, CASE WHEN k % 8 = 6 THEN CAST(k AS STRING) END AS dep_id FROM {@profile_urls}")
def f21_id(spark, d):
    return derived(spark, d, "{@profile_urls}").select("k", u.department_id(F.col("url"), "/Detalle/Organismo_C").alias("dep_id"))


@query("f22_without_site_suffix", "SELECT k, concat(first_name, ' ', last_name) AS title FROM {@people}")
def f22_suffix(spark, d):
    title = F.concat_ws(" ", "first_name", "last_name")
    raw = F.when(F.col("k") % 3 == 0, F.concat(title, F.lit("  - uc3m | portal"))).when(F.col("k") % 3 == 1, F.concat(title, F.lit("-UC3M"))).otherwise(title)
    return derived(spark, d, "{@people}").select("k", u.without_site_suffix(raw, "UC3M").alias("title"))


@query("f23_expand_templates", """
SELECT n_nationkey, replace(unnest(['{base}/d/list', '{base}/d/all', 'x{base}']), '{base}', concat('https://', lower(n_name), '.example.edu')) AS url FROM {nation}""")
def f23_expand(spark, d):
    base = F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example.edu"))
    urls = u.expand_templates(base, t.lit_array(("{base}/d/list", "{base}/d/all", "x{base}")))
    return load(spark, d, "nation").select("n_nationkey", F.explode(urls).alias("url"))


# department names from the people's words, so that some contain a pattern key
DERIVED["dept_names"] = """
SELECT k, concat(CASE k % 6 WHEN 0 THEN 'Economía ' WHEN 1 THEN 'Derecho, Penal: ' WHEN 2 THEN 'Ciencias Sociales ' WHEN 3 THEN 'Física y Matemáticas ' WHEN 4 THEN 'Derecho y Economía ' ELSE 'Música ' END, last_name) AS name
FROM {@people}"""


@query("j9_pattern_key", """
SELECT k, CASE k % 6 WHEN 0 THEN 'DeptEconomia' WHEN 1 THEN 'DeptDerecho' WHEN 2 THEN 'departamento-ciencias-sociales' WHEN 3 THEN 'DeptMatematicas' ELSE 'DeptEconomia' END AS code,
       CASE k % 6 WHEN 2 THEN 2 ELSE 3 END AS urls
FROM {@dept_names} WHERE k % 6 <> 5""")
def j9_pattern(spark, d):
    """Substring match against the ordered pattern keys; the first key wins."""
    found = DP.pattern_urls(F.col("name"), sp.UC3M)
    rows = derived(spark, d, "{@dept_names}").select("k", found.alias("urls")).filter(F.col("urls").isNotNull())
    code = F.regexp_extract(F.col("urls")[0], r"(Dept\w+|departamento-[\w-]+)", 1)
    return rows.select("k", code.alias("code"), F.size("urls").alias("urls"))


@query("p26_default_department", "SELECT seq, CASE WHEN regexp_matches(x, '^[0-9]+$') THEN concat('Departamento_', x) ELSE x END AS nombre FROM (SELECT seq, CASE WHEN seq % 2 = 0 THEN departamento ELSE concat('dep ', departamento) END AS x FROM {@contacts})")
def p26_default(spark, d):
    x = F.when(F.col("seq") % 2 == 0, F.col("departamento")).otherwise(F.concat(F.lit("dep "), F.col("departamento")))
    return derived(spark, d, "{@contacts}").select("seq", M.default_department_name(x).alias("nombre"))
