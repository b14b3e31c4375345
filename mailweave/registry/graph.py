"""Walks (G*), frontier joins (J6, J7) and robots rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import html as H
from ..operators import merge as M
from ..operators import robots as R
from ..operators import walk as W
from . import webs
from .core import DERIVED, derived, load, query

SITE = webs.SITE

# queue order inside one department's web
DERIVED["queue"] = "SELECT s, path, lvl, row_number() OVER (PARTITION BY s ORDER BY step) AS ord FROM {@web_order}"


def _web_links(spark, d):
    return W.co_locate(W.page_links(H.dom(webs.everything(spark, d))))


def _starts(spark, d):
    return derived(spark, d, "SELECT s, web FROM {@depts}").filter(F.col("web").isNotNull())


_URL = "concat('https://d', CAST(s AS STRING), '.example.edu', path)"


@query("g2_walk_hosts", f"SELECT s, {_URL} AS url, lvl AS level, CAST(ord AS INT) AS ord FROM {{@queue}}")
def g2(spark, d):
    """One walk per department, never reaching the cap; '#top' counts as a page of its own."""
    out = W.walk_hosts(_web_links(spark, d), _starts(spark, d), "s", "web", 40)
    return out.select(F.col("walk").alias("s"), "url", "level", "ord")


@query("l8_page_cap", f"SELECT s, {_URL} AS url, lvl AS level, CAST(ord AS INT) AS ord FROM {{@queue}} WHERE ord <= 8")
def l8(spark, d):
    """The same walks cut off after eight pages in queue order, dead links counted."""
    out = W.walk_hosts(_web_links(spark, d), _starts(spark, d), "s", "web", 8)
    return out.select(F.col("walk").alias("s"), "url", "level", "ord")


@query("w9_discovery_order", f"SELECT s, {_URL} AS url, CAST(ord AS INT) AS ord FROM {{@queue}}")
def w9(spark, d):
    """The visit number is the rank of the page's trail among its department's pages."""
    out = W.walk_hosts(_web_links(spark, d), _starts(spark, d), "s", "web", 1000)
    return out.select(F.col("walk").alias("s"), "url", "ord")


@query("g3_walk_relevant", f"""
SELECT s, {_URL} AS url, lvl AS level FROM {{@queue}} q WHERE path NOT LIKE '/deeper/%' OR (SELECT max(p.ord) FROM {{@queue}} p WHERE p.s = q.s AND p.path = replace(q.path, 'deeper', 'deep')) < 10""")
def g3(spark, d):
    """After nine visited pages only links with a staff word are pursued."""
    out = W.walk_relevant(_web_links(spark, d), _starts(spark, d), SITE.walk_keywords, "s", "web", 50)
    return out.select(F.col("walk").alias("s"), "url", "level")


# rules: every department's web blocks its news; the main site blocks the staff lists but for one branch
DERIVED["rules"] = """
SELECT concat('d', CAST(s AS STRING), '.example.edu') AS host, '*' AS agent, '/news' AS path_prefix, false AS allow, 1 AS rule_no FROM {@depts}
UNION ALL SELECT concat('d', CAST(s AS STRING), '.example.edu'), 'otherbot', '/', false, 2 FROM {@depts}
UNION ALL SELECT 'www.example.edu', '*', concat('/listado/de/personal/', CAST(s AS STRING)), true, 1 FROM {@depts} WHERE s % 3 = 1
UNION ALL SELECT 'www.example.edu', '*', '/listado/', false, 2 FROM {@depts} WHERE s = 0"""

# the whole site in queue order: lists, cards, then each card's web and staff list, then the webs
DERIVED["site_order"] = """
SELECT CAST(0 AS INT) AS lvl, page AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c, concat('https://www.example.edu/departments/', CAST(page AS STRING)) AS url FROM (SELECT DISTINCT page FROM {@depts})
UNION ALL SELECT 1, page, s, 0, dept_url FROM {@depts}
UNION ALL SELECT 2, page, s, 2, web FROM {@depts} WHERE web IS NOT NULL
UNION ALL SELECT 2, page, s, 1, 'https://www.example.edu/x' FROM {@depts} WHERE s IN (SELECT min(s) FROM {@depts} WHERE web IS NOT NULL)
UNION ALL SELECT 2, page, s, 3, concat('https://www.example.edu/listado/de/personal/', CAST(s AS STRING)) FROM {@depts} d
  WHERE s % 7 <> 3 AND (s % 3 = 1 OR EXISTS (SELECT 1 FROM {@depts} e WHERE e.s % 3 = 1 AND CAST(d.s AS STRING) LIKE concat(CAST(e.s AS STRING), '%')))
UNION ALL SELECT lvl + 2, page, s, step, concat('https://d', CAST(s AS STRING), '.example.edu', path) FROM {@web_order} JOIN (SELECT s AS s2, page FROM {@depts}) ON s2 = s
  WHERE lvl > 0 AND path NOT IN ('/news', '/#top')"""


def _site_seeds(spark, d):
    pages = derived(spark, d, "SELECT DISTINCT page FROM {@depts}")
    url = F.concat(F.lit("https://www.example.edu/departments/"), F.col("page").cast("string"))
    return pages.select(F.lit("all").alias("walk"), url.alias("url"), F.col("page").cast("int").alias("seed_no"))


def _site_walk(spark, d, max_pages):
    return W.walk_site(_web_links(spark, d), _site_seeds(spark, d), SITE.domain, derived(spark, d, "{@rules}"), "testbot/1.0", max_pages)


@query("g1_walk_site", "SELECT url, lvl AS level FROM {@site_order}")
def g1(spark, d):
    """The whole domain under robots rules, without a cap."""
    return _site_walk(spark, d, None).select("url", "level")


@query("g1_walk_site_capped", """
SELECT url, level, ord FROM (SELECT url, lvl AS level, CAST(row_number() OVER (ORDER BY lvl, a, b, c) AS INT) AS ord FROM {@site_order}) WHERE ord <= 200""")
def g1_capped(spark, d):
    """The first 200 pages of the same walk; external and blocked pages use up no budget."""
    return _site_walk(spark, d, 200).select("url", "level", "ord")


# -- frontier joins ---------------------------------------------------------------------------
@query("j6_unvisited", "SELECT DISTINCT source_url AS url FROM {@stored} WHERE source_url NOT IN (SELECT source_url FROM {@profiles})")
def j6(spark, d):
    frontier = derived(spark, d, "{@stored}").select(F.col("source_url").alias("url")).distinct()
    visited = derived(spark, d, "{@profiles}").select(F.col("source_url").alias("url"))
    return M.unseen(frontier, visited, "url")


@query("j7_fetch_stored_pages", "SELECT c.dept_url AS url, 'https://www.example.edu/listado/de/personal/' || CAST(c.s AS STRING) AS target FROM {@depts} c WHERE c.s % 7 <> 3")
def j7(spark, d):
    """Links of the department pages whose target is a stored page; the rest are failed fetches."""
    links = W.page_links(H.dom(webs.department_cards(spark, d)))
    stored = webs.listed_staff_pages(spark, d).select(F.col("url").alias("target"))
    return links.join(stored, "target").select("url", "target")


# -- robots -----------------------------------------------------------------------------------------
_HOST = "lower(regexp_extract(url, '^https?://([^/?#]*)', 1))"
_PATH = "regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1)"
# hosts of the page table: some have rules, hosts of even length have none and are blocked
DERIVED["page_rules"] = """
SELECT host, '*' AS agent, '/en/1' AS path_prefix, true AS allow, 1 AS rule_no FROM {@ruled_hosts}
UNION ALL SELECT host, '*', '/en/', false, 2 FROM {@ruled_hosts}
UNION ALL SELECT host, '*', '/fr', false, 3 FROM {@ruled_hosts} WHERE host LIKE 'www.%'
UNION ALL SELECT host, 'testbot', '/de/', false, 4 FROM {@ruled_hosts} WHERE host LIKE 'm.%'
UNION ALL SELECT host, '*', '', false, 5 FROM {@ruled_hosts}"""
DERIVED["ruled_hosts"] = "SELECT DISTINCT host FROM (SELECT split_part(split_part(url, '/', 3), ':', 1) AS host FROM {pages}) WHERE length(host) % 2 = 1"


@query("p29_robots_rules", f"""
SELECT page_id, url FROM (SELECT page_id, url, {_HOST} AS h, {_PATH} AS p FROM {{pages}}) u
WHERE h IN (SELECT host FROM {{@ruled_hosts}}) AND CASE
  WHEN h LIKE 'm.%' THEN NOT starts_with(p, '/de/') WHEN starts_with(p, '/en/1') THEN true WHEN starts_with(p, '/en/') THEN false
  WHEN h LIKE 'www.%' AND starts_with(p, '/fr') THEN false ELSE true END""")
def p29(spark, d):
    return R.allowed(load(spark, d, "pages").select("page_id", "url"), derived(spark, d, "{@page_rules}"), "testbot/1.0")
