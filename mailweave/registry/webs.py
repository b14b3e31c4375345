"""Page tables derived from the given tables.

The given pages hold no cards, tables, profiles or mail links, so those layouts are
written by Spark from customers (people) and suppliers (departments): every page
holds a bounded number of rows and the number of pages grows with the tables.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..siteprofile import SiteProfile
from .core import DERIVED, derived, stored

SITE = SiteProfile(
    domain="example.edu", base_url="https://www.example.edu", email_domains=("mail.example.edu",), university="Example University", site_suffix="UC3M",
)

_DIR_NAME = """CASE k % 5 WHEN 0 THEN first_name WHEN 2 THEN concat('Dr ', first_name, ' ', last_name)
    WHEN 3 THEN concat(first_name, ' a b c ', last_name) ELSE concat(first_name, ' ', last_name) END"""

# a directory: list pages of 20 cards, and a profile page for some of the people
DERIVED["cards"] = f"""
SELECT k, dep, CAST(floor(k / 20) AS BIGINT) AS page, concat('https://dir.example.edu/list/', CAST(CAST(floor(k / 20) AS BIGINT) AS STRING)) AS list_url,
       {_DIR_NAME} AS name, concat(first_name, ' ', last_name) AS full_name, first_name, last_name, email AS other_email,
       concat('u', CAST(k AS STRING), '@example.edu') AS email,
       CASE k % 6 WHEN 0 THEN '#top' WHEN 1 THEN concat('/people/', CAST(k AS STRING)) WHEN 2 THEN concat('https://dir.example.edu/profile/', CAST(k AS STRING))
         WHEN 3 THEN concat('/news/', CAST(k AS STRING)) WHEN 4 THEN concat('https://other.example.org/people/', CAST(k AS STRING)) ELSE concat('../faculty/', CAST(k AS STRING)) END AS href,
       CASE k % 6 WHEN 1 THEN concat('https://dir.example.edu/people/', CAST(k AS STRING)) WHEN 2 THEN concat('https://dir.example.edu/profile/', CAST(k AS STRING))
         WHEN 5 THEN concat('https://dir.example.edu/faculty/', CAST(k AS STRING)) END AS link
FROM {{@people}}"""

# departments: one per supplier
DERIVED["depts"] = """
SELECT s_suppkey AS s, CAST(floor(s_suppkey / 25) AS BIGINT) AS page, concat(CASE s_suppkey % 4 WHEN 0 THEN 'Economía ' WHEN 1 THEN 'Física ' WHEN 2 THEN 'Música ' ELSE 'Ingeniería Mecánica ' END, CAST(s_suppkey AS STRING)) AS name,
       concat('https://www.example.edu/Detalle/Organismo_C/', CAST(s_suppkey AS STRING), '/slug-', CAST(s_suppkey AS STRING)) AS dept_url,
       CASE WHEN s_suppkey % 5 <> 4 THEN concat('dept', CAST(s_suppkey AS STRING), '@mail.example.edu') END AS mail,
       CASE WHEN s_suppkey % 6 <> 5 THEN concat('https://d', CAST(s_suppkey AS STRING), '.example.edu/') END AS web
FROM {supplier}"""

# staff: 15 people per department on three pages of its web, one layout per department
DERIVED["staff"] = """
SELECT k, s, j, s % 5 AS layout, k - s * 15 - j * 5 AS idx, first_name, last_name,
       CASE WHEN k % 3 = 0 THEN concat('Dr. ', first_name, ' ', last_name) ELSE concat(first_name, ' ', last_name) END AS display,
       concat(first_ascii, '.', last_ascii, '.', CAST(k AS STRING), CASE WHEN k % 7 = 0 THEN '@other.example.org' ELSE '@mail.example.edu' END) AS email,
       concat('https://d', CAST(s AS STRING), '.example.edu/staff/', CAST(j AS STRING)) AS url
FROM (SELECT *, CAST(floor(k / 15) AS BIGINT) AS s, CAST(floor((k - CAST(floor(k / 15) AS BIGINT) * 15) / 5) AS BIGINT) AS j FROM {@people})"""


def kept(make):
    """Pages are written at their first use; ``make`` derives them anew."""

    @wraps(make)
    def read(spark, d) -> DataFrame:
        return stored(spark, d, make.__name__, make)

    read.make = make
    return read


def _s(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _assemble(rows: DataFrame, keys, order: str, piece: Column) -> DataFrame:
    """Join the pieces of each page in order; a page has a fixed small number of pieces."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("h"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["h"]), "\n").alias("body"))


def _page(body: Column, title: Column | str = "Page") -> Column:
    return _s("<!DOCTYPE html>\n<html><head><title>", F.lit(title) if isinstance(title, str) else title, "</title></head>\n<body>\n", body, "\n</body></html>")


@kept
def directory_lists(spark, d) -> DataFrame:
    c = derived(spark, d, "{@cards}")
    name = _escape(F.col("name"))
    head = F.when(
        F.col("k") % 5 == 4, _s('<div class="field--name-title">', name, '</div> <a href="', F.col("href"), '">more</a>')
    ).otherwise(_s('<h3><a href="', F.col("href"), '">', name, "</a></h3>"))
    mail = (
        F.when(F.col("k") % 3 == 0, _s("Mail: ", F.upper("email"), " or ", F.col("email")))
        .when(F.col("k") % 3 == 2, F.col("other_email"))
        .otherwise(F.lit(""))
    )
    card = _s('<div class="views-row">', head, " ", mail, "</div>")
    pages = _assemble(c, ["page", "list_url"], "k", card)
    return pages.select(F.col("page").alias("page_id"), F.col("list_url").alias("url"), _page(_s('<div class="view-content">\n', F.col("body"), "\n</div>")).alias("html"))


@kept
def directory_profiles(spark, d) -> DataFrame:
    """Profile pages of the linked people, a seventh of them missing."""
    c = derived(spark, d, "SELECT c.*, n_name FROM {@cards} c JOIN {nation} ON n_nationkey = c.dep WHERE link IS NOT NULL AND k % 7 <> 3")
    name, dep = _escape(F.col("full_name")), F.col("n_name")
    k = F.col("k")
    title = (
        F.when(k % 4 == 0, _s("<h1> </h1><h2>", name, "</h2>"))
        .when(k % 4 == 1, _s("<header><h1>", name, "</h1></header>"))
        .when(k % 4 == 2, _s('<div class="page-title x">', name, "</div>"))
        .otherwise(_s('<div itemscope itemtype="http://schema.org/person"><span itemprop="name">', name, "</span></div>"))
    )
    block = (
        F.when(k % 5 == 0, _s("<dl><dt>Department of</dt><dd>", dep, "</dd></dl>"))
        .when(k % 5 == 1, _s('<div class="field">Affiliation: none</div><div class="sidebar">Department: ', dep, "  since 1999</div>"))
        .when(k % 5 == 2, _s('<span class="department">', dep, "</span>"))
        .when(k % 5 == 3, F.lit('<div class="field">School</div>'))
        .otherwise(F.lit(""))
    )
    mail = F.when(k % 2 == 0, _s("<p>p", k, "@example.edu</p>")).otherwise(F.lit("<p>no mail</p>"))
    return c.select((k + 1_000_000_000).alias("page_id"), F.col("link").alias("url"), _page(_s(title, "\n", block, "\n", mail)).alias("html"))


@kept
def department_lists(spark, d) -> DataFrame:
    t = derived(spark, d, "{@depts}")
    s = F.col("s")
    href = F.replace(F.col("dept_url"), F.lit("https://www.example.edu"), F.lit(""))
    first = _s('<li><a href="', href, '">', F.when(s % 10 == 7, F.lit("abc")).otherwise(F.col("name")), "</a></li>")
    again = F.when(s % 3 == 0, _s('<li><a href="', href, '">', F.col("name"), " bis</a></li>")).otherwise(F.lit(""))
    pages = _assemble(t, ["page"], "s", _s(first, "\n", again))
    url = _s("https://www.example.edu/departments/", F.col("page"))
    return pages.select(F.col("page").alias("page_id"), url.alias("url"), _page(_s("<ul>", F.col("body"), "</ul>")).alias("html"))


@kept
def department_cards(spark, d) -> DataFrame:
    t = derived(spark, d, "{@depts}")
    s = F.col("s")
    heading = F.when(s % 2 == 0, _s("<h1>", F.col("name"), "</h1>")).otherwise(F.lit(""))
    mail = F.when(F.col("mail").isNotNull(), _s('<p><a href="mailto:', F.initcap("mail"), '?subject=hi">write to us</a></p>')).otherwise(F.lit(""))
    web = F.when(F.col("web").isNotNull(), _s('<dl><dt>Web</dt><dd><a href="/x">x</a></dd><dt>Web del departamento</dt>\n<dd> <a href="', F.col("web"), '">web</a></dd></dl>')).otherwise(
        F.lit("<dl><dt>Web del departamento</dt></dl>")
    )
    staff = F.when(s % 7 != 3, _s('<p><a href="/listado/de/personal/', s, '">Profesorado</a></p>')).otherwise(F.lit(""))
    body = _s(heading, "\n", mail, "\n", web, "\n", staff)
    return t.select((s + 2_000_000_000).alias("page_id"), F.col("dept_url").alias("url"), _page(body, _s(F.col("name"), " - UC3M portal")).alias("html"))


def _staff_bodies(spark, d) -> DataFrame:
    """The staff blocks in five layouts: table, list, profile blocks, plain text, mail links."""
    p = derived(spark, d, "{@staff}")
    k, layout, name, email = F.col("k"), F.col("layout"), _escape(F.col("display")), F.col("email")
    row = F.when(k % 2 == 0, _s("<tr>\n<td>", name, "</td>\n<td>", email, "</td>\n</tr>")).otherwise(_s("<tr>\n<td>", name, " ", email, "</td>\n<td>x</td>\n</tr>"))
    block = F.when(k % 2 == 0, _s('<div class="person">\n<h3>', name, "</h3>\n<span>", email, "</span>\n</div>")).otherwise(
        _s('<div class="a staff-member">Prof. ', name, ": <i>", email, "</i>\n</div>")
    )
    lines = _s("Tel: ", k, "\n", name, "\n  ", email, "\n")
    link = _s("<p>", name, ' <a href="mailto:', F.upper(email), '?subject=x">e-mail</a></p>')
    item = _s("<li>", name, ", ", email, "</li>")
    piece = F.when(layout == 0, row).when(layout == 1, item).when(layout == 2, block).when(layout == 3, lines).otherwise(link)
    bodies = _assemble(p, ["s", "j", "layout", "url"], "k", piece)
    box = F.when((F.col("s") % 2 == 0) & F.col("layout").isin(0, 2), _s("\n<ul>\n<li>Webmaster one: web", F.col("s"), "@mail.example.edu</li>\n</ul>")).otherwise(F.lit(""))
    body = F.col("body")
    wrapped = (
        F.when(layout == 0, _s("<table>\n", body, "\n</table>"))
        .when(layout == 1, _s("<ul>\n", body, "\n</ul>"))
        .when(layout == 3, _s("<pre>", body, "</pre>"))
        .otherwise(body)
    )
    return bodies.select("s", "j", "layout", "url", F.concat(wrapped, box).alias("body"))


@kept
def staff_pages(spark, d) -> DataFrame:
    """Staff pages of every department's web, with links home and one step deeper."""
    b = _staff_bodies(spark, d)
    links = _s('\n<a href="/">home</a> <a href="/deep/', F.col("j"), '">more</a>')
    return b.select((F.col("s") * 10 + F.col("j") + 3_000_000_000).alias("page_id"), "url", _page(F.concat("body", links)).alias("html"))


@kept
def listed_staff_pages(spark, d) -> DataFrame:
    """The first staff page of each department, as the main site lists it, and one page under a known pattern."""
    b = _staff_bodies(spark, d).filter(F.col("j") == 0)
    own = b.select(
        (F.col("s") + 4_000_000_000).alias("page_id"), _s("https://www.example.edu/listado/de/personal/", F.col("s")).alias("url"), _page(F.col("body")).alias("html")
    )
    pattern = "https://www.example.edu/ss/Satellite/DeptEconomia/es/ListadoPersonalDept/1371321047774/Profesores_Titulares"
    nation = derived(spark, d, "SELECT n_nationkey, n_name FROM {nation}")
    rows = nation.select(F.lit(1).alias("p"), "n_nationkey", _s("<li>Titular ", F.col("n_name"), " ", F.lower("n_name"), "@mail.example.edu</li>").alias("h"))
    page = _assemble(rows, ["p"], "n_nationkey", F.col("h"))
    shared = page.select(F.lit(5_000_000_000).alias("page_id"), F.lit(pattern).alias("url"), _page(_s("<ul>", F.col("body"), "</ul>")).alias("html"))
    return own.unionByName(shared)


@kept
def directory_pages(spark, d) -> DataFrame:
    """General directory: 20 people per page, every fourth person listed."""
    p = derived(spark, d, "SELECT *, CAST(floor(k / 20) AS BIGINT) AS page FROM {@staff} WHERE k % 4 = 0")
    item = _s("<li>", _escape(F.col("display")), " ", F.col("email"), "</li>")
    pages = _assemble(p, ["page"], "k", item)
    url = _s("https://www.example.edu/directorio/", F.col("page"))
    return pages.select((F.col("page") + 6_000_000_000).alias("page_id"), url.alias("url"), _page(_s("<ul>", F.col("body"), "</ul>")).alias("html"))


# links of a department's web in queue order: home, its anchors, then one step deeper
DERIVED["web_order"] = """
SELECT s, path, step, lvl FROM (SELECT s FROM {@depts} WHERE web IS NOT NULL) JOIN (
  SELECT '/' AS path, 0 AS step, 0 AS lvl UNION ALL SELECT '/staff/0', 1, 1 UNION ALL SELECT '/staff/1', 2, 1 UNION ALL SELECT '/staff/2', 3, 1 UNION ALL SELECT '/news', 4, 1
  UNION ALL SELECT '/#top', 5, 1 UNION ALL SELECT '/dead', 6, 1 UNION ALL SELECT '/deep/0', 7, 2 UNION ALL SELECT '/deep/1', 8, 2 UNION ALL SELECT '/deep/2', 9, 2
  UNION ALL SELECT '/deeper/0', 10, 3 UNION ALL SELECT '/deeper/1', 11, 3 UNION ALL SELECT '/deeper/2', 12, 3) ON NOT (path = '/news' AND s % 3 = 0)"""


def web_pages(spark, d) -> DataFrame:
    """Home, news and deeper pages of every department's web."""
    t = derived(spark, d, "{@depts}").filter(F.col("web").isNotNull())
    s = F.col("s")
    news = F.when(s % 3 != 0, F.lit('<a href="/news">News</a> ')).otherwise(F.lit(""))
    home = _s('<p>Welcome</p> <a href="/staff/0">One</a> <a href="staff/1">Two</a> <a href="./staff/2">Three</a> ', news,
              '<a href="#top">top</a> <a href="https://other.example.org/x">other</a> <a href="/dead">gone</a> <a href="/staff/1">again</a>')
    host = _s("https://d", s, ".example.edu")
    pages = [(0, _s(host, "/"), home), (4, _s(host, "/news"), F.lit("<p>No news</p> <a href='/'>home</a>"))]
    for j in range(3):
        pages.append((5 + j, _s(host, f"/deep/{j}"), F.lit(f'<p>Deep</p> <a href="/deeper/{j}">deeper</a> <a href="/staff/0">back</a>')))
    entries = F.array(*[F.struct(F.lit(n).alias("n"), url.alias("url"), _page(body).alias("html")) for n, url, body in pages])
    rows = t.select("s", F.inline(entries)).filter(~((F.col("n") == 4) & (s % 3 == 0)))
    return rows.select((s * 10 + F.col("n") + 7_000_000_000).alias("page_id"), "url", "html")


@kept
def everything(spark, d) -> DataFrame:
    """The whole university: department lists and cards, their webs, listed staff, the directory."""
    out = department_lists.make(spark, d)
    for part in (department_cards.make, staff_pages.make, web_pages, listed_staff_pages.make, directory_pages.make):
        out = out.unionByName(part(spark, d))
    return out


def prepare(spark, d) -> None:
    """Write all pages, so that what follows only reads them."""
    for part in (directory_lists, directory_profiles, department_lists, department_cards, staff_pages, listed_staff_pages, directory_pages, everything):
        part(spark, d)
