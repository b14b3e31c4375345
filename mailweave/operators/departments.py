"""Department lists, department cards and the discovery of staff pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import emails as em
from ..functions import text as t
from ..functions import urls as u
from ..siteprofile import SiteProfile
from . import dedup
from . import html as H


def by_keyword(doc: DataFrame, site: SiteProfile) -> DataFrame:
    """Department links whose text holds a known word; first url per text, last text per url."""
    return keyword_links(H.anchors(doc, ("page_id",)), site)


def keyword_links(links: DataFrame, site: SiteProfile) -> DataFrame:
    """X17 over links ``(page_id, href, text, pos)``, text chunks joined by blanks."""
    links = links.filter((F.col("text") != "") & u.has_keyword(site.department_keywords, F.col("text")))
    links = links.select("page_id", "pos", "text", u.url_join(F.lit(site.base_url), F.col("href")).alias("url"))
    kept = dedup.url_text_dictionary(links.filter(u.under_base(F.col("url"), site.base_url)))
    return kept.select(F.col("url").alias("dept_url"), F.col("text").alias("dept_name"), "page_id", "pos")


def _marked_links(links: DataFrame, site: SiteProfile, marker: str) -> DataFrame:
    links = links.filter(F.contains("href", F.lit(marker)))
    return links.withColumn("dept_url", u.url_join(F.lit(site.base_url), F.col("href")))


def by_marker(doc: DataFrame, site: SiteProfile) -> DataFrame:
    """Distinct links that carry the department marker."""
    return marker_links(H.anchors(doc, ("page_id",), sep=""), site)


def marker_links(links: DataFrame, site: SiteProfile) -> DataFrame:
    """X18 over links ``(page_id, href, text, pos)``, text chunks glued."""
    return _marked_links(links, site, site.department_marker).select("dept_url").distinct()


def by_marker_named(doc: DataFrame, site: SiteProfile) -> DataFrame:
    """X18 with a plausible name, first one per url in page order."""
    return marker_links_named(H.anchors(doc, ("page_id",), sep=""), site)


def marker_links_named(links: DataFrame, site: SiteProfile) -> DataFrame:
    """X19 over links ``(page_id, href, text, pos)``, text chunks glued."""
    links = _marked_links(links, site, site.department_marker).filter(F.length("text").between(4, 99))
    rows = links.select("dept_url", F.col("text").alias("dept_name"), "page_id", "pos")
    return dedup.first_per_key(rows, "dept_url", ["page_id", "pos"])


def id_names(doc: DataFrame, site: SiteProfile) -> DataFrame:
    """Id -> name pairs of the list page, the last name of an id wins."""
    links = _marked_links(H.anchors(doc, ("page_id",), sep=""), site, site.department_marker + "/")
    rows = links.select(u.department_id(F.col("href"), site.department_marker).alias("dep_id"), "text", "page_id", "pos")
    rows = rows.filter(F.col("dep_id").isNotNull() & (F.length("text") > 3))
    return rows.groupBy("dep_id").agg(F.max_by("text", F.struct("page_id", "pos")).alias("nombre"))


def single_page_name(site: SiteProfile) -> Column:
    """First heading, else the title without the site's suffix; longer than 3."""
    title = u.without_site_suffix(H.first_text("title", sep=""), site.site_suffix)
    texts = F.array(H.first_text("h1", sep=""), title)
    return F.get(F.filter(texts, lambda x: F.length(x) > 3), F.lit(0))


def single_page_names(doc: DataFrame, site: SiteProfile) -> DataFrame:
    rows = doc.select(u.department_id(F.col("url"), site.department_marker).alias("dep_id"), single_page_name(site).alias("nombre"))
    return rows.filter(F.col("dep_id").isNotNull() & F.col("nombre").isNotNull()).dropDuplicates(["dep_id"])


def card_mail(from_text: bool = False, domains=None, strict: bool = True) -> Column:
    """X22, first half: the first ``mailto:`` link, read from its text or its target."""
    link = F.get(F.filter(F.col("nodes"), lambda n: (n["tag"] == "a") & H.attr(n, "href").startswith("mailto:")), F.lit(0))
    if from_text:
        return H.let(link, lambda n: t.blank_to_null(H.subtree_text(n, sep="")))
    clean = em.clean_email if domains is None else (lambda raw: em.clean_domain_email(raw, domains, strict))
    return H.let(H.attr(link, "href"), clean)


def card_web(site: SiteProfile) -> Column:
    """X22, second half: the link in the ``dd`` after the labelled ``dt``; the last such label wins."""
    labels = F.filter(
        F.col("nodes"), lambda n: (n["tag"] == "dt") & F.contains(H.raw_subtree_text(n), F.lit(site.web_label))
    )

    def target(dt: Column) -> Column:
        next_dd = F.get(F.filter(F.col("nodes"), lambda n: (n["tag"] == "dd") & (n["pos"] > dt["pos"])), F.lit(0))
        return H.let(next_dd, first_href)

    def first_href(dd: Column) -> Column:
        link = F.filter(H.subtree(dd), lambda n: (n["tag"] == "a") & H.attr(n, "href").isNotNull())
        return F.when(dd.isNotNull(), H.attr(F.get(link, F.lit(0)), "href"))

    found = F.filter(F.transform(labels, target), lambda h: h.isNotNull())
    last = F.try_element_at(found, F.lit(-1))
    return H.let(last, lambda h: F.when(h.isNotNull(), u.url_join(F.lit(site.base_url), h)))


def cards(doc: DataFrame, site: SiteProfile, keys=("page_id", "url"), from_text: bool = False) -> DataFrame:
    """Mailbox and web address of each department page."""
    mail = card_mail(from_text, None if from_text else site.email_domains, site.strict)
    return doc.select(*keys, mail.alias("mail"), card_web(site).alias("web"))


def mailbox_contacts(cards_df: DataFrame, department: str, site: SiteProfile, mail: str = "mail") -> DataFrame:
    """The department's own mailbox as a contact."""
    rows = cards_df.filter(F.col(mail).isNotNull())
    return rows.select(F.col(department).alias("departamento"), F.lit(site.mailbox_name).alias("profesor"), F.col(mail).alias("email"))


def pattern_urls(name: Column, site: SiteProfile, legacy_key: bool = False) -> Column:
    """J9 + F23: URL guesses of the first pattern key that occurs in the short name."""
    short = t.short_key(name, legacy_key)
    by_key: dict[str, list[str]] = {}
    for key, template in site.staff_url_patterns:
        by_key.setdefault(key, []).append(template)
    out = F.lit(None).cast("array<string>")
    for key, templates in reversed(by_key.items()):
        urls = u.expand_templates(F.lit(site.base_url), t.lit_array(templates))
        out = F.when(F.contains(short, F.lit(key)), urls).otherwise(out)
    return out


def guessed_pages(departments: DataFrame, site: SiteProfile, legacy_key: bool = False) -> DataFrame:
    """Pattern URLs of each department, existing or not."""
    urls = pattern_urls(F.col("dept_name"), site, legacy_key)
    return departments.select("dept_url", "dept_name", F.explode_outer(urls).alias("staff_url")).filter(F.col("staff_url").isNotNull())


def mentions_contacts(site: SiteProfile) -> Column:
    """Does the parsed page's text hold one of the contact words?"""
    return u.has_keyword(site.contact_words, F.lower(H.visible_text("")))


def existing_contact_pages(candidates: DataFrame, doc: DataFrame, site: SiteProfile, url: str = "staff_url") -> DataFrame:
    """Candidates whose page exists and mentions contact words."""
    relevant = doc.filter(mentions_contacts(site)).select(F.col("url").alias(url))
    return candidates.join(relevant, url, "left_semi").select(*candidates.columns)


def staff_pages(departments: DataFrame, dept_doc: DataFrame, guess_doc: DataFrame, site: SiteProfile, legacy_key: bool = False) -> DataFrame:
    """Staff pages of each department: keyword links, specific links and existing
    pattern URLs; the department page itself where nothing was found.

    ``dept_doc`` holds the parsed department pages, ``guess_doc`` any parsed pages that
    may stand behind pattern URLs.
    """
    relevant = guess_doc.filter(mentions_contacts(site)).select("url")
    return staff_pages_of(departments, H.anchors(dept_doc, ("url",)), relevant, site, legacy_key)


def staff_pages_of(departments: DataFrame, links: DataFrame, relevant: DataFrame, site: SiteProfile, legacy_key: bool = False) -> DataFrame:
    """X23 over links ``(url, href, text, pos)`` of department pages and the URLs of pages that mention contacts."""
    depts = departments.select("dept_url", "dept_name")
    links = links.withColumn("staff_url", u.url_join(F.col("url"), F.col("href")))
    wanted = (u.under_base(F.col("staff_url"), site.base_url) & u.has_keyword(site.staff_keywords, F.col("text"), F.col("href"))) | (
        u.internal_and_specific(F.col("staff_url"), F.col("href"), site.base_url, site.specific_link_words)
    )
    linked = depts.join(links.filter(wanted).select(F.col("url").alias("dept_url"), "staff_url"), "dept_url")
    guesses = guessed_pages(depts, site, legacy_key)
    guesses = guesses.join(relevant.select(F.col("url").alias("staff_url")), "staff_url", "left_semi").select(*guesses.columns)
    found = linked.select("dept_url", "dept_name", "staff_url").unionByName(guesses)
    # the department's own page is a candidate of last resort: it counts where nothing else did
    own = depts.select("dept_url", "dept_name", F.lit(None).cast("string").alias("staff_url"))
    every = F.count("staff_url").over(Window.partitionBy("dept_url"))
    rows = found.unionByName(own).distinct().withColumn("_found", every)
    rows = rows.filter(F.col("staff_url").isNotNull() | (F.col("_found") == 0))
    return rows.select("dept_url", "dept_name", F.coalesce("staff_url", "dept_url").alias("staff_url"))
