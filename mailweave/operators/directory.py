"""Directory pages: names and profile links on list cards, titles and departments on profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import siteprofile as sp
from ..functions import text as t
from ..functions import urls as u
from . import html as H


def card_name_array(selectors=sp.CARD_NAME_SELECTORS) -> Column:
    """X13 for one page: distinct names of two to four words on list cards."""
    texts = F.flatten(F.array(*[H.select_texts(s) for s in selectors]))
    return F.array_distinct(F.filter(texts, lambda x: t.word_count(x).between(2, 4)))


def card_names(doc: DataFrame, keys=("page_id", "url"), selectors=sp.CARD_NAME_SELECTORS) -> DataFrame:
    """X13 as rows."""
    named = F.transform(card_name_array(selectors), lambda x: F.struct(x.alias("full_name")))
    return H.rows_of(doc, keys, named, "full_name")


def card_hrefs(selector: str = sp.CARD_LINK_SELECTOR) -> Column:
    """Link targets on list cards, as they stand."""
    return F.transform(H.select_nodes(selector), lambda n: F.struct(H.attr(n, "href").alias("href"), n["pos"].alias("pos")))


def profile_links(rows: DataFrame, domain: str, keys=("page_id", "url")) -> DataFrame:
    """Distinct resolved links of the domain that look like profiles, with their first position."""
    links = rows.filter(u.usable_href(F.col("href"))).withColumn("link", u.url_join(F.col("url"), F.col("href")))
    links = links.filter(u.mentions_domain(F.col("link"), domain) & u.profile_like(F.col("link")))
    return links.groupBy(*keys, "link").agg(F.min("pos").alias("pos"))


def card_links(doc: DataFrame, domain: str, selector: str = sp.CARD_LINK_SELECTOR, keys=("page_id", "url")) -> DataFrame:
    """Profile links on list cards."""
    return profile_links(H.rows_of(doc, keys, card_hrefs(selector), "href"), domain, keys)


def page_title() -> Column:
    """The first selector whose first match has text; a Person's name last."""
    return F.coalesce(*[H.first_text(s) for s in (*sp.TITLE_SELECTORS, sp.PERSON_NAME_SELECTOR)])


def _word(word: str) -> str:
    return rf"(?<![\p{{L}}\p{{N}}_]){word}(?![\p{{L}}\p{{N}}_])"


def page_department() -> Column:
    """``Department of X`` in a meta block, else the department element, else ``''``."""
    blocks = F.flatten(F.array(*[H.select_texts(s) for s in sp.DEPARTMENT_BLOCK_SELECTORS]))
    mention = "(?i)" + "|".join(_word(w) for w in ("Department", "Affiliation", "School", "Division"))
    pattern = rf"(?id)Department(?: of)?[:{t.WS_CHARS}]+(.+?)(?:{t.WS}{{2,}}|$)"
    named = F.transform(F.filter(blocks, lambda b: b.rlike(mention)), lambda b: t.strip(F.regexp_extract(b, pattern, 1)))
    hit = F.get(F.filter(named, lambda d: F.length(d).between(1, 200)), F.lit(0))
    return F.coalesce(hit, H.first_text(sp.DEPARTMENT_FALLBACK_SELECTOR), F.lit(""))


def profiles(doc: DataFrame, keys=("page_id", "url")) -> DataFrame:
    """Title and department of each profile page."""
    return doc.select(*keys, page_title().alias("full_name"), page_department().alias("department"))
