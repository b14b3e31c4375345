"""Q1: list page and profile pages of a directory -> contacts and profiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import emails as em
from ..functions import text as t
from ..functions import urls as u
from ..operators import directory as D
from ..operators import domains as DM
from ..operators import extract as X
from ..operators import html as H
from ..operators import merge as M
from ..session import cut_lineage
from ..siteprofile import SiteProfile

_SHAPE = (
    "source_url", "full_name", "first_name", "last_name", "email_found", "email_generated",
    "method", "confidence", "notes",
)


@dataclass
class Directory:
    contacts: DataFrame
    profiles: DataFrame
    failed: DataFrame  # pages that could not be parsed, by reason


def found_rows(emails: DataFrame, method: str, notes: str, url: str = "url") -> DataFrame:
    """P20 for published addresses: full confidence, no name of their own."""
    none = F.lit(None).cast("string")
    return emails.select(
        F.col(url).alias("source_url"), none.alias("full_name"), none.alias("first_name"), none.alias("last_name"),
        F.col("email").alias("email_found"), none.alias("email_generated"), F.lit(method).alias("method"),
        F.lit(1.0).alias("confidence"), F.lit(notes).alias("notes"),
    )


def named_rows(names: DataFrame, domain: str, method: str, notes: str, sure: float, unsure: float, url: str = "url") -> DataFrame:
    """P20 for names: split (F3), guess an address (F4), lower confidence."""
    split = names.withColumn("_s", t.split_first_last(F.col("full_name")))
    generated = em.generate_email(F.col("_s.first_name"), F.col("_s.last_name"), domain)
    return split.select(
        F.col(url).alias("source_url"), "full_name", F.col("_s.first_name").alias("first_name"),
        F.col("_s.last_name").alias("last_name"), F.lit(None).cast("string").alias("email_found"),
        generated.alias("email_generated"), F.lit(method).alias("method"),
        F.when(generated.isNotNull(), sure).otherwise(unsure).alias("confidence"), F.lit(notes).alias("notes"),
    )


def union_contacts(*parts: DataFrame) -> DataFrame:
    """U1 with the row id; identical rows get the same id and collapse."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*_SHAPE)


def _parsed(pages: DataFrame, domain: str) -> DataFrame:
    """Pages with their addresses (read from the markup) and their DOM, in one pass."""
    emails = em.find_distinct_lower(F.col("html"), em.domain_email_pattern(domain))
    return H.dom(pages.withColumn("emails", emails), parts=("nodes", "clean"))


def _emails(facts: DataFrame) -> DataFrame:
    return facts.select("url", F.explode("emails").alias("email"))


def extract_directory(
    pages: DataFrame, list_urls: DataFrame, site: SiteProfile, max_profiles: int | None = None, suffixes: DataFrame | None = None
) -> Directory:
    """``list_urls``: one column ``url``. Only pages of the site's registered domain are read, by the rules in ``suffixes``
    (see :func:`mailweave.sources.tables.read_suffix_table`) or else by the short built-in list.

    List pages and profile pages are parsed once each; what was read from them (not
    the pages) is written down, and contacts, profiles and failures are built from that.
    """
    pages = X.usable_pages(pages).select("page_id", "url", "html")
    starts = list_urls.select("url").distinct()
    if suffixes is None:
        starts = starts.filter(u.same_registered_domain(F.col("url"), site.domain))
    else:
        starts = DM.registered_domains(starts, "url", suffixes).filter(F.col("domain") == site.domain.lower()).select("url")
    lists = _parsed(X.pages_among(pages, starts), site.domain)
    lists = cut_lineage(lists.select("page_id", "url", "emails", D.card_name_array().alias("names"), D.card_hrefs().alias("hrefs"), "_error"))
    links = D.profile_links(lists.select("page_id", "url", F.inline("hrefs")), site.domain)
    links = links.select(F.col("link").alias("url"), "page_id", "pos").groupBy("url").agg(F.min(F.struct("page_id", "pos")).alias("seq"))
    if max_profiles is not None:
        links = links.orderBy("seq", "url").limit(max_profiles)
    details = _parsed(X.pages_among(pages, links), site.domain)
    details = cut_lineage(details.select("url", "emails", D.page_title().alias("full_name"), D.page_department().alias("department"), "_error"))
    failed = H.parse_errors(lists.select("url", "_error").unionByName(details.select("url", "_error")))
    split = details.filter(F.col("_error").isNull()).withColumn("_s", t.split_first_last(F.col("full_name")))
    names = lists.select("url", F.explode("names").alias("full_name"))
    contacts = union_contacts(
        found_rows(_emails(lists), "email_found_list", "list page"),
        named_rows(names, site.domain, "card_name_generated", "name from list card", 0.5, 0.25),
        found_rows(_emails(details), "email_found_profile", "profile page"),
        named_rows(split.filter(F.col("_s.first_name").isNotNull()), site.domain, "profile_name_generated", "name from profile", 0.6, 0.3),
    )
    # one list page or profile page gives one row per value, so the method order decides ties
    order = F.array_position(
        F.array(*[F.lit(m) for m in ("email_found_list", "card_name_generated", "email_found_profile", "profile_name_generated")]),
        F.col("method"),
    )
    fresh = M.upsert_contacts(None, contacts.withColumn("seq", order)).select("id", *_SHAPE)
    profiles = split.select(
        F.col("url").alias("source_url"), "full_name", F.col("_s.first_name").alias("first_name"),
        F.col("_s.last_name").alias("last_name"), F.lit(site.university).alias("university"),
        t.blank_to_null(F.col("department")).alias("department"),
    )
    return Directory(fresh, profiles, failed)


def run_counters(directory: Directory) -> DataFrame:
    """Profiles visited and addresses found on them, as one row."""
    found = directory.contacts.select(
        F.lit(0).alias("v"), F.when(F.col("method") == "email_found_profile", 1).otherwise(0).alias("e")
    )
    visited = directory.profiles.select(F.lit(1).alias("v"), F.lit(0).alias("e"))
    return found.unionByName(visited).agg(F.sum("v").alias("profiles_visited"), F.sum("e").alias("emails_on_profiles"))
