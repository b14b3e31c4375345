"""Addresses from markup and text, and the address -> pages index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import emails as em
from ..session import cut_lineage
from . import html as H
from . import lookup as L


def usable_pages(pages: DataFrame) -> DataFrame:
    """Successful HTML responses, where the table records status and type."""
    if "status" in pages.columns:
        pages = pages.filter(F.col("status") == 200)
    if "content_type" in pages.columns:
        pages = pages.filter(F.contains("content_type", F.lit("text/html")))
    return pages


def pages_among(pages: DataFrame, keys: DataFrame, column: str = "url") -> DataFrame:
    """Rows of ``pages`` whose ``column`` is in ``keys`` (one column of that name), in one scan of their HTML."""
    return L.rows_among(pages, keys, column)


def emails_at_domain(pages: DataFrame, domain: str, keys=("page_id", "url"), text: str = "html") -> DataFrame:
    """Distinct lower-cased addresses of one domain in the raw markup."""
    found = em.find_distinct_lower(F.col(text), em.domain_email_pattern(domain))
    # a plain substring test spares most texts the pattern with its word boundaries
    likely = pages.filter(F.contains(F.lower(text), F.lit("@" + domain.lower())))
    return likely.select(*keys, F.explode(found).alias("email"))


def emails_in(df: DataFrame, text: str, keys=()) -> DataFrame:
    """Distinct lower-cased addresses of any domain, per row."""
    return df.filter(F.contains(text, F.lit("@"))).select(*keys, F.explode(em.find_distinct_lower(F.col(text))).alias("email"))


def emails_in_text(df: DataFrame, text: str, keys=()) -> DataFrame:
    """Every address in order, duplicates and case kept."""
    return df.filter(F.contains(text, F.lit("@"))).select(*keys, F.posexplode(em.find_all(F.col(text))).alias("idx", "email"))


def clean_emails_in_text(df: DataFrame, text: str, domains, keys=(), strict: bool = True) -> DataFrame:
    """X9, cleaned and restricted to the institution's domains."""
    rows = emails_in_text(df, text, keys)
    cleaned = em.clean_domain_email(F.col("email"), domains, strict)
    return rows.withColumn("email", cleaned).filter(F.col("email").isNotNull())


def mailto_emails(doc: DataFrame, keys=("page_id", "url")) -> DataFrame:
    """X11: addresses of ``mailto:`` links without parameters, lower case."""
    links = H.anchors(doc, keys).filter(F.trim("href").startswith("mailto:"))
    return links.select(*keys, "pos", em.clean_email(F.col("href")).alias("email")).filter(F.col("email").isNotNull())


def url_pairs(pairs: DataFrame, email: str = "email", url: str = "url") -> DataFrame:
    """The index itself: distinct ``(email, url)`` rows, of bounded width at every size."""
    return pairs.select(F.col(email).alias("email"), F.col(url).alias("url")).distinct()


def url_sets(pairs: DataFrame, email: str = "email", url: str = "url", urls_per_row: int = 100_000) -> DataFrame:
    """``(email, part, urls)``: the sorted URLs of each address, in parts of ``urls_per_row``.

    ``part`` counts from 0 and is always there: part p holds the URLs of rank p * ``urls_per_row`` and on, so parts
    in order are the whole sorted list, and an address on few pages has part 0 alone. The pairs are sorted once over the
    whole cluster, which spreads an address that stands on very many pages; an address's ranks then follow from how many
    of its URLs earlier partitions hold.
    """
    ranged = url_pairs(pairs, email, url).repartitionByRange("email", "url").sortWithinPartitions("email", "url")
    placed = cut_lineage(ranged.select("email", "url", F.spark_partition_id().alias("_at"), F.monotonically_increasing_id().alias("_id")))
    earlier = Window.partitionBy("email").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("email", "_at").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = first.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    rank = F.col("_before") + F.col("_id") - F.col("_first")
    parts = placed.join(first, ["email", "_at"]).select("email", "url", F.floor(rank / urls_per_row).alias("part"))
    return parts.groupBy("email", "part").agg(F.array_sort(F.collect_list("url")).alias("urls"))


def inverted_index(pairs: DataFrame, email: str = "email", url: str = "url", urls_per_row: int = 100_000) -> DataFrame:
    """The sink form of :func:`url_sets`, ``(email, part, found_on_urls)`` with the URLs joined by `` | ``."""
    return url_sets(pairs, email, url, urls_per_row).select("email", "part", F.array_join("urls", " | ").alias("found_on_urls"))
