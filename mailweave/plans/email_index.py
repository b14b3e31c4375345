"""Q3: walk a site and list on which pages each address stands."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import emails as em
from ..functions import urls as u
from ..operators import extract as X
from ..operators import html as H
from ..operators import walk as W
from ..session import cut_lineage
from ..siteprofile import SiteProfile


@dataclass
class EmailIndex:
    index: DataFrame  # email, part, found_on_urls, sorted by address
    visited: DataFrame
    failed: DataFrame  # pages that could not be parsed, by reason


def email_index(
    pages: DataFrame,
    seeds: DataFrame,
    site: SiteProfile,
    rules: DataFrame | None,
    max_pages: int | None = 200,
    user_agent: str = "*",
) -> EmailIndex:
    """``seeds``: ``(url, seed_no)``.

    The site's pages are read and parsed once. What the walk and the index need of them is written down: links,
    addresses in the markup, and those of ``mailto:`` links, where entities may hide them. HTML stays behind.
    """
    pages = X.usable_pages(pages).select("page_id", "url", "html")
    inside = pages.filter(u.is_internal(F.col("url"), site.domain, site.strict))
    doc = H.dom(inside.withColumn("emails", em.find_distinct_lower(F.col("html"))), parts=("nodes", "clean"))
    facts = cut_lineage(doc.select("url", "emails", H.anchor_structs("").alias("links"), "_error"))
    links = W.co_locate(W.links_of(facts.select("url", F.inline("links")), site.base_url))
    visited = W.walk_site(links, seeds.selectExpr("'all' AS walk", "url", "seed_no"), site.domain, rules, user_agent, max_pages, site.strict)
    reached = facts.join(visited.select("url"), "url", "left_semi")
    mailto = F.transform(F.filter("links", lambda a: F.trim(a["href"]).startswith("mailto:")), lambda a: em.clean_email(a["href"]))
    pairs = reached.select("url", F.explode(F.concat("emails", mailto)).alias("email")).filter(F.col("email").isNotNull())
    return EmailIndex(X.inverted_index(pairs).orderBy("email", "part"), visited, H.parse_errors(facts))
