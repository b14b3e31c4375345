"""Breadth-first walks over a stored link graph.

One DataFrame step per level; the driver only holds the loop. Queue order is the
page's ``trail``: the seed number followed by the anchor position taken at each
step. Trails compare element by element, so within one level they sort exactly as a
first-in-first-out queue would have served them, and no global numbering is needed.
Levels are written to the shared checkpoint folder, so a lost executor costs one
level at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as u
from ..session import cut_lineage, ensure_checkpoint_dir
from . import dedup
from . import html as H
from . import robots as R

Filter = Callable[[DataFrame], DataFrame]


def page_links(doc_or_pages: DataFrame, parsed: bool = True, base_url: str | None = None, sep: str = "") -> DataFrame:
    """Edges ``(url, target, href, text, pos)``: each page's links, first position per target."""
    if parsed:
        rows = H.anchors(doc_or_pages, ("url",), sep)
    else:
        rows = H.anchor_links(doc_or_pages, ("url",)).withColumn("text", F.lit(""))
    return links_of(rows, base_url)


def links_of(rows: DataFrame, base_url: str | None = None) -> DataFrame:
    """Edges from anchors ``(url, href, text, pos)``; mail links are none."""
    rows = rows.withColumn("href", F.trim("href")).filter(~F.col("href").startswith("mailto:"))
    base = F.col("url") if base_url is None else F.lit(base_url)
    return rows.select("url", u.url_join(base, F.col("href")).alias("target"), "href", "text", "pos")


def co_locate(table: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Hash and sort a table by its keys (``url``) once, so that joins on them only move the other side.

    Adaptive execution hides how a checkpointed table is laid out, which would shuffle all of it again at every
    join. The write is planned by a session of its own without it; use the result as the right side of joins.
    """
    spark, keys = table.sparkSession, keys or ("url",)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/co-located-{uuid.uuid4().hex}"
    table.write.parquet(path)
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.enabled", "false")
    return cut_lineage(own.read.schema(table.schema).parquet(path).repartition(n, *keys).sortWithinPartitions(*keys))


class _Visited:
    """Pages visited so far, only ever added to. Levels that are not merged yet stay as they are; ``fan`` of them are
    laid out by page as one run, and ``fan`` runs of one size as the next larger, so that a row is rewritten a few
    times in a walk of any length and a level's look-ups move its frontier alone."""

    def __init__(self, fan: int = 8):
        self.fan, self.levels, self.runs = fan, [], []

    def add(self, level: DataFrame) -> None:
        self.levels.append(level)
        if len(self.levels) == self.fan:
            self.runs.append((1, self._merged(self.levels)))
            self.levels = []
            while len(self.runs) >= self.fan and len({size for size, _ in self.runs[-self.fan :]}) == 1:
                last = self.runs[-self.fan :]
                self.runs[-self.fan :] = [(last[0][0] * self.fan, self._merged([run for _, run in last]))]

    @staticmethod
    def _merged(parts: list[DataFrame]) -> DataFrame:
        return co_locate(reduce(DataFrame.unionByName, parts), "walk", "url")

    def parts(self) -> list[DataFrame]:
        return [run for _, run in self.runs] + self.levels

    def without(self, pages: DataFrame) -> DataFrame:
        for part in self.parts():
            pages = pages.join(part.select("walk", "url"), ["walk", "url"], "left_anti")
        return pages


def walk(
    links: DataFrame,
    seeds: DataFrame,
    max_pages: int | None,
    admit: Filter | None = None,
    follow: Column | None = None,
    compact_every: int = 8,
) -> DataFrame:
    """Visit pages level by level: ``(walk, url, level, trail, ord)``.

    ``links``: ``(url, target, pos, …)``. ``seeds``: ``(walk, url, seed_no)``; all walks
    run in one plan. ``max_pages`` counts every page taken from the queue, found or
    not, per walk. ``admit`` filters what may be taken from the queue without using up
    budget; ``follow`` says which edges are pursued and may use ``ord`` (the page's
    visit number from 1, only with a cap), the edge's columns and the walk's columns. So many levels as
    ``compact_every`` says, two at least, are laid out together.
    """
    extra = [c for c in seeds.columns if c not in ("walk", "url", "seed_no")]
    trail = F.array(F.col("seed_no").cast("int"))
    frontier = dedup.first_per_key(seeds.select("walk", "url", *extra, trail.alias("trail")), ["walk", "url"], "trail")
    visited, used = _Visited(max(2, compact_every)), None
    for level in count():  # an empty frontier ends it
        if admit is not None:
            frontier = admit(frontier)
        if max_pages is not None:
            frontier = dedup.first_n_per_key(frontier, "walk", "trail", max_pages, rank="_r")
            if used is not None:
                frontier = frontier.join(used, "walk").withColumn("_r", F.col("_used") + F.col("_r"))
            frontier = frontier.withColumn("ord", F.col("_r").cast("int")).filter(F.col("ord") <= max_pages)
        else:
            frontier = frontier.withColumn("ord", F.lit(None).cast("int"))
        current = cut_lineage(frontier.select("walk", "url", *extra, F.lit(level).alias("level"), "trail", "ord"))
        if current.isEmpty():
            break
        visited.add(current)
        # a walk that goes on has pages in this level, and its last number is what it has used up
        used = current.groupBy("walk").agg(F.max("ord").alias("_used"))
        frontier = visited.without(_discovered(current, links, follow, extra))
    return reduce(DataFrame.unionByName, visited.parts(), current).select("walk", "url", *extra, "level", "trail", "ord")


def _discovered(current: DataFrame, links: DataFrame, follow: Column | None, extra) -> DataFrame:
    """J7 then J6: targets of this level's pages, first discovery first."""
    hops = current.join(links, "url")
    if follow is not None:
        hops = hops.filter(follow)
    found = hops.select("walk", F.col("target").alias("url"), *extra, F.concat("trail", F.array(F.col("pos").cast("int"))).alias("trail"))
    return dedup.first_per_key(found, ["walk", "url"], "trail")


def walk_site(
    links: DataFrame,
    seeds: DataFrame,
    domain: str,
    rules: DataFrame | None = None,
    user_agent: str = "*",
    max_pages: int | None = 1000,
    strict: bool = True,
) -> DataFrame:
    """G1: one walk over a domain; external and blocked pages use up no budget.

    Robots rules apply whenever given. A walk without rules must be a deliberate
    choice of the caller.
    """

    prepared = None if rules is None else cut_lineage(R.prepared(rules, user_agent))

    def admit(frontier: DataFrame) -> DataFrame:
        inside = frontier.filter(u.is_internal(F.col("url"), domain, strict))
        return inside if prepared is None else R.allowed_by(inside, prepared)

    follow = u.usable_href(F.col("href")) & u.is_internal(F.col("target"), domain, strict)
    return walk(links, seeds, max_pages, admit, follow)


def _start_hosts(starts: DataFrame, key: str, url: str) -> DataFrame:
    rows = starts.filter(F.col(url).isNotNull() & (F.col(url) != ""))
    return rows.select(F.col(key).alias("walk"), F.col(url).alias("url"), F.lit(0).alias("seed_no"), u.netloc(F.col(url)).alias("home"))


def walk_hosts(links: DataFrame, starts: DataFrame, key: str = "dept_url", url: str = "web", max_pages: int | None = 40) -> DataFrame:
    """One walk per department inside the host it starts on."""
    return walk(links, _start_hosts(starts, key, url), max_pages, None, u.netloc(F.col("target")) == F.col("home"))


def walk_relevant(
    links: DataFrame, starts: DataFrame, keywords, key: str = "dept_url", url: str = "web", max_pages: int = 50, free_pages: int = 10
) -> DataFrame:
    """Like G2, but after the first pages only links with a staff word are pursued."""
    relevant = u.has_keyword(keywords, F.col("text"), F.col("href")) | (F.col("ord") < free_pages)
    return walk(links, _start_hosts(starts, key, url), max_pages, None, (u.netloc(F.col("target")) == F.col("home")) & relevant)
