"""Robots rules as a table, applied to URLs with an equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as u


def rules_for_agent(rules: DataFrame, user_agent: str) -> DataFrame:
    """Per host the rule group that applies: the first one named in the agent, else ``*``."""
    product = user_agent.split("/")[0].lower()
    agent = F.lower("agent")
    named = (agent != "*") & F.contains(F.lit(product), agent)
    usable = rules.filter(named | (agent == "*")).withColumn("_agent", agent)
    rank = F.struct((agent == "*").alias("star"), F.col("rule_no"))
    chosen = usable.groupBy("host").agg(F.min_by("_agent", rank).alias("_chosen"))
    return (
        usable.join(chosen, "host")
        .filter(F.col("_agent") == F.col("_chosen"))
        # an empty disallow line allows everything
        .select("host", "path_prefix", (F.col("allow") | (F.col("path_prefix") == "")).alias("allow"), "rule_no")
    )


def prepared(rules: DataFrame, user_agent: str = "*") -> DataFrame:
    """``(_host, _prefix, _allow)``: for each host with readable rules the empty prefix and those of its rules, with what holds for the
    paths whose longest prefix it is: the first rule, in their order, that this prefix begins with. Linear in the rules, however many a host has.
    """
    mine = rules_for_agent(rules, user_agent).filter(F.col("path_prefix").isNotNull())
    rank = F.struct("rule_no", "path_prefix", "allow")
    first = mine.groupBy("host", F.col("path_prefix").alias("_prefix")).agg(F.min(rank).alias("_rule"))
    hosts = rules.filter(F.col("host").isNotNull()).select("host").distinct()
    places = first.select("host", "_prefix").unionByName(hosts.withColumn("_prefix", F.lit(""))).distinct()
    lengths = first.groupBy("host").agg(F.collect_set(F.length("_prefix")).alias("_lengths"))  # at most the longest prefix
    shorter = F.explode_outer(F.filter("_lengths", lambda n: n <= F.length("_prefix"))).alias("_n")
    begins = places.join(lengths, "host", "left").select("host", F.col("_prefix").alias("_at"), "_prefix", shorter)
    begins = begins.withColumn("_prefix", F.substr("_prefix", F.lit(1), F.col("_n")))
    decided = begins.join(first, ["host", "_prefix"], "left").groupBy("host", "_at").agg(F.min("_rule").alias("_rule"))
    return decided.select(F.col("host").alias("_host"), F.col("_at").alias("_prefix"), F.coalesce("_rule.allow", F.lit(True)).alias("_allow"))


def allowed_by(urls: DataFrame, prepared: DataFrame, url: str = "url") -> DataFrame:
    """Keep the URLs that :func:`prepared` rules allow: one join on the host and the beginnings of the path.

    The first rule whose prefix starts the path decides; no match means allowed, and hosts
    without readable rules are blocked. A URL is tried at the lengths that prefixes have and its longest one counts, so the
    work grows with the URLs, not with a host's rules. URLs of one host share its empty prefix: a skewed
    join, which adaptive execution splits.
    """
    lengths = sorted(r[0] for r in prepared.select(F.length("_prefix")).distinct().collect())  # at most the longest prefix
    path = F.coalesce(u.path_and_query(F.col(url)), F.lit(""))
    rows = urls.withColumns({"_host": u.host(F.col(url)), "_path": path})
    tried = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("_path"))
    rows = rows.select("*", F.explode(tried).alias("_n")).withColumn("_prefix", F.substr("_path", F.lit(1), F.col("_n")))
    longest = F.rank().over(Window.partitionBy(url).orderBy(F.desc("_n")))  # equal URLs rank alike
    found = rows.join(prepared, ["_host", "_prefix"]).withColumn("_rank", longest)
    return found.filter((F.col("_rank") == 1) & F.col("_allow")).select(*urls.columns)


def allowed(urls: DataFrame, rules: DataFrame, user_agent: str = "*", url: str = "url") -> DataFrame:
    """Keep the URLs that their host's rules allow; see :func:`allowed_by`."""
    return allowed_by(urls, prepared(rules, user_agent), url)
