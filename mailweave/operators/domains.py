"""Registered domains by a table of suffix rules: a longest-match join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as u

#: Kinds of rules: the suffix itself, every name below it, an exception to such names
EXACT, BELOW, EXCEPT = "exact", "below", "except"


def suffix_rules(rules: DataFrame, rule: str = "rule") -> DataFrame:
    """The public list's rules as ``(suffix, kind)``: ``x``, ``*.x`` (names below x) and ``!y.x`` (but not y.x)."""
    value = F.lower(F.trim(rule))
    kind = F.when(value.startswith("*."), BELOW).when(value.startswith("!"), EXCEPT).otherwise(EXACT)
    return rules.select(F.regexp_replace(value, r"^(\*\.|!)", "").alias("suffix"), kind.alias("kind")).filter("suffix <> ''").distinct()


def registered_domains(df: DataFrame, url: str, rules: DataFrame, out: str = "domain") -> DataFrame:
    """P1 for rules of any number: ``df`` with the registered domain of ``url`` in the column ``out``.

    Each distinct host is cut at its dots, its endings meet the rules in an equi-join, and the longest match counts:
    an exception before all others, the last label where no rule fits. Equal to
    :func:`mailweave.functions.urls.registered_domain`, whose rules are constants of the plan.
    """
    host = u.host(F.col(url))
    hosts = df.select(host.alias("_host")).filter(F.col("_host").isNotNull()).distinct().withColumn("_labels", F.split("_host", r"\."))
    n = F.size("_labels")

    def ending(labels: Column) -> Column:
        return F.array_join(F.slice("_labels", n - labels + 1, labels), ".")

    endings = hosts.select("_host", n.alias("_n"), F.posexplode(F.transform(F.sequence(F.lit(1), n), ending)).alias("_at", "suffix"))
    hits = endings.join(rules.select("suffix", "kind"), "suffix").withColumn("_i", F.col("_at") + 1)
    size = F.when(F.col("kind") == BELOW, F.col("_i") + 1).otherwise(F.col("_i"))
    best = hits.groupBy("_host").agg(
        F.max(F.when(F.col("kind") == EXCEPT, F.col("_i") - 1)).alias("_except"),
        F.max(F.when((F.col("kind") != EXCEPT) & (size < F.col("_n")), size)).alias("_longest"),
    )
    longest = F.coalesce("_except", "_longest", F.lit(1))
    named = hosts.join(best, "_host", "left").select("_host", F.when(n > 1, ending(longest + 1)).otherwise(F.col("_host")).alias(out))
    return df.withColumn("_host", host).join(named, "_host", "left").select(*df.columns, out)
