"""Counts, coverage and top-k reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import cut_lineage


def row_count(df: DataFrame) -> DataFrame:
    """A1."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, *columns: str, approximate: bool = False) -> DataFrame:
    """A2: exact distinct counts, NULL not counted; HyperLogLog on request."""
    fn = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[fn(F.col(c)).alias(c) for c in columns])


def null_counts(df: DataFrame, column: str) -> DataFrame:
    """A3."""
    return df.agg(F.count(column).alias("with_value"), F.count_if(F.col(column).isNull()).alias("without_value"))


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    """A4."""
    return df.select(*columns).distinct()


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """A5: NULL dropped, most frequent first, ties by value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(column))


def top_k(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k largest groups (a distributed top-k, not a full sort)."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(column)).limit(k)


def bottom_k(df: DataFrame, column: str, k: int) -> DataFrame:
    """L4: the tail of the frequency table, still in descending order."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.asc("n"), F.desc(column)).limit(k).orderBy(F.desc("n"), F.asc(column))


def coverage(df: DataFrame, group: str = "departamento", name: str = "profesor", email: str = "email") -> DataFrame:
    """A6 + L5: per-group share of named rows, one decimal, half to even."""
    share = F.bround(F.lit(100.0) * F.count(name) / F.count(F.lit(1)), 1)
    out = df.filter(F.col(group).isNotNull()).groupBy(group).agg(share.alias("%_con_nombre"), F.count(email).alias("total"))
    return out.orderBy(F.desc("%_con_nombre"), F.asc(group))


def is_named(name: Column, mailbox: str = "Departamento") -> Column:
    """A10."""
    return name.isNotNull() & (name != "") & (name != mailbox)


def named_counts(df: DataFrame, name: str = "profesor", mailbox: str = "Departamento") -> DataFrame:
    """A10: named and unnamed rows."""
    named = is_named(F.col(name), mailbox)
    return df.agg(F.count_if(named).alias("con_nombre"), F.count_if(~named).alias("sin_nombre"))


def counters(df: DataFrame, **tests: Column) -> DataFrame:
    """How many rows meet each test, as one row, in one pass."""
    return df.agg(*[F.count_if(F.coalesce(test, F.lit(False))).alias(name) for name, test in tests.items()])


def counted_step(before: DataFrame, step: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """A step's result, written down, and how many rows it removed as ``(before, after, removed)``.

    Both figures are observed while the step runs, so nothing runs twice.
    """
    seen, left = Observation(), Observation()
    rows = F.count(F.lit(1)).alias("rows")
    after = cut_lineage(step(before.observe(seen, rows)).observe(left, rows))
    counts = seen.get["rows"], left.get["rows"]
    figures = before.sparkSession.createDataFrame([(*counts, counts[0] - counts[1])], "before long, after long, removed long")
    return after, figures


def quality_summary(df: DataFrame) -> DataFrame:
    """Five figures over the final table in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("total_registros"),
        F.count_distinct("email").alias("emails_unicos"),
        F.count("profesor").alias("profesores_con_nombre"),
        F.count_if(F.col("profesor").isNull()).alias("profesores_sin_nombre"),
        F.count_distinct("departamento").alias("departamentos_unicos"),
    )


def inferred_count(df: DataFrame, before: str, after: str) -> DataFrame:
    """Names that were missing and could be inferred."""
    return df.agg(F.count_if(F.col(before).isNull() & F.col(after).isNotNull()).alias("inferred"))


def head(df: DataFrame, order, n: int) -> DataFrame:
    """The first n rows in a stated order."""
    return df.orderBy(*order).limit(n)
