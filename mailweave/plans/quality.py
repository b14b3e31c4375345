"""Q8: the quality report as one long table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import emails as em
from ..operators import report
from ..siteprofile import MALFORMED_SUFFIXES


def foreign_contacts(final: DataFrame, domain: str, strict: bool = True) -> DataFrame:
    """P11."""
    return final.filter(em.foreign(F.col("email"), domain, strict))


def malformed_sample(raw: DataFrame, n: int = 10, seq: str = "seq", suffixes=MALFORMED_SUFFIXES) -> DataFrame:
    """The first raw addresses with glued text (a sample by design)."""
    return raw.filter(em.malformed(F.col("email"), suffixes)).orderBy(seq).select(seq, "email").limit(n)


def quality_report(final: DataFrame, domain: str, strict: bool = True) -> DataFrame:
    """``(section, item, value)``: summary figures, foreign and glued addresses, coverage.

    Two passes over ``final``: one grouped by department, from which all but the exact
    distinct count of addresses follows, and one for that count.
    """
    email = F.col("email")
    glued = em.malformed(email, [s.lower() for s in MALFORMED_SUFFIXES])
    by_dept = final.groupBy("departamento").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("profesor").alias("named"),
        F.count("email").alias("total"),
        F.count_if(em.foreign(email, domain, strict)).alias("foreign"),
        F.count_if(glued).alias("malformed"),
    )
    figures = by_dept.agg(
        F.sum("n").alias("total_registros"),
        F.sum("named").alias("profesores_con_nombre"),
        (F.sum("n") - F.sum("named")).alias("profesores_sin_nombre"),
        F.count("departamento").alias("departamentos_unicos"),
        F.sum("foreign").alias("foreign_emails"),
        F.sum("malformed").alias("malformed_emails"),
    )
    unique = final.agg(F.count_distinct("email").alias("emails_unicos"))
    share = F.bround(F.lit(100.0) * F.col("named") / F.col("n"), 1)
    per_dept = by_dept.filter(F.col("departamento").isNotNull()).select(
        F.inline(
            F.array(
                F.struct(F.lit("coverage").alias("section"), F.col("departamento").alias("item"), share.alias("value")),
                F.struct(F.lit("size").alias("section"), F.col("departamento").alias("item"), F.col("total").cast("double").alias("value")),
            )
        )
    )
    return _long(figures).unionByName(_long(unique)).unionByName(per_dept)


def _long(one_row: DataFrame) -> DataFrame:
    """A one-row table as ``(section, item, value)`` rows."""
    items = [F.struct(F.lit("summary").alias("section"), F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in one_row.columns]
    return one_row.select(F.inline(F.array(*items)))
