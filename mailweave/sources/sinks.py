"""Sinks. Sorted ones range-partition, so files are written in parallel and read back in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from ..functions import text as t


def clean_order() -> list[Column]:
    """L2: by department, rows with a name first."""
    return [F.asc("departamento"), F.asc_nulls_last("profesor"), F.asc("email")]


def write_csv(df: DataFrame, path: str, order=None, mode: str = "overwrite") -> None:
    """K1-K5: CSV with header, in the stated order; quotes are doubled as usual."""
    ordered = df.orderBy(*order) if order else df
    _csv_writer(ordered, mode).csv(path)


def _csv_writer(df: DataFrame, mode: str) -> DataFrameWriter:
    writer = df.write.mode(mode).option("header", True).option("escape", '"')
    # keep empty strings and NULL alike as empty fields, and blanks as they are
    writer = writer.option("emptyValue", "").option("ignoreLeadingWhiteSpace", False)
    return writer.option("ignoreTrailingWhiteSpace", False)


def write_email_index(index: DataFrame, path: str) -> None:
    """K1: address and joined URLs, sorted by address; rows of one address follow each other in order of their parts."""
    order = ["email", "part" if "part" in index.columns else "found_on_urls"]
    ordered = index.orderBy(*order).select("email", "found_on_urls")
    write_csv(ordered, path)


def write_contacts(contacts: DataFrame, path: str) -> None:
    """K2: three columns sorted by address."""
    write_csv(contacts.select("nombre", "correo", "departamento"), path, ["correo"])


def write_arrival_order(contacts: DataFrame, path: str, order) -> None:
    """K3: department, name, address in order of arrival."""
    cols = ["departamento", "profesor", "email"]
    ordered = contacts.orderBy(*order).select(*cols)
    write_csv(ordered, path)


def write_raw(contacts: DataFrame, path: str) -> None:
    """K4: every stored contact."""
    write_csv(contacts, path)


def write_crm(crm: DataFrame, path: str) -> None:
    """K5: the CRM export, in the order of its de-duplication key."""
    write_csv(crm, path, [F.coalesce(t.blank_to_null(F.col("Email")), F.col("id"))])


def with_name(df: DataFrame, name: str = "profesor") -> DataFrame:
    """The rows that have a name."""
    return df.filter(F.col(name).isNotNull())


def write_clean(final: DataFrame, path: str) -> None:
    """K6: all rows, and among them those with a name, in one write of one sort.

    Ranges of the order become tasks, and each writes its rows with a name to ``has_name=true`` and the others to
    ``has_name=false``. Files keep the order by their names in both folders; see
    :func:`mailweave.sources.tables.read_clean`.
    """
    ranged = final.withColumn("has_name", F.col("profesor").isNotNull()).repartitionByRange(*clean_order())
    _csv_writer(ranged.sortWithinPartitions("has_name", *clean_order()), "overwrite").partitionBy("has_name").csv(path)


def write_department_map(dep_map: DataFrame, path: str, changed: DataFrame | None = None) -> bool:
    """K7: the id -> name map, one ``{id: name}`` object per line, only when something changed.

    :func:`mailweave.sources.tables.read_department_map` reads it back.
    """
    if changed is not None and changed.isEmpty():
        return False
    rows = dep_map.filter(F.col("dep_id").isNotNull())
    rows.select(F.to_json(F.create_map("dep_id", "nombre")).alias("value")).write.mode("overwrite").text(path)
    return True
