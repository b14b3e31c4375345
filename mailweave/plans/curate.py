"""Q7: raw department contacts -> the clean table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import emails as em
from ..functions import text as t
from ..operators import dedup
from ..operators import departments as DP
from ..operators import merge as M
from ..session import cut_lineage
from ..siteprofile import SiteProfile
from ..sources import sinks


def cleaned(contacts: DataFrame) -> DataFrame:
    """Valid addresses only, tidy names."""
    rows = contacts.withColumn("email_clean", em.clean_email(F.col("email"))).filter(F.col("email_clean").isNotNull())
    return rows.withColumn("profesor_clean", t.clean_name(F.col("profesor")))


def with_inferred_names(df: DataFrame) -> DataFrame:
    """P25: fill missing names from the address."""
    return df.withColumn("profesor_clean", F.coalesce("profesor_clean", t.infer_name(F.col("email_clean"))))


def curate(contacts: DataFrame, dep_map: DataFrame, seq: str = "seq") -> DataFrame:
    """``contacts``: ``(departamento, profesor, email, seq)``; ``dep_map``: ``(dep_id, nombre)``.

    One exchange for the de-duplication, one for the final order; the map is joined
    after duplicates are gone, when fewer rows are left to look up.
    """
    rows = with_inferred_names(cleaned(contacts)).select("departamento", "profesor_clean", "email_clean", seq)
    best = dedup.best_named_per_email(rows, seq=seq)
    return in_order(final_columns(M.map_departments(best, dep_map)))


def final_columns(rows: DataFrame, department: str = "departamento_clean", name: str = "profesor_clean", email: str = "email_clean") -> DataFrame:
    """The columns of the clean table, in their order and under their names."""
    return rows.select(F.col(department).alias("departamento"), F.col(name).alias("profesor"), F.col(email).alias("email"))


def in_order(final: DataFrame) -> DataFrame:
    """L2: by department, named rows first."""
    return final.orderBy(*sinks.clean_order())


def refreshed_map(contacts: DataFrame, dep_map: DataFrame, list_doc: DataFrame, page_doc: DataFrame, site: SiteProfile) -> DataFrame:
    """The id map with the names of the list pages (X20, U4), then of single pages for ids still missing (J11, X21), then generated ones."""
    from_list, from_pages = DP.id_names(list_doc, site), DP.single_page_names(page_doc, site)
    return cut_lineage(M.complete_map(dep_map, from_list, from_pages, contacts))


def curate_and_refresh(
    contacts: DataFrame, dep_map: DataFrame, list_doc: DataFrame, page_doc: DataFrame, site: SiteProfile, map_path: str, seq: str = "seq"
) -> DataFrame:
    """Q7 whole: bring the map up to date, store it if contacts hold ids it did not know (K7), and curate with it.

    ``list_doc``, ``page_doc``: parsed department lists and department pages.
    """
    full = refreshed_map(contacts, dep_map, list_doc, page_doc, site)
    sinks.write_department_map(full, map_path, M.missing_keys(contacts, dep_map))
    return curate(contacts, full, seq)
