"""Q2: contacts and profiles -> the CRM import table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as t
from ..operators import dedup
from ..operators import merge as M
from ..schemas import CRM

_EMPTY = ("first_open", "last_open", "first_click", "last_click", "last_ip", "last_ua", "last_clicked_url")


def preferred(field: str) -> Column:
    """A profile's field before the contact's."""
    return F.coalesce("prof_" + field, field)


def preferred_fields(joined: DataFrame) -> DataFrame:
    """Found before generated address, profile before contact fields, defaults last."""
    first, last, full = (preferred(field) for field in ("first_name", "last_name", "full_name"))
    split = t.split_first_last(full)
    need = first.isNull() & last.isNull() & full.isNotNull()
    return joined.withColumns(
        {
            "_email": F.coalesce("email_found", "email_generated"),
            "_first": F.when(need, split["first_name"]).otherwise(first),
            "_last": F.when(need, split["last_name"]).otherwise(last),
            "_full": full,
        }
    )


def default_columns(university: str) -> dict[str, Column]:
    """Profile fields and fixed values of the CRM table, with what stands where nothing is known."""
    blank = F.lit("")
    return {
        "Universidad": F.coalesce("prof_university", F.lit(university)),
        "Departamento": F.coalesce("prof_department", blank),
        "Desuscrito": F.lit("FALSE"),
        "Enviado": F.lit("FALSE"),
        "open_count": F.lit(0),
        "click_count": F.lit(0),
        **{c: blank for c in _EMPTY},
    }


def crm_rows(contacts: DataFrame, profiles: DataFrame, university: str, found_only: bool = False) -> DataFrame:
    """The CRM columns for every contact, before de-duplication."""
    if found_only:  # leave guessed addresses out
        contacts = contacts.filter(F.col("email_found").isNotNull())
    j = preferred_fields(M.with_profiles(contacts, profiles))
    blank = F.lit("")
    columns = {
        "id": ids.crm_id(F.col("_email"), F.col("_full"), F.col("source_url")),
        "Nombre": F.coalesce("_first", blank),
        "Apellidos": F.coalesce("_last", blank),
        "Email": F.coalesce("_email", blank),
        **default_columns(university),
    }
    rank = [(F.col("_full").isNull()).alias("_unnamed"), (-F.coalesce("confidence", F.lit(0.0))).alias("_doubt"), F.coalesce(j["id"], blank).alias("_cid")]
    return j.select(*[columns[f.name].alias(f.name) for f in CRM], *rank)


def export_crm(contacts: DataFrame, profiles: DataFrame, university: str, found_only: bool = False) -> DataFrame:
    """Q2. Ties are settled by: has a name, confidence, contact id."""
    rows = crm_rows(contacts, profiles, university, found_only)
    best = dedup.best_crm_row(rows, ["_unnamed", "_doubt", "_cid"])
    return best.orderBy("_k").select(*[f.name for f in CRM])
