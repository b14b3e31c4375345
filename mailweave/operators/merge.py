"""Upserts, keyed merges and the joins of the contact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from . import dedup

PROFILE_VALUES = ("full_name", "first_name", "last_name", "university", "department")


def with_contact_id(df: DataFrame) -> DataFrame:
    cid = ids.contact_id(F.col("source_url"), F.col("full_name"), F.col("email_found"), F.col("email_generated"))
    return df.withColumn("id", cid)


def upsert_contacts(stored: DataFrame | None, new: DataFrame, seq: str = "seq") -> DataFrame:
    """M1: insert, do nothing on conflict. Returns the rows to append.

    ``new`` needs no id; rows that exist already, or that came earlier in the same
    batch, are left out.
    """
    fresh = dedup.first_contact_by_id(with_contact_id(new), seq)
    if stored is None:
        return fresh
    return fresh.join(stored.select("id"), "id", "left_anti").select(*fresh.columns)


def upsert_profiles(stored: DataFrame | None, new: DataFrame, seq: str = "seq") -> DataFrame:
    """M2: insert, or set each column to the newest value that is not NULL."""
    log = new.select("source_url", *PROFILE_VALUES, F.col(seq).cast("long").alias("_seq"))
    if stored is not None:
        old = stored.select("source_url", *PROFILE_VALUES).withColumn("_seq", F.lit(None).cast("long"))
        # stored values are older than anything new, whatever numbers the batch uses
        log = old.unionByName(log)
    order = F.struct(F.col("_seq").isNotNull(), F.col("_seq"))
    picks = [F.max_by(v, F.when(F.col(v).isNotNull(), order)).alias(v) for v in PROFILE_VALUES]
    return log.groupBy("source_url").agg(*picks)


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """P18."""
    return df.select([F.col(c).alias(prefix + c) for c in df.columns])


def with_profiles(contacts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles are unique per ``source_url``, so nothing fans out."""
    right = prefixed(profiles, "prof_")
    return contacts.join(right, F.col("source_url") == F.col("prof_source_url"), "left")


def map_departments(df: DataFrame, dep_map: DataFrame, column: str = "departamento", out: str = "departamento_clean") -> DataFrame:
    """Id -> name with the id itself as fallback."""
    lookup = dep_map.select(F.col("dep_id").alias("_dep_id"), F.col("nombre").alias("_nombre"))
    joined = df.join(lookup, F.col(column) == F.col("_dep_id"), "left")
    return joined.withColumn(out, F.coalesce("_nombre", column)).drop("_dep_id", "_nombre")


def add_unseen(old: DataFrame, new: DataFrame, key: str = "correo") -> DataFrame:
    """Append the rows of ``new`` whose key is not in ``old``."""
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(*old.columns))


def unseen(new: DataFrame, seen: DataFrame, key: str = "email") -> DataFrame:
    """Rows whose key was not seen before."""
    return new.join(seen.select(key), key, "left_anti").select(*new.columns)


def missing_keys(ids_df: DataFrame, dep_map: DataFrame, column: str = "departamento") -> DataFrame:
    """Distinct ids that the map does not know yet."""
    wanted = ids_df.select(F.col(column).alias("dep_id")).filter(F.col("dep_id").isNotNull()).distinct()
    return wanted.join(dep_map.select("dep_id"), "dep_id", "left_anti")


def default_department_name(dep_id: Column) -> Column:
    """``Departamento_<id>`` for unresolved numeric ids, other ids stand for themselves."""
    return F.when(dep_id.rlike("^[0-9]+$"), F.concat(F.lit("Departamento_"), dep_id)).otherwise(dep_id)


def update_map(old: DataFrame, new: DataFrame) -> DataFrame:
    """U4: new entries override old ones."""
    o = old.select("dep_id", F.col("nombre").alias("_old"))
    n = new.select("dep_id", F.col("nombre").alias("_new"))
    return o.join(n, "dep_id", "full_outer").select("dep_id", F.coalesce("_new", "_old").alias("nombre"))


def complete_map(dep_map: DataFrame, from_list: DataFrame, from_pages: DataFrame | None, contacts: DataFrame) -> DataFrame:
    """Bring the map up to date: list entries, then single pages, then generated names."""
    updated = update_map(dep_map, from_list)
    gap = missing_keys(contacts, updated)
    if from_pages is None:
        named = gap.withColumn("nombre", default_department_name(F.col("dep_id")))
    else:
        found = from_pages.select("dep_id", F.col("nombre").alias("_page"))
        named = gap.join(found, "dep_id", "left").select(
            "dep_id",
            F.coalesce(F.when(F.col("dep_id").rlike("^[0-9]+$"), F.col("_page")), default_department_name(F.col("dep_id"))).alias("nombre"),
        )
    return updated.unionByName(named)
