"""First-one-wins de-duplication, last-non-null merges and bounded top-n per key.

``dropDuplicates`` does not say which row survives, so each operator takes an
explicit order. The winner is found by an aggregate rather than a window: the
aggregate combines on the map side, so a key that holds a third of all rows
reaches its reducer as one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _cols(items) -> list[Column]:
    items = [items] if isinstance(items, (str, Column)) else list(items)
    return [F.col(i) if isinstance(i, str) else i for i in items]


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the smallest by ``order`` (NULL sorts first)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    payload = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*payload), F.struct(*_cols(order))).alias("_row")
    return df.groupBy(*keys).agg(best).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def first_contact_by_id(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Insert-if-absent on ``id``."""
    return first_per_key(df, "id", seq)


def first_per_page_email(df: DataFrame, page: str = "page_id", email: str = "correo", order=("branch", "idx")) -> DataFrame:
    """W2."""
    return first_per_key(df, [page, email], order)


def first_per_email(df: DataFrame, email: str = "email", order=("dept_no", "page_ord", "branch", "idx")) -> DataFrame:
    """First sighting over all departments."""
    return first_per_key(df.filter(F.col(email).isNotNull() & (F.col(email) != "")), email, order)


def first_named_per_email(df: DataFrame, email: str = "correo", name: str = "nombre", order=("seq",)) -> DataFrame:
    """The first contact, unless it has no name and a later one has."""
    unnamed = F.coalesce(F.col(name), F.lit("")) == ""
    return first_per_key(df, email, [unnamed, *_cols(order)])


def best_named_per_email(df: DataFrame, email: str = "email_clean", name: str = "profesor_clean", seq: str = "seq") -> DataFrame:
    """Named rows first, then the smallest name, then arrival order."""
    return first_per_key(df, email, [F.col(name).isNull(), F.col(name), F.col(seq)])


def url_text_dictionary(df: DataFrame, url: str = "url", text: str = "text", order=("page_id", "pos")) -> DataFrame:
    """The first url of each text, then the last text of each url."""
    first_url = first_per_key(df, text, order)
    rest = [c for c in df.columns if c != url]
    last = F.max_by(F.struct(*rest), F.struct(*_cols(order))).alias("_row")
    return first_url.groupBy(url).agg(last).select(*[F.col(c) if c == url else F.col(f"_row.{c}").alias(c) for c in df.columns])


def best_crm_row(df: DataFrame, order) -> DataFrame:
    """One row per address, or per id where there is no address."""
    key = F.when(F.col("Email") != "", F.col("Email")).otherwise(F.col("id"))
    return first_per_key(df.withColumn("_k", key), "_k", order)


def last_non_null(df: DataFrame, keys, values, seq: str = "seq") -> DataFrame:
    """Per key and column, the latest value that is not NULL."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    picks = [F.max_by(v, F.when(F.col(v).isNotNull(), F.col(seq))).alias(v) for v in values]
    return df.groupBy(*keys).agg(*picks)


def ranked_per_key(df: DataFrame, key: str, order, rank: str = "rank") -> DataFrame:
    """All rows with their rank from 1 in their key, however many rows a key has.

    The rows are sorted once over the whole cluster; a key that spans many ranges is in as many tasks. A row's rank is
    its place in its range and what earlier ranges hold of the key. Equal rows by ``order`` are ranked arbitrarily.
    """
    columns = [F.col(key), *_cols(order)]
    ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    placed = cut_lineage(ranged.withColumn("_at", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    earlier = Window.partitionBy(key).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy(key, "_at").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    joined = placed.join(ranges.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")) & (placed["_at"] == ranges["_at"]))
    return joined.select(*df.columns, (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias(rank))


#: Rows of a key that one task may rank
RANKED_IN_ONE_TASK = 1_000_000


def first_n_per_key(df: DataFrame, key: str, order, n: int, rank: str = "rank", salts: int = 64) -> DataFrame:
    """The first ``n`` rows of every key with their rank from 1.

    Two exact steps: each key's rows are first cut to ``n`` inside ``salts``
    independent slices, so the final window sees at most ``n * salts`` rows per key. Where that is more than
    one task should hold, the ranks come from :func:`ranked_per_key`.
    """
    if n * salts > RANKED_IN_ONE_TASK:
        return ranked_per_key(df, key, order, rank).filter(F.col(rank) <= n)
    order = _cols(order)
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c != key]), F.lit(salts))
    narrow = Window.partitionBy(key, "_salt").orderBy(*order)
    final = Window.partitionBy(key).orderBy(*order)
    cut = df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(narrow)).filter(F.col("_r") <= n)
    return cut.drop("_salt", "_r").withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= n)


def previous_in_group(df: DataFrame, group, order, value: str, out: str = "previous") -> DataFrame:
    """The preceding value inside a (bounded) group such as a table row."""
    return df.withColumn(out, F.lag(value).over(Window.partitionBy(*_cols(group)).orderBy(*_cols(order))))
