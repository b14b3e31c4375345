"""Two-pass external shuffle of records into shards, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load, run_folder, text_bytes

SHARDS = 24
SEED = 20_240_501
BUCKET_BYTES = 32 << 20
BROADCAST_BUCKETS = 100_000
#: Copies of a frequent record that one row stands for while they are dealt out
_COPIES = 1_000


def _draw(key: Column, shard: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key, shard.cast("int"))


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard with the highest seeded hash of key and shard number.

    Only the key and the number of shards decide. A further shard draws against the old
    winner, so it takes keys only into itself. Null is a key like any other.
    """
    draws = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(_draw(key, s, seed).alias("draw"), s.cast("int").alias("shard")))
    return F.array_max(draws)["shard"]


def grown_shard(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard when there is one more."""
    return shard_of(key, shards + 1, seed)


def _size(df: DataFrame) -> Column:
    """Bytes of a record in memory, over all its columns."""
    out = F.lit(16 * (len(df.columns) + 1)).cast("long")
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            out = out + text_bytes(c)
        elif isinstance(field.dataType, (T.ArrayType, T.StructType)):
            out = out + text_bytes(F.to_json(F.struct(c)))
    return out


def _per_shard(numbers: dict[int, int], shards: int, default: int = 1) -> Column:
    """A figure for each shard, looked up by the column ``shard``."""
    return F.element_at(F.array(*[F.lit(numbers.get(s, default)) for s in range(shards)]), F.col("shard") + 1)


def _numbered_copies(rows: DataFrame, bucket_bytes: int, buckets: int) -> DataFrame:
    """``rows`` with ``copy``: 0, but for records so frequent that their copies would fill half a bucket: those are counted
    and dealt out again with a number each, in parts. There are at most two such records for each bucket, so while
    buckets are few the other records go through no exchange here."""
    frequent = rows.groupBy("shard", "mark").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > bucket_bytes // 2).select("shard", "mark")
    if buckets <= BROADCAST_BUCKETS:
        frequent = F.broadcast(frequent)
    same = ["shard", "mark"]
    single = rows.join(frequent, same, "left_anti").withColumn("copy", F.lit(0).cast("long"))
    counted = rows.join(frequent, same, "left_semi").groupBy("shard", "mark", "record", "size").count()
    last = F.floor((F.col("count") - 1) / _COPIES)
    parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition("mark", "part")
    stop = F.least(F.col("count"), (F.col("part") + 1) * _COPIES) - 1
    many = parts.withColumn("copy", F.explode(F.sequence(F.col("part") * _COPIES, stop)))
    return single.unionByName(many.select(single.columns))


def shuffle_into_shards(
    docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Write ``docs`` to ``path`` in ``shards`` shards, each in random order, and return what was written.

    First pass: a seeded hash scatters the records uniformly into buckets, as many per shard as
    keep a bucket near ``bucket_bytes`` of that shard's own records, all columns counted. The shard depends on the key alone
    (:func:`shard_of`); the bucket within it on the whole record and, for records that are repeated very often, on the copy's
    number, so that neither a hot key nor a hot record fills one. Second pass: each bucket is one
    partition, put into a fixed order, permuted in memory (Spark's ``shuffle`` swaps as
    Fisher and Yates do) and written. One bucket per partition and a fixed seed make the order
    repeatable, also when a task runs again after a lost executor.

    Returned: ``record`` (struct of all input columns, so that no name can clash), ``shard int``,
    ``slot long`` (gapless from 0 in its shard). Null texts count no bytes; repeated rows keep their
    number; a record of any length lies in one bucket; an empty table gives an empty result. Map columns have no order and
    are refused by Spark.
    """
    spark = docs.sparkSession
    everything = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(
        F.struct(*everything).alias("record"),
        shard_of(F.col(f"`{key}`"), shards, seed).alias("shard"),
        F.xxhash64(F.lit(seed + 1), *everything).alias("mark"),
        _size(docs).alias("size"),
    )
    # one row for each shard
    buckets = {r[0]: max(1, math.ceil(r[1] / bucket_bytes)) for r in rows.groupBy("shard").agg(F.sum("size")).collect()}
    before, total = {}, 0
    for s in range(shards):
        before[s], total = total, total + buckets.get(s, 1)
    place = F.pmod(F.xxhash64("mark", "copy"), _per_shard(buckets, shards).cast("long"))
    dealt = _numbered_copies(rows, bucket_bytes, total).withColumn("bucket", (_per_shard(before, shards) + place).cast("int"))
    full = dealt.repartitionById(total, F.col("bucket")).groupBy("bucket").agg(F.first("shard").alias("shard"), F.sort_array(F.collect_list(F.struct("mark", "record"))).alias("rows"))
    mixed = full.select("bucket", "shard", F.shuffle("rows", F.lit(seed)).alias("rows"))
    out = mixed.select("bucket", "shard", F.posexplode("rows").alias("pos", "row")).select(F.col("row.record").alias("record"), "bucket", "pos", "shard")
    out.sortWithinPartitions("shard", "bucket", "pos").write.partitionBy("shard").parquet(path)
    files = spark.read.schema(out.schema).parquet(path)
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = files.groupBy("shard", "bucket").count().select("bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("first"))
    if total <= BROADCAST_BUCKETS:  # one row per bucket
        first = F.broadcast(first)
    return files.join(first, "bucket").select("record", "shard", (F.col("first") + F.col("pos")).alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    out = shuffle_into_shards(docs, run_folder(spark, "shards"))
    doc_id, text = F.col("record.doc_id"), F.col("record.text")
    return out.select(
        doc_id.alias("doc_id"),
        (text_bytes(text) + 8).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        grown_shard(doc_id, SHARDS).alias("grown_shard"),
    )
