"""Streaming queries (ST*), run to the end of what is there and read back from their sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as M
from ..streaming import first_seen, upsert
from .core import dealt, derived, load, query, scratch


#: Parts of a log, one micro-batch each
_PARTS = 4


def _split_log(spark, d, sql: str) -> tuple[list[str], object]:
    """The log in order of ``seq`` as four folders; each is a range of it in as many files as there are tasks to write them."""
    rows, path = derived(spark, d, sql), scratch(spark)
    n = _PARTS * -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // _PARTS)
    part = F.floor(F.spark_partition_id() * _PARTS / n).cast("int")
    rows.repartitionByRange(n, "seq").withColumn("_part", part).write.partitionBy("_part").parquet(path)
    return [f"{path}/_part={i}" for i in range(_PARTS)], rows.schema


def _run_twice(spark, parts, schema, sink) -> None:
    """Half of the parts under one checkpoint, the others under a new one, whose batches count from 0 again.

    A part arrives when the one before is done, and all that has arrived is one micro-batch, whatever the number of its files.
    """
    half = len(parts) // 2
    for some in (parts[:half], parts[half:]):
        folder, state = scratch(spark), scratch(spark)
        for part in some:
            spark.read.schema(schema).parquet(part).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(schema).parquet(folder)
            upsert.upsert_stream(stream, sink, state).trigger(availableNow=True).start().awaitTermination()


@query("st1_first_seen_emails", "SELECT DISTINCT email FROM {@emails}")
def st1(spark, d):
    """Texts are written by the tasks that read them, and a quarter of the files is a micro-batch."""
    src, out, state = scratch(first_seen.keep_state_on_disk(spark)), scratch(spark), scratch(spark)
    dealt(derived(spark, d, "{@texts}"), d, "documents", "pages", parts=_PARTS).write.parquet(src)
    files = len(spark.read.parquet(src).inputFiles())
    stream = spark.readStream.schema("src string, url string, text string").option("maxFilesPerTrigger", -(-files // _PARTS)).parquet(src)
    emails = first_seen.first_seen_emails(stream, "text").select("email")
    run = emails.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("email string").parquet(out)


@query("st1_first_seen_with_watermark", "SELECT DISTINCT user_id AS user FROM {events}")
def st1_watermark(spark, d):
    """Bounded state: keys are forgotten after the delay, here longer than the whole log."""
    src, out, state = scratch(spark), scratch(spark), scratch(spark)
    texts = load(spark, d, "events").select("ts", F.concat(F.lit("u"), "user_id", F.lit("@mail1.example.com")).alias("text"))
    dealt(texts, d, "events", parts=_PARTS).write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, text string").parquet(src)
    emails = first_seen.first_seen_emails(stream, "text", "ts", "3650 days").select(F.regexp_extract("email", r"u(\d+)@", 1).cast("long").alias("user"))
    run = emails.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    if first_seen.LateRows(run).wait():
        raise RuntimeError("no row is older than ten years")
    return spark.read.schema("user long").parquet(out)


@query("st2_stream_contacts", """
SELECT DISTINCT sha256(concat(coalesce(source_url, ''), '|', coalesce(full_name, ''), '|', coalesce(email_found, ''), '|', coalesce(email_generated, ''))) AS id FROM {@stored}""")
def st2_contacts(spark, d):
    table = scratch(spark)
    _run_twice(spark, *_split_log(spark, d, "{@stored}"), upsert.contact_sink(table))
    return upsert.current_contacts(spark, table).select("id")


_LATEST = ", ".join(f"max_by({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in M.PROFILE_VALUES)


@query("st2_stream_profiles", f"SELECT source_url, {_LATEST} FROM {{@log}} GROUP BY source_url")
def st2_profiles(spark, d):
    table = scratch(spark)
    _run_twice(spark, *_split_log(spark, d, "{@log}"), upsert.profile_sink(table))
    return upsert.current_profiles(spark, table)
