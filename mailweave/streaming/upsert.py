"""ST2: contacts and profiles as continuously maintained tables.

Each micro-batch writes its own folder ``run=N/batch_id=M`` and nothing else, so a batch never
rewrites the table, and replaying a batch after a failure overwrites just what that batch had
written. A run is a checkpoint's lifetime: Spark keeps the query's id with the checkpoint, so a restart
goes on in its run, and a new checkpoint, whose batches count from 0 again, begins the next one.

Contacts are also kept in buckets by their id, as folders below the batch: a batch looks for its ids in the buckets
that they fall into, and in the id column alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import merge as M
from ..session import cut_lineage

_RUN, _BATCH, _BUCKET = "run", "batch_id", "bucket"
_BUCKETS = "_buckets-"
_MARK = "_query-"
#: Run number of a compacted table.
BASE = -1


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _runs(spark: SparkSession, path: str) -> dict[int, set[str]]:
    """Run numbers, and the ids of the queries they belong to."""
    files, where = _folder(spark, path)
    out = {}
    for status in files.listStatus(where) if files.exists(where) else []:
        name = status.getPath().getName()
        if name.startswith(f"{_RUN}="):
            marks = [s.getPath().getName() for s in files.listStatus(status.getPath())]
            out[int(name.split("=")[1])] = {m.removeprefix(_MARK) for m in marks if m.startswith(_MARK)}
    return out


def _run_of(spark: SparkSession, path: str) -> int:
    """This query's run in the table: the one that carries its id, else a new one after all others. Run 0 outside of streams."""
    query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not query:
        return 0
    runs = _runs(spark, path)
    for number, ids in runs.items():
        if query in ids:
            return number
    number = max(runs, default=0) + 1
    files, _ = _folder(spark, path)
    _, mark = _folder(spark, f"{path}/{_RUN}={number}/{_MARK}{query}")
    files.create(mark).close()
    return number


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table so far; None when no batch was written yet."""
    files, where = _folder(spark, path)
    if not files.exists(where) or not files.globStatus(_folder(spark, f"{path}/{_RUN}=*/{_BATCH}=*")[1]):
        return None
    return spark.read.parquet(path)


def _write_batch(df: DataFrame, path: str, run: int, batch_id: int, by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{_RUN}={run}/{_BATCH}={batch_id}")


def _bucket_count(spark: SparkSession, path: str, wanted: int) -> int:
    """The table's number of buckets, which is noted in it when it is begun."""
    files, where = _folder(spark, path)
    for status in files.listStatus(where) if files.exists(where) else []:
        name = status.getPath().getName()
        if name.startswith(_BUCKETS):
            return int(name.removeprefix(_BUCKETS))
    _, mark = _folder(spark, f"{path}/{_BUCKETS}{wanted}")
    files.create(mark).close()
    return wanted


def _bucketed(contacts: DataFrame, buckets: int) -> DataFrame:
    return contacts.withColumn(_BUCKET, F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))


def contact_sink(path: str, seq: str = "seq", buckets: int = 64):
    """foreachBatch function for M1: append contacts whose id is new. ``buckets`` holds for a table that is begun."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run, n = _run_of(spark, path), _bucket_count(spark, path, buckets)
        fresh = cut_lineage(_bucketed(M.upsert_contacts(None, batch, seq), n))
        touched = [r[0] for r in fresh.select(_BUCKET).distinct().collect()]  # at most the number of buckets
        known = _stored(spark, path)
        if known is not None:  # what a replay finds of its own batch does not count
            known = known.filter(F.col(_BUCKET).isin(touched)).filter((F.col(_RUN) < run) | (F.col(_BATCH) < batch_id))
            fresh = fresh.join(known.select("id"), "id", "left_anti").select(*fresh.columns)
        # a bucket's rows come together first: a file or a few for each, and not one from every task
        _write_batch(fresh.hint("rebalance", _BUCKET), path, run, batch_id, (_BUCKET,))

    return apply


def current_contacts(spark: SparkSession, path: str) -> DataFrame:
    """The contacts so far, each id once."""
    return spark.read.parquet(path).drop(_RUN, _BATCH, _BUCKET)


def compact_contacts(spark: SparkSession, path: str, target: str) -> None:
    """Write the table elsewhere with one file for each bucket, as a base that comes before all runs of the new table."""
    n = _bucket_count(spark, target, _bucket_count(spark, path, 64))
    whole = _bucketed(current_contacts(spark, path), n)
    _write_batch(whole.repartition(n, _BUCKET), target, BASE, 0, (_BUCKET,))


def profile_sink(path: str, seq: str = "seq"):
    """foreachBatch function for M2: log each batch's newest values per profile."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        _write_batch(M.upsert_profiles(None, batch, seq), path, _run_of(batch.sparkSession, path), batch_id)

    return apply


def current_profiles(spark: SparkSession, path: str) -> DataFrame:
    """M2 over the log: per profile and column the newest value that is not NULL, by run and batch."""
    log = spark.read.parquet(path)
    return M.upsert_profiles(None, log.withColumn("_order", F.shiftleft(F.col(_RUN).cast("long"), 40) + F.col(_BATCH)), "_order")


def compact_profiles(spark: SparkSession, path: str, target: str) -> None:
    """Write the merged table elsewhere, as a base that comes before all runs of the new log and that none overwrites."""
    _write_batch(current_profiles(spark, path), target, BASE, 0)


def upsert_stream(stream: DataFrame, sink, checkpoint: str) -> DataStreamWriter:
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
