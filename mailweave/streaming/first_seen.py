"""ST1: emit an address the first time it is ever seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import extract

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> SparkSession:
    """Streams that this session starts from now on keep their state in RocksDB: on the executors' disks and in the
    checkpoint, not in memory, so that one key for each address ever seen is affordable."""
    spark.conf.set(_PROVIDER, _ROCKSDB)
    return spark


def first_seen_emails(stream: DataFrame, text: str, event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """Each address once. State is one key for each address; start the stream after :func:`keep_state_on_disk`.

    With an event-time column the state is bounded: an address is forgotten once the watermark, ``delay`` behind the
    newest time, has passed it, and may be emitted again then. Rows older than the watermark are left out; :class:`LateRows`
    counts them. The delay is the caller's to choose.
    """
    if (event_time is None) != (delay is None):
        raise ValueError("an event time needs a delay, and a delay an event time")
    emails = extract.emails_in(stream, text, [event_time] if event_time else [])
    if event_time:
        return emails.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["email"])
    return emails.dropDuplicates(["email"])


class LateRows:
    """How many rows a query left out because they came after its watermark, by micro-batch.

    Spark keeps the figures of a query's last hundred batches or so: :meth:`wait` looks at them while it waits, and
    :meth:`update` does so for callers that wait themselves.
    """

    def __init__(self, query: StreamingQuery):
        self.query, self.batches = query, {}

    def update(self) -> int:
        for progress in self.query.recentProgress:
            late = sum(op["numRowsDroppedByWatermark"] for op in progress["stateOperators"])
            if late:
                self.batches[progress["batchId"]] = late
        return sum(self.batches.values())

    def wait(self, every: float = 1.0) -> int:
        """Until the query ends; all late rows."""
        while not self.query.awaitTermination(every):
            self.update()
        return self.update()
