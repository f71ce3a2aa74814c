"""Changes of files followed in keyed state: path to hash, in the state store, in place of a stored snapshot that every batch rereads.

Events are (path, hash, at): a file was seen with that hash at that time; a null hash says that it is gone. Of a batch's
events of a path the last in time counts (of those at one time the largest hash; a null only if there is no other).
Each path whose state changes gives a row, so what is written and held grows with the changes and the files that exist,
not with the number of batches.

With ``silence`` a file that no event has named for that long, by the events' own time, counts as deleted: a
timer in the state store, moved with every event. Without it only null hashes delete.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

CHANGES = "path string, status string, hash string"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Known(StatefulProcessor):
    """What is known of one path."""

    def __init__(self, silence_ms: int | None):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", StructType([StructField("hash", StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N803
        last = max(rows, key=lambda r: (r.at, r.hash is not None, r.hash or ""))
        before = self.known.get()[0] if self.known.exists() else None
        if last.hash is None:
            self.known.clear()
        elif last.hash != before:
            self.known.update((last.hash,))
        if self.silence_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if last.hash is not None:
                self.handle.registerTimer(last.ms + self.silence_ms)
        if last.hash != before:
            status = "deleted" if last.hash is None else "added" if before is None else "modified"
            yield Row(path=key[0], status=status, hash=last.hash)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N803
        if self.known.exists():
            self.known.clear()
            yield Row(path=key[0], status="deleted", hash=None)

    def close(self) -> None:
        pass


def store_of_state(spark: SparkSession) -> None:
    """Sets the session's state store to one that keeps values, lists and timers on disk, where nothing else is set."""
    if "HDFSBacked" in spark.conf.get(STORE, "HDFSBacked"):
        spark.conf.set(STORE, ROCKS)


def track(events: DataFrame, silence: str | None = None, late: str = "0 seconds") -> DataFrame:
    """(path, status, hash) of changes, from a stream of (path, hash, at). silence: an interval such as '30 days';
    late: how much later than others an event may come. The session gets a state store that can hold timers."""
    spark = events.sparkSession
    store_of_state(spark)
    # The driver's own worker imports nothing that was shipped to executors, so the processor travels whole.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    ms = None
    if silence is not None:
        ms = spark.range(1).select(F.unix_millis(F.timestamp_millis(F.lit(0)) + F.expr(f"interval {silence}")).alias("ms")).first().ms
        events = events.withWatermark("at", late)
    mode = "none" if ms is None else "eventTime"
    return events.select("path", "hash", "at", F.unix_millis("at").alias("ms")).where("path IS NOT NULL AND at IS NOT NULL").groupBy("path").transformWithState(statefulProcessor=Known(ms), outputStructType=CHANGES, outputMode="append", timeMode=mode)


def store(changes: DataFrame, path: str, checkpoint: str) -> None:
    """Runs over what the stream has now and appends the changes, with the batch's number, to the table at path. A run
    that was cut off goes on where its checkpoint is; a batch that is written again replaces what it had written."""

    def one(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/of={number}")

    changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
