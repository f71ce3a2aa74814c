"""Incremental runs over a stream of snapshots. An extension: the batch diff is what the operators define."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.diff import snapshot_diff
from tessella.sources import sinks


def follow(snapshots: DataFrame, stored: str, changes: str, checkpoint: str) -> StreamingQuery:
    """Diffs every micro-batch of (path, hash) against the stored snapshot, appends (batch, path, status) of what
    changed to the table of changes, and stores the new snapshot. A batch that is run again appends nothing twice."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select("path", "hash").dropDuplicates(["path"]).persist()
        old = spark.read.parquet(stored) if sinks.exists(spark, stored) else new.limit(0)
        found = snapshot_diff(old, new).where("status <> 'unchanged'").withColumn("batch", F.lit(number))
        done = sinks.exists(spark, changes) and not spark.read.parquet(changes).where(F.col("batch") == number).isEmpty()
        if not done:
            found.write.mode("append").parquet(changes)
        sinks.replace(new, stored)
        new.unpersist()

    return snapshots.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
