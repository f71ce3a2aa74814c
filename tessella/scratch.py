"""Scratch tables in the folder that driver and executors share.

Intermediate results are cut off from their lineage by writing them as Parquet below
``spark.checkpoint.dir`` (read from the session), or the folder that was given to the context. Only where
neither is set and the master is local, as in tests, a folder of our own is chosen; on a cluster a
missing setting is an error, for executors don't see each other's disks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for this application's intermediate tables."""
    context = spark.sparkContext
    app = context.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="tessella-")
        base = _own[app]
    return f"{base.rstrip('/')}/tessella-{app}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df once and returns the stored table, so that an executor's loss costs no recomputation
    and non-deterministic columns (row numbers, partition numbers) are fixed."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._scratch = path
    return stored


def _delete(spark: SparkSession, address: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(address)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(stored: DataFrame) -> bool:
    """Whether all files of a table that materialise() gave, or of a union of such tables, are still there."""
    spark = stored.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f) for f in stored.inputFiles()]
    return all(p.getFileSystem(conf).exists(p) for p in paths)


def discard(stored: DataFrame) -> None:
    """Deletes a table that materialise() gave, once nothing reads it any more (an earlier round's)."""
    if path := getattr(stored, "_scratch", None):
        _delete(stored.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables; call when their results have been written."""
    _delete(spark, scratch_root(spark))
