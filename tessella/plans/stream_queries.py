"""Queries that run streams over the tables' rows to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.plans import bind
from tessella.plans.oracle import VFILES
from tessella.scratch import scratch_root
from tessella.session import ship
from tessella.streaming import keyed

EVENTS = "path string, hash string, at timestamp"


def tracked_changes(spark, sf):
    """J14, U1, U2, U3, SK7, SK9: changes of files followed in keyed state over three runs of a stream, each of which goes on
    where the one before it ended. First six of seven files are there; then every fifth is altered and every eleventh
    gone; then every second is as at first. Documents without id are left out."""
    files, n = bind.vfiles(ship(spark), sf), F.col("doc_id")
    h = F.substring(F.sha2("text", 256), 1, 16)
    runs = [
        files.where(n % 7 != 0).select("path", h.alias("hash")),
        files.where((n % 5 == 0) | (n % 11 == 0)).select("path", F.when(n % 11 != 0, F.concat(F.lit("x"), F.substring(h, 2, 15))).alias("hash")),
        files.where(n % 2 == 0).select("path", h.alias("hash")),
    ]
    source, table, checkpoint = (f"{scratch_root(spark)}/{x}-{uuid.uuid4().hex}" for x in ("events", "changes", "state"))
    for k, rows in enumerate(runs):
        rows.withColumn("at", F.timestamp_seconds(F.lit(60 * k))).write.mode("append").parquet(source)
        keyed.store(keyed.track(spark.readStream.schema(EVENTS).parquet(source)), table, checkpoint)
    return spark.read.schema(f"{keyed.CHANGES}, batch int").option("recursiveFileLookup", "true").parquet(table)


QUERIES = {"tracked_changes": tracked_changes}

ORACLE_SQL = {
    "tracked_changes": f"""WITH {VFILES}, s AS (
          SELECT path, doc_id, substr(sha256(text), 1, 16) AS h FROM vfiles),
        t AS (
          SELECT path, CASE WHEN doc_id % 7 <> 0 THEN h END AS a,
            CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'x' || substr(h, 2) WHEN doc_id % 7 <> 0 THEN h END AS b, doc_id, h FROM s),
        u AS (SELECT path, a, b, CASE WHEN doc_id % 2 = 0 THEN h ELSE b END AS c FROM t),
        d AS (SELECT path, NULL AS old, a AS new, 0 AS batch FROM u UNION ALL SELECT path, a, b, 1 FROM u UNION ALL SELECT path, b, c, 2 FROM u)
        SELECT path, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'deleted' ELSE 'modified' END AS status, new AS hash, batch FROM d WHERE old IS DISTINCT FROM new""",
}
