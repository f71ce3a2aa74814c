"""Sessions and the shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tessella").config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in {"spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows of a batch that a Python worker is handed, unless the session says otherwise: texts may be long.
BATCH_ROWS = "512"


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable in executors' Python workers, wherever they run, and bounds their batches: the
    session's spark.sql.execution.arrow.maxRecordsPerBatch is set, where it has its default."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root = Path(__file__).parent
        target = os.path.join(tempfile.mkdtemp(prefix="tessella-ship-"), "tessella.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        spark.sparkContext.addPyFile(target)
    return spark
