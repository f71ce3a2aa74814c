"""Tables in versions: a reader sees one version whole, a merge rewrites only the files that its keys fall into.

A version is a manifest, a JSON file of the next number below ``_versions``, that lists Parquet files by the first key each
may hold; from there to the next file's first key is its own. Data is written first, then the manifest is put in its place
in one step that fails if that number is taken: of two writers from one version the second is refused, and a
writer that dies leaves files that no manifest names (``vacuum`` deletes them) and the old version as it was.

The manifest is as long as the table has files; the driver holds it, as it holds Spark's own list of files.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.session import ship


class Conflict(RuntimeError):
    """Another writer was first."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def latest(spark: SparkSession, path: str) -> int:
    """The number of the last version, 0 if there is none."""
    fs, jvm = _fs(spark, path)
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/_versions")
    if not fs.exists(folder):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return max((int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()), default=0)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """{key, schema, files: [{name, low, rows, bytes}]} of a version, the last one unless another is named."""
    version = latest(spark, path) if version is None else version
    text = spark.read.text(f"{path}/_versions/{version:08}.json", wholetext=True).first()
    return json.loads(text[0])


def _schema(found: dict) -> StructType:
    return StructType.fromJson(found["schema"])


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    found = manifest(spark, path, version)
    names = [f"{path}/{f['name']}" for f in found["files"]]
    return spark.read.schema(_schema(found)).parquet(*names) if names else spark.createDataFrame([], _schema(found))


def _put(spark: SparkSession, path: str, version: int, content: dict) -> None:
    """Puts a manifest in its place, or fails if the place is taken."""
    fs, jvm = _fs(spark, path)
    at = jvm.org.apache.hadoop.fs.Path
    place, beside = at(f"{path}/_versions/{version:08}.json"), at(f"{path}/_versions/.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            # A local rename would overwrite; a link doesn't.
            to = lambda p: jvm.java.nio.file.Path.of(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(to(place), to(beside))
        elif fs.exists(place) or not fs.rename(beside, place):
            raise Conflict(f"version {version} of {path} was written by another")
    except Exception as e:
        if latest(spark, path) >= version:
            raise Conflict(f"version {version} of {path} was written by another") from e
        raise
    finally:
        fs.delete(beside, False)


def _written(df: DataFrame, path: str, key: str, territory: Column | None, rows_a_file: int) -> list[dict]:
    """Writes df in files of disjoint ranges of keys, within territories if there are some; says what they hold."""
    spark, folder = df.sparkSession, f"data-{uuid.uuid4().hex}"
    if territory is None:
        ordered = df.repartitionByRange(key).sortWithinPartitions(key)
        ordered.write.option("maxRecordsPerFile", rows_a_file).parquet(f"{path}/{folder}")
    else:
        ordered = df.withColumn("_territory", territory).repartition("_territory").sortWithinPartitions("_territory", key)
        ordered.write.option("maxRecordsPerFile", rows_a_file).partitionBy("_territory").parquet(f"{path}/{folder}")
    stored = spark.read.option("recursiveFileLookup", "true").schema(df.schema).parquet(f"{path}/{folder}")
    found = stored.groupBy("_metadata.file_path", "_metadata.file_size").agg(F.min(key).alias("low"), F.count(F.lit(1)).alias("rows")).collect()
    cut = lambda name: f"{folder}/{name.split(f'/{folder}/', 1)[1]}"
    return [{"name": cut(r["file_path"]), "low": r["low"], "rows": r["rows"], "bytes": r["file_size"]} for r in found]


def _ordered(files: list[dict]) -> list[dict]:
    return sorted(files, key=lambda f: (f["low"] is not None, f["low"]))


def replace(df: DataFrame, path: str, key: str, rows_a_file: int = 5_000_000) -> int:
    """Writes df as the next version of the table at path; says its number. key: a column of text or whole numbers, expected to
    be unique. df may read the table itself."""
    version = latest(df.sparkSession, path) + 1
    files = _written(df, path, key, None, rows_a_file)
    _put(df.sparkSession, path, version, {"key": key, "schema": json.loads(df.schema.json()), "files": _ordered(files)})
    return version


def territory_of(key: Column, lows: list) -> Column:
    """The number of the file whose range holds a key: the last whose first key isn't beyond it, or the first file.
    lows: the files' first keys in order, None where a file holds null keys alone."""
    nulls = sum(x is None for x in lows)
    rest = lows[nulls:]

    @F.arrow_udf("int")
    def find(keys: pa.Array) -> pa.Array:
        return pa.array([0 if k is None else max(0, nulls + bisect_right(rest, k) - 1) for k in keys.to_pylist()], pa.int32())

    return find(key)


def merge(parts: DataFrame, path: str, order: str, base: int | None = None, rows_a_file: int = 5_000_000) -> tuple[int, int, int]:
    """Upserts parts (the table's columns and `order`) by the table's key, the last part of a key wins; (version, files
    rewritten, bytes written). base: the version it builds on, which must still be the last when it is done."""
    spark = ship(parts.sparkSession)
    base = latest(spark, path) if base is None else base
    old = manifest(spark, path, base)
    key, files, columns = old["key"], old["files"], [f["name"] for f in old["schema"]["fields"]]
    last = parts.groupBy(key).agg(F.max_by(F.struct(*[c for c in columns if c != key]), order).alias("r")).select(key, "r.*").select(*columns)
    number = territory_of(F.col(key), [f["low"] for f in files])
    met = {r[0] for r in last.select(number.alias("t")).distinct().collect()}
    touched, kept = [f for n, f in enumerate(files) if n in met], [f for n, f in enumerate(files) if n not in met]
    stored = spark.read.schema(_schema(old)).parquet(*(f"{path}/{f['name']}" for f in touched)) if touched else last.limit(0)
    merged = stored.join(last.select(F.col(key).alias("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_anti").unionByName(last)
    made = _written(merged, path, key, number, rows_a_file) if met else []
    _put(spark, path, base + 1, old | {"files": _ordered([*kept, *made])})
    return base + 1, len(touched), sum(f["bytes"] for f in made)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes data that none of the last `keep` versions names, and older manifests; says how many folders went. Not while
    a writer is at work."""
    fs, jvm = _fs(spark, path)
    at, last = jvm.org.apache.hadoop.fs.Path, latest(spark, path)
    named = {f["name"].split("/")[0] for v in range(max(1, last - keep + 1), last + 1) for f in manifest(spark, path, v)["files"]}
    gone = [s.getPath() for s in fs.listStatus(at(path)) if s.getPath().getName().startswith("data-") and s.getPath().getName() not in named]
    for p in gone:
        fs.delete(p, True)
    for v in range(1, last - keep + 1):
        fs.delete(at(f"{path}/_versions/{v:08}.json"), False)
    return len(gone)
