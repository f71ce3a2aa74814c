"""Writing results: tables, upserts, pages, and states that exist only while there is something to say."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.columns import safe_id
from tessella.functions.schema import MENU
from tessella.operators import quality
from tessella.operators.diff import upsert


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def replace(df: DataFrame, path: str) -> None:
    """Overwrites a Parquet table that df itself may read: it is written beside the old one, which is renamed out of
    the way and deleted only when the new one has taken its place, so that one of the two is always there."""
    spark = df.sparkSession
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    fs, p, jvm = _fs(spark, path)
    at = jvm.org.apache.hadoop.fs.Path
    if fs.exists(p) and not fs.rename(p, at(old)):
        raise OSError(f"{path} can't be moved out of the way")
    if not fs.rename(at(fresh), p):
        fs.rename(at(old), p)
        raise OSError(f"{path} can't be replaced")
    fs.delete(at(old), True)


def merge(parts: DataFrame, path: str, key: str, order: str, full_replace: bool = False) -> None:
    """Upserts parts into the table at path; the last part of a key wins."""
    spark = parts.sparkSession
    fresh = parts.groupBy(key).agg(F.max_by(F.struct(*[c for c in parts.columns if c not in (key, order)]), order).alias("r")).select(key, "r.*")
    replace(fresh if full_replace or not exists(spark, path) else upsert(spark.read.parquet(path), parts, key, order), path)


def state(df: DataFrame, path: str) -> bool:
    """Writes rows as JSON, or removes what is there if there are none; says whether there are any."""
    spark = df.sparkSession
    if df.isEmpty():
        fs, p, _ = _fs(spark, path)
        fs.delete(p, True)
        return False
    df.write.mode("overwrite").json(path)
    return True


def states(faults: DataFrame, path: str, key: str) -> None:
    """Faults as JSON in a folder for each key that has some; a key that has none any more loses its folder."""
    faults.write.mode("overwrite").partitionBy(key).json(path)


def pages(df: DataFrame, path: str, key: str = "page_id") -> None:
    """One folder of JSON a page, named by the safe form of its id; pages that are no longer there go."""
    df.withColumn("page", safe_id(F.col(key))).write.mode("overwrite").partitionBy("page").json(path)


def tree(df: DataFrame, root: str) -> int:
    """A file for each row (path, text) below root, written by the tasks that hold the rows; says how many. A file is
    written beside its place and then renamed, so that a task that is run again leaves whole files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:"))
        n = 0
        for batch in batches:
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = f"{top}/{path}"
                beside = f"{target}.{uuid.uuid4().hex}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(beside, compression=None) as f:
                    f.write((body or "").encode("utf-8"))
                system.move(beside, target)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return df.select(F.col("path").cast("string"), F.col("text").cast("string")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def text(df: DataFrame, path: str, column: str = "text") -> None:
    """A rendered document: one row, one file."""
    df.select(column).coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def checked(documents: DataFrame, schema: dict, levels: int = 4, shown: int = 10) -> DataFrame:
    """documents (text), once none of them has a fault under the schema; else an error that names the first few."""
    found = quality.schema_faults(documents.select("text"), schema, levels=levels).limit(shown).collect()
    if found:
        raise ValueError("; ".join(f"{r.path}: {r.message}" for r in found))
    return documents


def menu(df: DataFrame, path: str, title: str) -> None:
    """A menu (section_pos, section, pos, title, path) as one JSON document; one that breaks the contract isn't written."""
    items = F.transform(F.sort_array(F.collect_list(F.struct("pos", "title", "path"))), lambda x: F.struct(x["title"].alias("title"), x["path"].alias("path")))
    sections = df.groupBy("section_pos", "section").agg(items.alias("items"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("section_pos", "section", "items"))), lambda x: F.struct(x["section"].alias("title"), x["items"].alias("items")))
    made = sections.agg(F.to_json(F.struct(F.lit(title).alias("title"), ordered.alias("items"))).alias("text"))
    checked(made, MENU, levels=1).coalesce(1).write.mode("overwrite").text(path)
