"""Tables in versions: whole versions for readers, one writer of two, few files rewritten."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.sources import versions


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_merges_equal_a_dictionary(spark, tmp_path):
    r, path = random.Random(6), str(tmp_path / "t")
    state = {f"k{r.randrange(10**6):06}": n for n in range(3000)}
    versions.replace(spark.createDataFrame(list(state.items()), "k string, v int"), path, "k", rows_a_file=200)
    history = [dict(state)]
    for n in range(3):
        parts = [(r.choice([*r.sample(sorted(state), 20), f"k{r.randrange(10**6):06}", "", "z"]), 100_000 * (n + 1) + i, i) for i in range(60)]
        version, _, _ = versions.merge(spark.createDataFrame(parts, "k string, v int, at int"), path, "at", rows_a_file=200)
        for k, v, _ in parts:
            state[k] = v
        history.append(dict(state))
        assert version == n + 2
    for v, want in enumerate(history, 1):
        assert rows(versions.read(spark, path, v)) == sorted(want.items())
    files = versions.manifest(spark, path)["files"]
    lows = [f["low"] for f in files]
    assert lows == sorted(lows) and sum(f["rows"] for f in files) == len(state)
    highs = [max(x["k"] for x in spark.read.parquet(f"{path}/{f['name']}").collect()) for f in files]
    assert all(a < b for a, b in zip(highs, lows[1:], strict=False))


def test_a_merge_rewrites_the_files_it_meets(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.replace(spark.range(20_000).select("id", F.lit("some text").alias("v")), path, "id", rows_a_file=500)
    whole = versions.manifest(spark, path)["files"]
    _, files, written = versions.merge(spark.createDataFrame([(7, "a", 1), (9, "b", 1), (19_999, "c", 1), (-5, "d", 1), (50_000, "e", 1)], "id long, v string, at int"), path, "at", rows_a_file=500)
    assert files == 2 and written < sum(f["bytes"] for f in whole) / 10
    kept = {f["name"] for f in versions.manifest(spark, path)["files"]} & {f["name"] for f in whole}
    assert len(kept) == len(whole) - 2
    got = dict(rows(versions.read(spark, path).where("id in (7, 8, 9, 19999, -5, 50000)")))
    assert got == {7: "a", 8: "some text", 9: "b", 19_999: "c", -5: "d", 50_000: "e"}


def test_of_two_writers_one_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    part = spark.createDataFrame([("b", 3, 0)], "k string, v int, at int")
    versions.replace(df, path, "k")
    assert versions.merge(part, path, "at", base=1)[0] == 2
    with pytest.raises(versions.Conflict):
        versions.merge(part.withColumn("v", F.lit(9)), path, "at", base=1)
    assert rows(versions.read(spark, path)) == [("a", 1), ("b", 3)] and versions.latest(spark, path) == 2


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.replace(spark.createDataFrame([("a", 1)], "k string, v int"), path, "k")

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versions, "_put", die)
        with pytest.raises(KeyboardInterrupt):
            versions.merge(spark.createDataFrame([("a", 2, 0)], "k string, v int, at int"), path, "at")
    assert rows(versions.read(spark, path)) == [("a", 1)]
    assert versions.vacuum(spark, path) == 1 and rows(versions.read(spark, path)) == [("a", 1)]
    versions.replace(versions.read(spark, path).withColumn("v", F.col("v") + 1), path, "k")
    assert rows(versions.read(spark, path)) == [("a", 2)] and versions.vacuum(spark, path, keep=1) == 1


def test_odd_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    empty = spark.createDataFrame([], "k string, v int")
    versions.replace(empty, path, "k")
    assert versions.read(spark, path).count() == 0
    parts = spark.createDataFrame([(None, 1, 0), ("x", 2, 0), ("", 3, 0), ("x", 4, 1)], "k string, v int, at int")
    versions.merge(parts, path, "at")
    assert rows(versions.read(spark, path)) == [("", 3), ("x", 4), (None, 1)]
    versions.merge(parts.where("k is null").withColumn("v", F.lit(7)), path, "at")
    assert rows(versions.read(spark, path)) == [("", 3), ("x", 4), (None, 7)]
    assert versions.merge(parts.limit(0), path, "at")[1:] == (0, 0)
