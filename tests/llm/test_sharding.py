import zlib
from collections import defaultdict

import numpy as np

from tessella.llm import queries, sharding


def check(rows, texts, shards=16):
    assert sorted((r["doc_id"] for r in rows), key=str) == sorted((i for i, _ in texts), key=str)
    sizes, slots = defaultdict(int), defaultdict(list)
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in texts)
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == want
    for r in rows:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    total, largest = sum(sizes.values()), max(r["size"] for r in rows) if rows else 0
    assert all(abs(sizes[s] - total / shards) <= largest + 0.03 * total / shards for s in range(shards))
    return sizes


def test_query_over_all_documents(spark):
    path = "/root/testdata/sf0.01"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    check(queries.op9_sharding(spark, path).collect(), texts)


def test_hot_text_is_subdivided_and_small_groups_stay_whole(spark, docs_of):
    rng = np.random.default_rng(0)
    texts = [f"text {rng.integers(0, 2500)} " * 6 for _ in range(4000)] + ["hot"] * 3000 + [None] * 500
    df = docs_of(texts)
    rows = sharding.shard_by_bytes(df).collect()
    check(rows, list(enumerate(texts)))
    where = defaultdict(set)
    for r in rows:
        where[texts[r["doc_id"]]].add(r["shard"])
    assert max(len(s) for t, s in where.items() if t and t.startswith("text")) == 1


def in_several(rows, texts):
    where = defaultdict(set)
    for r in rows:
        where[texts[r["doc_id"]]].add(r["shard"])
    return [t for t, s in where.items() if len(s) > 1]


def test_groups_that_fit_stay_whole(docs_of):
    for groups, of, text in ((400, 10, "t" * 60), (160, 100, "")):
        texts = [f"{n:05d}{text}" for n in range(groups) for _ in range(of)]
        rows = sharding.shard_by_bytes(docs_of(texts)).collect()
        check(rows, list(enumerate(texts)))
        assert not in_several(rows, texts)


def test_a_group_just_under_a_shard_and_one_far_over(docs_of):
    light = [f"light text {n} " * 3 for n in range(6000)]
    mean = sum(len(t) + 1 for t in light) / 15
    texts = light + ["u" * 99] * int(mean * 0.9 / 100) + ["o" * 99] * int(mean * 3.5 / 100) + [None] * 3000
    rows = sharding.shard_by_bytes(docs_of(texts)).collect()
    check(rows, list(enumerate(texts)))
    assert in_several(rows, texts) == ["o" * 99]


def test_cuts_fill_to_one_level():
    assert sharding.cuts([0, 0, 0, 0], 8) == [4, 8, 12]
    assert sharding.cuts([5, 0, 9, 0], 10) == [0, 10, 10]
    assert sharding.cuts([3, 3], 0) == [0]


def test_shards_and_slots_by_brute_force(spark, docs_of):
    """Without groups, shards are stretches of the key order cut by bytes, and slots count along it."""
    from pyspark.sql import functions as F

    texts = [f"document {n} " * (n % 5 + 1) for n in range(9000)]  # so many that none weighs much
    df = docs_of(texts)
    keys = {r["doc_id"]: (r["h"], r["d"]) for r in df.select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64("doc_id").alias("d")).collect()}
    sizes, at, want, slots = {i: len(t) + 1 for i, t in enumerate(texts)}, 0, {}, defaultdict(int)
    total = sum(sizes.values())
    for i in sorted(keys, key=keys.get):
        shard = (2 * at + sizes[i]) * 16 // (2 * total)
        want[i] = shard, slots[shard]
        slots[shard] += 1
        at += sizes[i]
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_by_bytes(df).collect()} == want


def test_clashing_columns_and_no_ids(spark):
    df = spark.createDataFrame([(None, f"t{n % 5}", 1, 2) for n in range(50)], "doc_id long, text string, h int, size int")
    rows = sharding.shard_by_bytes(df).collect()
    assert len(rows) == 50 and sorted(r["size"] for r in rows) == [3] * 50


def test_odd_tables(docs_of, odd_texts):
    assert sharding.shard_by_bytes(docs_of([])).count() == 0
    check(sharding.shard_by_bytes(docs_of(odd_texts)).collect(), list(enumerate(odd_texts)))
    same = [(None, "x")] * 700 + [(3, "x")] * 700
    rows = sharding.shard_by_bytes(docs_of(same)).collect()
    sizes = check(rows, same)
    assert len(sizes) == 16


def test_ranges_bound_bytes_and_rows(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select((F.col("id") % 2 * F.xxhash64("id")).alias("h"), F.xxhash64("id", F.lit(1)).alias("d"), F.col("id").alias("r"), F.when(F.col("id") % 2 == 0, 1).otherwise(500).cast("bigint").alias("size"))
    total = rows.agg(F.sum("size")).first()[0]
    for heavy in (frozenset({0}), frozenset()):
        splitters, ranges = sharding.find_ranges(rows, 100, total, 20_000, heavy)
        stats = rows.withColumn("range", sharding.range_of(splitters)).groupBy("range").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")).collect()
        assert sorted(r["range"] for r in stats) == ranges and sum(r["n"] for r in stats) == 20_000
        light = [r for r in stats if heavy or (r["lo"], r["hi"]) != (0, 0)]  # unless it may be cut, the group has a range of its own
        assert len(light) == len(stats) - (not heavy)
        assert max(r["n"] for r in light) < 4 * 200 and max(r["b"] for r in light) < 4 * total / 100
