import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessella.llm import queries, simhash


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(fps, threshold=3):
    """fps: {id: fingerprint}; the smallest id that each reaches."""
    ids, at = sorted(fps), {}
    values = np.array([fps[i] for i in ids], np.uint64)
    for i in ids:
        if i in at:
            continue
        at[i], queue = i, [i]
        while queue:
            x = queue.pop()
            for k in np.flatnonzero(np.bitwise_count(values ^ np.uint64(fps[x])) <= threshold):
                if ids[k] not in at:
                    at[ids[k]] = i
                    queue.append(ids[k])
    return at


def test_query_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in rows}
    want = brute_components(fps)
    got = queries.op8_simhash(spark, sf).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{fps[i]:016x}", want[i]) for i in fps}
    assert len(set(want.values())) < len(fps)


def check_links(spark, values, cell_limit):
    fps = spark.createDataFrame([(int(v),) for v in np.array(sorted(values), np.uint64).view(np.int64)], "fp long")
    links = [(np.uint64(a % 2**64), np.uint64(b % 2**64)) for a, b in simhash.near_links(fps, cell_limit=cell_limit).collect()]
    assert all(0 < int(a ^ b).bit_count() <= 3 for a, b in links)
    parent = {int(v): int(v) for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(int(a))] = find(int(b))
    want = brute_components({int(v): int(v) for v in values})
    same = {}
    for v in values:
        assert same.setdefault(want[int(v)], find(int(v))) == find(int(v))
    assert len({find(int(v)) for v in values}) == len(set(want.values()))


def test_links_span_all_near_groups(spark):
    rng = np.random.default_rng(1)
    values = set()
    for base in rng.integers(0, 2**63, 60, dtype=np.uint64).tolist():
        for _ in range(6):  # chains: each step flips up to three bits anywhere
            for b in rng.choice(64, rng.integers(1, 4), replace=False).tolist():
                base ^= 1 << b
            values.add(base)
    check_links(spark, values, 100_000)
    check_links(spark, values, 3)


def test_dense_cell_is_grown_not_paired():
    rng = np.random.default_rng(2)
    fps = np.unique(np.array([sum(1 << int(b) for b in rng.choice(32, 2)) for _ in range(3000)], np.uint64))
    for matrix in (10, 10_000):
        links = simhash.cell_links(fps, np.ones(len(fps), bool), 3, matrix)
        assert len(links) == len(fps) - len(set(brute_components({int(f): int(f) for f in fps}).values()))


def test_odd_texts(docs_of, odd_texts, spark):
    got = {r["doc_id"]: r for r in simhash.near_components(docs_of(odd_texts)).collect()}
    for i, t in enumerate(odd_texts):
        assert got[i]["fingerprint"] == f"{brute_fingerprint(t):016x}"
    assert got[1]["component_id"] == got[2]["component_id"] == 0 and got[5]["component_id"] == 4
    assert simhash.near_components(docs_of([])).count() == 0
    repeated = docs_of([(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (None, None)])
    assert sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_components(repeated).collect()), key=str) == [(7, 7), (7, 7), (None, 7), (None, None)]
    clash = spark.createDataFrame([(1, "a b c", 5), (2, "a b c", 6)], "doc_id long, text string, fp long")
    assert [tuple(r) for r in simhash.keep_one(clash).collect()] == [(1, "a b c", 5)]


def test_a_hot_cell_is_spread_over_tasks(spark):
    """Twenty thousand fingerprints that share a half lie in one cell; beyond the limit no task holds more than a part of them."""
    rng = np.random.default_rng(12)
    values = np.unique(rng.integers(0, 1 << 32, 20_000, dtype=np.uint64)) | np.uint64(7 << 32)
    near = values[:200] ^ np.uint64(1 << 3)
    values = np.unique(np.concatenate([values, near]))
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64).tolist()], "fp long")
    dealt = simhash._cells(fps, 1000)
    hot = dealt.groupBy("cell").count().orderBy("count", ascending=False).first()
    assert hot["count"] > 10 * len(values)
    places = dealt.where(F.col("cell") == hot["cell"]).groupBy(F.spark_partition_id().alias("p")).count()
    assert places.count() > 1
    rows = [r["n"] for r in dealt.groupBy("cell", "sub").count().withColumnRenamed("count", "n").collect()]
    assert max(rows) < len(values) / 20
    found = {v["v"]: v["label"] for v in simhash.components(simhash.near_links(fps, cell_limit=1000)).collect()}
    whole = {v["v"]: v["label"] for v in simhash.components(simhash.near_links(fps)).collect()}
    assert found == whole
    want = brute_components({int(v): int(v) for v in values.tolist()})
    assert {k: v for k, v in want.items() if k != v} == found
