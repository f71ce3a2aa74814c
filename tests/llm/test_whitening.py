from fractions import Fraction

import numpy as np
import pytest

from tessella.llm import queries, whitening


def brute(vectors, components=32):
    """From Python's integers and fractions: n, deviations, eigenvalues, whitened up to sign."""
    x = [[int(np.floor(np.float64(c) * 64)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    off = [[n * r[i] - sums[i] for i in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in off), n**3)) for j in range(d)] for i in range(d)])
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    centred = np.array([[v / n for v in r] for r in off], float)
    m = min(components, d)
    with np.errstate(divide="ignore", invalid="ignore"):
        return n, [sum(v * v for v in r) for r in off], values, (centred @ basis / np.sqrt(values))[:, :m], np.trace(cov)


def check(rows, vectors, components=32, key="vec_id"):
    n, deviation, values, whitened, trace = brute(list(vectors.values()), components)
    m = whitened.shape[1]
    by = {(r[key], r["component"]): r for r in rows}
    assert len(by) == len(rows) == len(vectors) * m
    got = np.array([[by[k, c + 1]["whitened"] for c in range(m)] for k in vectors], float)
    sign = np.sign((got * whitened).sum(axis=0))
    np.testing.assert_allclose(got * sign, whitened, atol=1e-6)
    for k, dev in zip(vectors, deviation, strict=True):
        for c in range(m):
            r = by[k, c + 1]
            assert r["n"] == n and int(r["deviation"]) == dev
            assert r["explained"] == pytest.approx(values[c] / trace, rel=1e-9)
    cov = np.cov(got.T, bias=True).reshape(m, m)
    errors = {r["identity_error"] for r in rows}
    assert len(errors) == 1
    assert errors.pop() == pytest.approx(np.abs(cov - np.eye(m)).max(), abs=1e-9) and np.abs(cov - np.eye(m)).max() < 1e-4


def test_query_equals_exact_fractions(spark, sf):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    rows = queries.op11_whitening(spark, sf).collect()
    check(rows, vectors)


def test_chinese_remainders_are_exact():
    moduli = whitening.primes(1 << 90)
    assert len(set(moduli)) == len(moduli) == 5 and all(p < 1 << 20 for p in moduli)
    numbers = np.array([0, 1, -1, (1 << 89) - 1, -(1 << 89), 123456789012345678901], object)
    assert whitening.chinese(np.array([[int(x % p) for x in numbers] for p in moduli]), moduli).tolist() == numbers.tolist()


def test_scatter_of_large_entries_is_exact(spark):
    r = np.random.default_rng(5)
    vectors = {i: [float(v) for v in r.normal(0, 1e9, 5)] for i in range(300)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(7)
    check(whitening.whiten(df).collect(), vectors)


def test_more_rows_than_a_block(spark):
    r = np.random.default_rng(6)
    few = r.normal(size=(40, 3)).astype(np.float32).tolist()
    vectors = {i: few[i % 40] for i in range(9000)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").repartition(2)
    rows = whitening.whiten(df, components=2).collect()
    assert len(rows) == 18000 and rows[0]["identity_error"] < 1e-9
    n, deviation, values, whitened, trace = brute(few)
    one = {(x["vec_id"], x["component"]): x for x in rows}
    assert int(one[7, 1]["deviation"]) == deviation[7] * 225**2 and one[7, 2]["explained"] == pytest.approx(values[1] / trace)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0], 9), (2, None, 9), (3, [None, 1.0], 9), (4, [nan, 1.0], 9), (5, [inf, 1.0], 9), (6, [-inf, 0.0], 9), (7, [0.5, -1.0], 9), (7, [0.5, -1.0], 9), (None, [2.0, 2.5], 9), (8, [], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")
    got = whitening.whiten(df).collect()
    assert sorted(((r["vec_id"], r["component"], r["n"]) for r in got), key=str) == sorted([(k, c, 4) for k in (1, 7, 7, None) for c in (1, 2)], key=str)
    assert got[0]["identity_error"] < 1e-9
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.where("vec_id in (2, 8)")).collect() == []
    with pytest.raises(ValueError, match="entries"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(ValueError, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>"))


def test_components_without_variance(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0, 2.0]), (2, [3.0, 5.0, 6.0])], "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(df).collect()}
    assert abs(got[1, 1]["whitened"]) == pytest.approx(1) and got[1, 1]["explained"] == pytest.approx(1) and got[1, 1]["identity_error"] < 1e-9
    assert got[1, 2]["whitened"] is None and got[1, 3]["explained"] == 0.0
    same = whitening.whiten(df.where("vec_id = 1")).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"]) for r in same] == [(None, None, None)] * 3
