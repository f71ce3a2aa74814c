import itertools

import pytest
from pyspark.sql import functions as F

from tessella.functions.columns import py_round
from tessella.operators import scoring

RAW = "path string, path_score double, identity_score double, lang_score double, size_score double, degree_score double, module string"


def normalised(spark, rows):
    df = spark.createDataFrame([(p, s, 0.0, 1.0, 1.0, 0.0, m) for p, s, m in rows], RAW).withColumn("importance_score", F.lit(0.0))
    return {r["path"]: r for r in scoring.normalise(df).collect()}


def test_files_of_a_module_are_told_apart(spark):
    got = normalised(spark, [("core/engine.py", 1.0, "core"), ("core/constants.py", 0.5, "core"), ("core/helpers.py", 0.3, "core")])
    order = [got[f"core/{n}.py"]["path_score_normalized"] for n in ("helpers", "constants", "engine")]
    assert order == sorted(order) and order[0] < order[-1]


def test_a_module_of_one_file_keeps_its_raw_score(spark):
    got = normalised(spark, [("solo/a.py", 0.3, "solo")])["solo/a.py"]
    assert got["path_score_normalized"] == 0.3 and got["percentile"] is None and got["importance_score"] == round(0.3 * 0.3 + 0.3 + 0.15, 2)


def test_modules_do_not_affect_each_other(spark):
    a = normalised(spark, [("src/auth/x", 1.0, "a"), ("src/auth/y", 0.3, "a")])
    b = normalised(spark, [("src/auth/x", 1.0, "a"), ("src/auth/y", 0.3, "a"), ("src/api/x", 0.8, "b"), ("src/api/y", 0.2, "b")])
    assert all(a[p]["importance_score"] == b[p]["importance_score"] for p in a)


def test_of_nested_modules_the_last_wins(spark):
    files = spark.createDataFrame([("src/api/v1/x.py",), ("src/y.py",), ("z.py",)], "path string")
    modules = spark.createDataFrame([("src/api", 0), ("src", 1), ("src/api/v1", 2)], "path string, pos int")
    got = {r["path"]: r["module"] for r in scoring.with_module(files, modules).collect()}
    assert got == {"src/api/v1/x.py": "src/api/v1", "src/y.py": "src", "z.py": None}


def test_scores_equal_a_plain_restatement(spark):
    paths = ["src/main.py", "lib/user_service.ts", "cmd/x.go", "db/migrations/1.sql", "README.md", "a/b/store/q.css", "x/config.yaml", "deep/y.lock", "Makefile", "a/.env", "bin/no_ext", "w/Cargo.toml"]
    sizes = [0, 99, 100, 1023, 1024, 51200, 51201]
    rows = [(p, s, d) for p, s in itertools.product(paths, sizes) for d in (0, 3, 25)]
    df = spark.createDataFrame(rows, "path string, size long, d int")
    for r in scoring.importance(df, degree="d").collect():
        assert r["size_score"] == (1.0 if 1024 <= r["size"] <= 51200 else 0.5 if 100 <= r["size"] < 1024 else 0.0)
        assert r["degree_score"] == min(r["d"] / 10, 1)
        total = r["path_score"] * 0.3 + r["identity_score"] * 0.25 + r["lang_score"] * 0.3 + r["size_score"] * 0.15 + r["degree_score"] * 0.15
        assert r["total"] == round(min(total, 1.0), 4) and 0 <= r["importance_score"] <= 1
    got = {r["path"]: r for r in scoring.importance(df, degree="d").collect()}
    assert got["src/main.py"]["path_score"] == got["src/main.py"]["identity_score"] == 1.0
    assert got["lib/user_service.ts"]["identity_score"] == 0.8 and got["a/b/store/q.css"]["identity_score"] == 0.5 and got["x/config.yaml"]["identity_score"] == 0.3
    assert [got[p]["lang_score"] for p in ("db/migrations/1.sql", "Makefile", "x/config.yaml", "a/b/store/q.css", "deep/y.lock", "bin/no_ext")] == [0.9, 0.5, 0.4, 0.3, 0.1, 0.0]


def test_agent_contract_scores_fully(spark):
    df = spark.createDataFrame([("SKILL.md", 1)], "path string, size long")
    assert scoring.importance(df, "agent-project").first()["total"] == 0.85
    assert scoring.importance(df).first()["total"] < 0.5


def test_rounding_is_that_of_binary_doubles(spark):
    values = [k / 200 for k in range(200)] + [0.285, 0.575, 1.005, 0.145]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", py_round(F.col("x"), 2).alias("r")).collect()
    assert all(r["r"] == round(r["x"], 2) for r in got)


@pytest.mark.parametrize("n", [0, 5, 19, 20, 57])
def test_thresholds(spark, n):
    scores = [((i * 37) % 101) / 100 for i in range(n)]
    got = scoring.thresholds(spark.createDataFrame([(s,) for s in scores], "importance_score double")).first()
    if n < 20:
        assert (got["core"], got["high"]) == (0.5, 0.6)
    else:
        ordered = sorted(scores, reverse=True)
        assert got["core"] == max(0.2, min(0.9, ordered[int(n * 0.35)])) and got["high"] == max(0.2, min(0.9, ordered[int(n * 0.15)]))


def test_budget(spark):
    rows = [("core.py", 0.9, True, True, 2000), ("notes.md", 0.8, False, True, 1600), ("feature.py", 0.7, False, True, 4000)]
    got = scoring.budget(spark.createDataFrame(rows, "path string, importance_score double, is_core boolean, is_high_priority boolean, size long")).first()
    assert (got["total_budget"], got["reserved"], got["available"], got["quick_files"], got["deep_files"]) == (50_000, 16_500, 33_500, 1, 2)
    assert got["deep_cost"] == 1400
