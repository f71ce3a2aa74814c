import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessella.llm import exact_dedup, queries


def test_query_equals_sql_on_the_whole_table(spark, sf):
    got = {tuple(r) for r in queries.op5_exact_dedup(spark, sf).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = set(con.execute(queries.ORACLE_SQL["op5_exact_dedup"]).fetchall())
    assert got == want and len(got) == 200


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 9)), st.sampled_from([None, "", "a", "b", "c "])), max_size=25), st.sampled_from(["min", "max"]), st.integers(1, 9))
def test_rounds_equal_brute_force(docs_of, rows, keep, parts):
    df = docs_of(rows).repartition(parts)
    got = exact_dedup.exact_groups(df, keep=keep, fan_in=2).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(rows)
    assert sum(r["kept"] for r in got) == len(groups)
    best = {t: (max if keep == "max" else min)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    want = sorted(((i, best[t or ""], len(groups[t or ""])) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=str) == want
    left = exact_dedup.exact_dedup(df, keep=keep).collect()
    assert sorted((r["text"] or "") for r in left) == sorted(groups)
    assert all(r["doc_id"] == best[r["text"] or ""] for r in left)


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", 7, "x"), (2, "a", 8, "y")], "doc_id long, text string, keep_id long, _n string")
    assert [tuple(r) for r in exact_dedup.exact_dedup(df).collect()] == [(1, "a", 7, "x")]
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_are_merged_in_order_by_place(spark, docs_of):
    runs = exact_dedup.digest_runs(docs_of([f"t{n % 40}" for n in range(200)]).repartition(6), "doc_id", "text")
    rows = runs.selectExpr("_run AS _slot", "_sha", "_xx", "_len", "struct(_id, _row) AS _best", "1L AS _n")
    from pyspark.sql import functions as F

    level = exact_dedup.merged(rows, F.min, 6)
    assert "SortAggregate" in plan_of(level) and "HashAggregate" not in plan_of(level)
    assert plan_of(level).count("Exchange") == 1 + plan_of(rows).count("Exchange")
    root = exact_dedup.merge_rounds(level.withColumnRenamed("_slot", "_run"), 6, "min", 2)
    assert plan_of(root).count("Exchange") - plan_of(rows).count("Exchange") == 4  # one for the runs, three rounds for six runs
    assert {r["_n"] for r in root.collect()} == {5} and root.count() == 40
    # Each task of the last round holds one slice of the one run that is left, in order.
    parts = root.select(F.hex("_sha").alias("s"), "_best").collect()
    assert [r["s"] for r in parts] == sorted(r["s"] for r in parts)


def test_no_python_in_the_plan(spark, sf):
    plan = plan_of(queries.op5_exact_dedup(spark, sf))
    assert "Python" not in plan and "Arrow" not in plan


def test_slices_are_of_equal_width(spark):
    from pyspark.sql import functions as F

    for slices in (1, 2, 3, 64):
        df = spark.createDataFrame([(bytes([a, b, 0, 9]),) for a in (0, 1, 127, 128, 255) for b in (0, 255)], "s binary")
        got = df.select("s", exact_dedup.slice_of(F.col("s"), slices).alias("k")).collect()
        assert all(r["k"] == int.from_bytes(r["s"], "big") * slices >> 32 for r in got)


def test_repeated_rows_and_clashing_names(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (None, "b", "y"), (None, "b", "y"), (2, "a", "z"), (3, None, "w"), (4, "", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kid string").repartition(3)
    assert sorted(map(str, map(tuple, exact_dedup.exact_dedup(df).collect()))) == sorted(map(str, [(1, "a", "x"), (None, "b", "y"), (3, None, "w")]))
