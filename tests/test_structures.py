"""Interval labels, ranges of lines, sets of ignore rules, projects side by side."""

import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import classify
from tessella.operators import inventory, pages, trees
from tessella.sources import lines, sinks, tree

NODES = "tree int, id string, parent string, pos int, path string"


def brute(rows):
    """{(tree, id): (depth, first, last)} by walking from the roots."""
    out = {}
    for t in {r[0] for r in rows}:
        kids, n = {}, 0
        for _, i, p, pos, _ in (r for r in rows if r[0] == t):
            kids.setdefault(p, []).append((pos, i))

        def walk(i, depth):
            nonlocal n
            first = n
            n += 1
            for _, k in sorted(kids.get(i, [])):
                walk(k, depth + 1)
            out[t, i] = depth, first, n - 1

        for _, root in sorted(kids.get(None, [])):
            walk(root, 0)
    return out


def test_intervals_equal_a_walk(spark):
    r = random.Random(4)
    rows = []
    for t in (1, 2):
        ids = []
        for k in range(120):
            parent = r.choice([None, *ids[-40:]]) if ids else None
            rows.append((t, f"n{k}", parent, r.randrange(200_000), f"n{k}.md" if r.random() < 0.6 else None))
            ids.append(f"n{k}")
    df = spark.createDataFrame(rows, NODES)
    labels = trees.labelled(df, max_depth=64)
    got = {(x["tree"], x["id"]): (x["depth"], x["first"], x["last"]) for x in labels.collect()}
    want = brute(rows)
    assert got == want
    below = trees.subtree(labels, spark.createDataFrame([(1, "n3"), (2, "n0")], "tree int, id string"))
    for t, of in ((1, "n3"), (2, "n0")):
        _, a, b = want[t, of]
        assert {x["id"] for x in below.where((F.col("tree") == t) & (F.col("of") == of)).collect()} == {i for (u, i), v in want.items() if u == t and a <= v[1] <= b}
    order = {t: [f"{i}.md" for i in sorted((i for u, i in want if u == t), key=lambda i: want[t, i][1]) if any(x[0] == t and x[1] == i and x[4] for x in rows)] for t in (1, 2)}
    for x in trees.leaf_neighbours(labels).collect():
        own = order[x["tree"]]
        k = own.index(x["path"])
        assert (x["previous"], x["next"]) == (own[k - 1] if k else None, own[k + 1] if k + 1 < len(own) else None)


def test_odd_trees(spark):
    df = spark.createDataFrame([(1, "a", None, 0, None), (1, "b", "gone", 0, None), (1, "c", "d", 0, None), (1, "d", "c", 0, None)], NODES)
    assert [x["id"] for x in trees.labelled(df).collect()] == ["a"]
    assert trees.labelled(df.limit(0)).count() == 0
    chain = spark.createDataFrame([(1, f"n{k}", f"n{k - 1}" if k else None, 0, None) for k in range(6)], NODES)
    assert trees.labelled(chain, max_depth=6).count() == 6
    with pytest.raises(ValueError, match="deeper"):
        trees.labelled(chain, max_depth=4)


def test_ranges_read_their_bytes_alone(spark, tmp_path):
    texts = {"a/long.txt": "".join(f"line {k}\n" for k in range(1, 20_001)), "b.txt": "x\r\n\ny", "empty.txt": "", "ends.txt": "\n\n", "wide.txt": "é" * 50_000 + "\nlast"}
    df = spark.createDataFrame(list(texts.items()), "path string, text string")
    sinks.tree(df, str(tmp_path))
    marks = lines.index(tree.read_tree(spark, str(tmp_path)))
    sizes = {r["path"]: (r["size"], r["lines"]) for r in marks.collect()}
    assert sizes == {p: (len(t.encode()), len(t.split("\n")) - (t.endswith("\n") or not t)) for p, t in texts.items()}
    asked = [("a/long.txt", 10_000, 10_003), ("a/long.txt", 19_999, 30_000), ("a/long.txt", 64, 65), ("a/long.txt", 5, 4), ("b.txt", 0, 9), ("empty.txt", 1, 3), ("ends.txt", 1, 3), ("wide.txt", 2, 2), ("none.txt", 1, 1)]
    got = lines.ranges(spark.createDataFrame(asked, "path string, first int, last int"), marks, str(tmp_path)).collect()
    want = []
    for p, a, b in asked:
        if p in texts:
            own = texts[p].split("\n")
            own = own[:-1] if texts[p].endswith("\n") or not texts[p] else own
            want += [(p, n, own[n - 1]) for n in range(max(1, a), min(b, len(own)) + 1)]
    assert sorted((r["path"], r["number"], r["text"]) for r in got) == sorted(want)
    assert max(r["bytes"] for r in got if r["path"] == "a/long.txt") <= 128 * 12 < len(texts["a/long.txt"]) // 50


def test_sets_of_rules_equal_fnmatch(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choices("ab.x_1", k=r.randrange(1, 5)))
    globs = [g for _ in range(60) for g in (f"*{word()}", f"{word()}*", f"{word()}*{word()}", f"?{word()}", f"{word()}[ab]*", f"*{word()}*", word())] + ["*", "[!a]b"]
    literals = [word() for _ in range(10)]
    paths = ["/".join(word() for _ in range(r.randrange(1, 4))) for _ in range(400)]
    for own in (globs[:200], globs, globs[-1:], ["*"], []):
        df = spark.createDataFrame([(p,) for p in paths], "path string").select("path", classify.ignored_by(F.col("path"), literals, own).alias("out"))
        for p, out in df.collect():
            assert out == (any(x in literals for x in p.split("/")) or any(fnmatch.fnmatchcase(p.rsplit("/", 1)[-1], g) for g in own)), (p, own)
    for p in paths:
        rules = tree.Rules(frozenset(literals), tuple(globs[:50]), ())
        assert rules.leaves_out(p) == (p in literals or any(fnmatch.fnmatch(p, g) for g in globs[:50]))


def test_many_rules_are_a_few_lookups(spark):
    whole, heads, tails, other = classify.glob_sets([f"*.e{i:03}" for i in range(500)] + [f"p{i:03}*" for i in range(500)] + ["a", "b?c"])
    assert (whole, sorted(heads), sorted(tails), other) == (["a"], [4], [5], ["b?c"]) and len(heads[4]) == len(tails[5]) == 500


def test_projects_side_by_side(spark):
    files = [("a", "next.config.js"), ("b", "lib/x.go"), ("b", "go.mod"), ("c", "readme"), ("d", "server/x"), ("d", "package.json"), (None, "agents/x")]
    manifests = [("b", "go.mod", "module x"), ("d", "package.json", '"react"'), ("gone", "package.json", '"vue"')]
    got = inventory.archetype(spark.createDataFrame(files, "p string, path string"), spark.createDataFrame(manifests, "p string, path string, text string"), ["p"])
    assert {r["p"]: r["archetype"] for r in got.collect()} == {"a": "fullstack-framework", "b": "sdk-library", "c": "generic", "d": "generic", None: "agent-project"}


def test_first_insights(spark):
    rows = [("m", 2, ["c", "a"]), ("m", 1, ["a", "b", "a"]), ("n", 1, []), ("k", 1, [str(i) for i in range(50)])]
    got = {r["module"]: r["insights"] for r in pages.insights(spark.createDataFrame(rows, "module string, pos int, insights array<string>")).collect()}
    assert got == {"m": ["a", "b", "c"], "n": [], "k": [str(i) for i in range(10)]}
