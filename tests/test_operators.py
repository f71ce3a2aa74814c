import random

from pyspark.sql import functions as F

from tessella.functions import classify, text
from tessella.functions.columns import glob_regex, normal_path, safe_id, slug, suffix
from tessella.operators import diff, graph, inventory, pages, quality


def values(spark, strings, column):
    return [r[0] for r in spark.createDataFrame(list(enumerate(strings)), "i int, s string").orderBy("i").select(column(F.col("s"))).collect()]


def test_categories_take_the_first_rule(spark):
    paths = ["tests/app.py", "latest_news.py", "pyproject.toml", "docs/a.md", "src/app.py", "a.json", "x/test_y.md", "LICENSE", "a.PY"]
    assert values(spark, paths, classify.category) == ["test", "test", "config", "doc", "code", "data", "test", "other", "code"]
    assert values(spark, [".env", "a.b.C", "noext", "x."], suffix) == ["", ".c", "", ""]


def test_purposes_and_kinds(spark):
    assert values(spark, ["src/domain.py", "x/user_agent.py", "a/views/b", "a/api/b", "a/db/b", "z"], classify.code_purpose) == ["Entry", "Agent", "Page", "Api", "Database", "Other"]
    assert values(spark, ["LoginPage", "user_service", "core", "zzz"], classify.module_kind) == ["ui", "api", "core", "module"]


def test_manifest_names_are_whole_tokens(spark):
    texts = ["torch==2", "torchaudio", "vue", "vuepress", "github.com/gin-gonic/gin v1", "engine", "x-torch"]
    assert values(spark, texts, lambda t: classify.dependency(t, "torch")) == [True, False, False, False, False, False, False]
    assert values(spark, texts, lambda t: classify.dependency(t, "vue")) == [False, False, True, False, False, False, False]
    assert values(spark, texts, lambda t: classify.dependency(t, "github.com/gin-gonic/gin"))[4]


def test_archetypes(spark):
    def kind(files, manifests=()):
        inv = spark.createDataFrame([(f,) for f in files], "path string")
        return inventory.archetype(inv, spark.createDataFrame(list(manifests), "path string, text string")).first()[0]

    assert kind(["next.config.js"]) == "fullstack-framework"
    assert kind(["agents/a.md"]) == "agent-project"
    assert kind(["requirements.txt"], [("requirements.txt", "torch")]) == "ml-project"
    assert kind(["requirements.txt"], [("requirements.txt", "torchaudio")]) == "generic"
    assert kind(["Cargo.toml"], [("Cargo.toml", "[[bin]]")]) == "cli-tool"
    assert kind(["package.json"], [("package.json", '"react": 1')]) == "spa-frontend"
    assert kind(["package.json", "server/x.js"], [("package.json", '"react": 1')]) == "generic"
    assert kind(["go.mod", "lib/a.go"], [("go.mod", "module x")]) == "sdk-library"


def test_project_types_and_probes(spark):
    inv = inventory.with_facts(spark.createDataFrame([(p, 1, "") for p in ["package.json", "tsconfig.base.json", "yarn.lock", "src/main.ts", "src/main/java/A.java", "README.md", "README.zh.md", "docs/a.md", "docs/b/c.md", "x.sln"]], "path string, size int, text string"))
    assert {r[0] for r in inventory.project_types(inv).collect()} == {"nodejs", "typescript", "dotnet"}
    assert {r[0] for r in inventory.lockfile_managers(inv).collect()} == {"yarn"}
    assert {r["path"] for r in inventory.probed_entries(inv).collect()} == {"src/main.ts", "src/main/java"}
    assert [r["path"] for r in inventory.known_documents(inv).orderBy("place", "path").collect()] == ["README.md", "README.zh.md", "docs/a.md"]
    assert {(r["name"], r["is_dir"]) for r in inventory.top_level(inv).collect()} >= {("src", True), ("README.md", False)}


def test_small_text_functions(spark):
    assert values(spark, ["a/b/../c/./d.md", "../x", "/a//b"], normal_path) == ["a/c/d.md", "x", "a/b"]
    assert values(spark, [" Ab c! ", "数据 x", "--", "a__b"], slug) == ["Ab-c", "数据-x", "topic", "a__b"]
    assert values(spark, ["a:b/c", "///"], safe_id) == ["a_b_c", "page"]
    assert values(spark, ["/tmp/p.md", "../p.md", "a/p.md", "p.txt"], classify.safe_markdown_path) == [False, False, True, False]
    assert values(spark, ["packages/a/src/b/c", "apps/x", "src/y", "packages"], lambda p: classify.monorepo(p)["slug"]) == ["b-c", "x", "", ""]
    assert values(spark, ["x\nTODO: a\n# c\n\ncode", ""], lambda t: F.concat_ws(",", text.loc(t), text.todo_lines(t).cast("array<string>"))) == ["3,1", "0"]
    import re

    assert re.fullmatch(glob_regex("*.log"), "a.log") and not re.fullmatch(glob_regex("a?.[ch]"), "ab.x")
    got = values(spark, ["file:///a%20b.py#L3-L9", "/api?path=x&start=2&end=4", "a.py#L7"], text.parse_reference)
    assert [(r["path"], r["start"], r["end"]) for r in got] == [("/a b.py", 3, 9), ("/api", 2, 4), ("a.py", 7, 7)]
    assert values(spark, ["a {{ X }} {{Y}}"], lambda t: text.render(t, {"X": F.lit("$1")})) == ["a $1 {{Y}}"]


GOOD = "# T\n\n<details open>\n<summary>Relevant source files</summary>\n\n- [a](file:///src/a.py#L1-L9)\n\n</details>\n\n## S\n\nThe diagram shows the flow.\n\n```mermaid\nflowchart TD\nA-->B\n```\n"


def test_current_quality(spark):
    docs = {"good": GOOD, "no_block": "# T\n\n## S\n\n[a](file:///a#L1) | x", "no_preface": GOOD.replace("The diagram shows the flow.\n\n", ""), "empty": ""}
    got = {r["path"]: r for r in quality.current(spark.createDataFrame(list(docs.items()), "path string, text string")).collect()}
    assert got["good"]["issues"] == [] and got["good"]["quality_level"] == "professional"
    assert any("Relevant source files" in i for i in got["no_block"]["issues"])
    assert any("diagram" in i.lower() for i in got["no_preface"]["issues"])
    assert got["empty"]["quality_level"] == "basic" and got["empty"]["line_count"] == 0


def test_links(spark):
    docs = spark.createDataFrame([("a/p.md", "[x](q.md) [y](../r.md#s) [z](#h) [w](https://e) [v](none.md) ![i](no.png) [u](file:///src/a.py#L2) [t](src/a.py)")], "path string, text string")
    files = spark.createDataFrame([("a/q.md",), ("r.md",), ("src/a.py",)], "file string")
    assert [r["target"] for r in quality.broken_links(docs, files).collect()] == ["none.md"]


def test_interfaces(spark):
    imports = spark.createDataFrame([("auth", "users", "find_user"), ("auth", "gone", "x")], "source string, target string, interface string")
    docs = spark.createDataFrame([("users", "has `create_user(` and `string`")], "module string, text string")
    assert [tuple(r) for r in quality.missing_interfaces(imports, docs).collect()] == [("auth", "users", "find_user")]


def test_finalise_and_severity(spark):
    p = spark.createDataFrame([("a", "a.md", "planned"), ("b", "b.md", "planned"), ("c", "c.md", "skipped")], "page_id string, output_path string, status string")
    docs = spark.createDataFrame([("a.md", GOOD + "[x](gone.md)")], "path string, text string")
    got = {(r["kind"], r["subject"]) for r in quality.finalise(p, docs.select(F.col("path").alias("file")), docs).collect()}
    assert ("missing", "b.md") in got and ("link", "a.md") in got and not any(s == "c.md" for _, s in got)
    assert quality.severity(spark.createDataFrame([("warning",)], "severity string")).first()["passed"]


def test_plan_faults(spark):
    full = list(pages.R.PAGE_FIELDS)
    rows = [(0, full, "overview", "o.md", ["x"]), (1, full, "overview", "/t/p.md", ["x"]), (2, full[1:], "r", "../p.md", []), (3, full, "s", "p.txt", ["x"]), (4, full, "", "o.md", ["x"])]
    plan = spark.createDataFrame(rows, "pos int, fields array<string>, page_id string, output_path string, source_targets array<string>")
    got = {r[0] for r in pages.plan_errors(plan, spark.createDataFrame([("overview",), ("zz",)], "page_id string")).collect()}
    for part in ("duplicate page_id: overview", "duplicate output_path: o.md", "unsafe or not markdown: /t/p.md", "unsafe or not markdown: ../p.md", "unsafe or not markdown: p.txt", "pages[2] missing fields: depends_on", "pages[2] source_targets", "pages[4] page_id", "misses: r", "unknown: zz"):
        assert any(part in m for m in got), part


def test_menus(spark):
    plan = spark.createDataFrame([(0, "overview", "Ov", "o.md", "overview"), (1, "runtime", None, "r.md", "deep-dive")], "pos int, page_id string, title string, output_path string, page_type string")
    seed = spark.createDataFrame([(0, "Start", ["overview", "none"]), (1, "Empty", ["none"]), (2, "Details", ["runtime"])], "section_pos int, section string, page_ids array<string>")
    got = [(r["section"], r["title"], r["path"]) for r in pages.menu_from_seed(seed, plan).orderBy("section_pos").collect()]
    assert got == [("Start", "Ov", "o.md"), ("Details", "runtime", "r.md")]
    by_type = pages.menu_by_type(plan)
    assert [r["section"] for r in by_type.orderBy("section_pos").collect()] == ["Overview", "Deep Dive"]
    assert pages.doc_map(by_type, "P").first()[0] == "# P Documentation Map\n\n## Overview\n\n- [Ov](o.md)\n\n## Deep Dive\n\n- [runtime](r.md)\n"
    menu = spark.createDataFrame([("A", 0, "x", "a.md"), ("A", 1, "y", "a.md"), ("A", 2, "g", "gone.md")], "section string, pos int, title string, path string")
    files = spark.createDataFrame([("a.md", "New"), ("b.md", "B"), ("overview.md", "O")], "file string, title string")
    assert {(r["section"], r["title"], r["path"]) for r in pages.reconcile(menu, files).collect()} == {("A", "New", "a.md"), ("更多", "B", "b.md")}


def test_page_context(spark):
    targets = spark.createDataFrame([("p", "a.py"), ("p", "none.py")], "page_id string, target string")
    got = {r["target"]: r for r in pages.contexts(targets, spark.createDataFrame([("a.py", "line one\nline two")], "path string, text string"), 12).collect()}
    assert got["a.py"]["excerpt"] == "line one\nlin" and got["a.py"]["end_line"] == 2 and "not readable" in got["none.py"]["constraint"]
    assert {(r["page_id"], r["related"]) for r in pages.related(spark.createDataFrame([("runtime", "overview")], "page_id string, depends_on string")).collect()} == {("runtime", "overview"), ("overview", "runtime")}


def test_ranges_and_signatures(spark):
    df = spark.sql("""SELECT array(named_struct('start_line', 3L, 'end_line', null, 'label', '', 'name', 'n', 'reason', '', 'summary', 's'), named_struct('start_line', null, 'end_line', 1L, 'label', 'x', 'name', '', 'reason', '', 'summary', '')) core,
        array(named_struct('line', 5L, 'end_line', 8L, 'name', 'f')) itf, array(named_struct('name', 'a', 'kind', 'function', 'line', 1, 'end_line', 2, 'doc', 'd', 'parent', ''), named_struct('name', 'b', 'kind', 'method', 'line', 4, 'end_line', 5, 'doc', '', 'parent', 'C')) defs""")
    got = df.select(pages.source_ranges(F.col("core"), F.col("itf")).alias("r"), pages.signatures(F.col("defs"), F.lit("standard")).alias("s"), pages.signatures(F.col("defs"), F.lit("quick")).alias("q"), pages.exports(F.col("defs"), F.array(F.lit(9))).alias("e")).first()
    assert [tuple(x) for x in got["r"]] == [(3, 3, "n", "s"), (5, 8, "f", "public interface")]
    assert [x["kind"] for x in got["s"]] == ["function", None] and got["q"] == [] and got["e"] == ["a"]


def test_wiki_keys_and_insights(spark):
    keys = spark.createDataFrame([("src/auth", "wiki/deep-dive/auth.md", 0), ("src/user-api", None, 1)], "module string, doc_path string, pos int")
    plan = spark.createDataFrame([("wiki/x.md", "src/planned")], "page string, module string")
    df = spark.createDataFrame([("wiki/x.md",), ("deep-dive/auth.md",), ("other/user_api.md",), ("none.md",)], "page string")
    assert {r["page"]: r["module"] for r in quality.wiki_key(df, keys, plan).collect()} == {"wiki/x.md": "src/planned", "deep-dive/auth.md": "src/auth", "other/user_api.md": "src/user-api"}
    files = spark.createDataFrame([("m", 1, ["b", "a"]), ("m", 0, ["a", "c"])], "module string, pos int, insights array<string>")
    assert pages.insights(files, 2).first()["insights"] == ["a", "c"]
    assert {tuple(r) for r in pages.file_to_module(spark.createDataFrame([("a", 0, ["f"]), ("b", 1, ["f", "g"])], "module string, pos int, files array<string>")).collect()} == {("f", "b"), ("g", "b")}


def test_snapshots(spark):
    s = lambda rows: spark.createDataFrame(rows, "path string, hash string")
    a = [("x", "1"), ("y", "2"), ("z", "3")]
    status = lambda o, n: {r["path"]: r["status"] for r in diff.snapshot_diff(s(o), s(n)).collect()}
    assert set(status([], a).values()) == {"added"} and set(status(a, a).values()) == {"unchanged"}
    assert status(a, [("x", "1"), ("y", "9"), ("w", "4")]) == {"x": "unchanged", "y": "modified", "z": "deleted", "w": "added"}


def test_propagation_is_one_hop(spark):
    modules = spark.createDataFrame([("core", "core"), ("api", "src/api"), ("ui", "src/ui"), ("far", "far")], "name string, path string")
    imports = spark.createDataFrame([("api", "core.index"), ("ui", "src/api/x"), ("far", "corex")], "name string, target string")
    changed = spark.createDataFrame([("core",)], "name string")
    assert {r[0] for r in diff.propagate(changed, modules, imports).collect()} == {"api"}


def test_breadth_first_order(spark):
    calls = spark.createDataFrame([("main", 0, "b"), ("main", 1, "a"), ("b", 0, "c"), ("a", 0, "c"), ("a", 1, "ext"), ("c", 0, "main")], "src string, pos int, dst string")
    got = graph.visits(calls, spark.createDataFrame([("main",), ("none",)], "start string"))
    assert [(r["node"], r["depth"]) for r in got.orderBy("ord").collect()] == [("main", 0), ("b", 1), ("a", 1), ("c", 2)]
    assert [(r["src"], r["dst"]) for r in graph.sequences(got).orderBy("ord").collect()] == [("main", "b"), ("b", "a"), ("a", "c")]
    chain = spark.createDataFrame([(f"n{i}", 0, f"n{i + 1}") for i in range(10)] + [("n10", 0, "n0")], "src string, pos int, dst string")
    assert graph.visits(chain, spark.createDataFrame([("n0",)], "start string")).count() == 7


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    nodes = [f"n{i:03}" for i in range(120)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(90)] + [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)]
    parent = {n: n for n in nodes}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {n: find(n) for n in nodes}


def test_entry_handlers(spark):
    calls = spark.createDataFrame([("main", ["x"]), ("app.start", ["y"]), ("server", [])], "qname string, calls array<string>")
    entries = spark.createDataFrame([("src/main.py",), ("server.py",), ("cli.py",)], "name string")
    assert {r["name"]: r["handler"] for r in graph.entry_handlers(entries, calls).collect()} == {"src/main.py": "main", "server.py": "server", "cli.py": "main"}
    alone = spark.createDataFrame([("app.start", ["y"])], "qname string, calls array<string>")
    assert graph.entry_handlers(spark.createDataFrame([("app.py",), ("z.py",)], "name string"), alone).orderBy("name").collect()[0]["handler"] == "app.start"


def test_module_splitting(spark):
    paths = ["src/a/x/1.py", "src/a/x/2.py", "src/a/y/1.py", "src/b/1.py", "src/main.py", "src/docs/r.md"]
    inv = inventory.with_facts(spark.createDataFrame([(p, 1, "") for p in paths], "path string, size int, text string"))
    assert {(r["path"], r["files"]) for r in graph.split_modules(inv, "src").collect()} == {("src/a/x", 2), ("src/a/y", 1), ("src/b", 1)}
    assert {(r["path"], r["kind"]) for r in graph.expand_container(inv, "src").collect()} >= {("src/main.py", "core")}


def test_cross_groups_and_stale(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src_module string, dst_module string")
    groups = spark.createDataFrame([("a", "g1"), ("b", "g1"), ("c", "g2")], "module string, group string")
    assert [tuple(r) for r in graph.cross_groups(edges, groups).collect()] == [("g1", "g2")]
    one = spark.createDataFrame([("m", "h1"), ("n", "h2")], "module string, input_hash string")
    assert [r["module"] for r in diff.stale(one, one.where("module = 'm'")).collect()] == ["n"]
    assert diff.included(spark.createDataFrame([("a/b.py",), ("dist/c.py",), ("d.log",), ("e.md",), ("x.gen.py",)], "path string"), ["dist"], [], ["*.gen.py"]).count() == 2


def test_components_settle_or_fail(spark):
    import pytest

    chain = spark.range(200).selectExpr("lpad(id, 4, '0') AS src", "lpad(id + 1, 4, '0') AS dst")
    nodes = spark.range(202).selectExpr("lpad(id, 4, '0') AS node")
    got = {r["node"]: r["component"] for r in graph.components(nodes, chain).collect()}
    assert set(got.values()) == {"0000", "0201"} and got["0200"] == "0000"
    with pytest.raises(RuntimeError, match="settle"):
        graph.components(nodes, chain, max_rounds=2)


def test_neighbours_meet_across_blocks(spark):
    rows = [("s", 0, n, f"p{n}", n % 7 == 3) for n in range(40)] + [("t", 1, 5, "q", False)]
    menu = spark.createDataFrame(rows, "section string, section_pos int, pos long, path string, planned boolean")
    want = [f"p{n}" for n in range(40) if n % 7 != 3]
    for block in (1, 4, 100):
        got = {r["path"]: (r["previous"], r["next"]) for r in pages.neighbours(menu, ["section"], block).collect()}
        assert got.pop("q") == (None, None)
        assert got == {p: (want[i - 1] if i else None, want[i + 1] if i + 1 < len(want) else None) for i, p in enumerate(want)}


def test_handlers_by_parts_of_names(spark):
    calls = spark.createDataFrame([("XmainY", ["a"]), ("cli", []), ("zz", ["b"])], "qname string, calls array<string>")
    entries = spark.createDataFrame([("src/main.py",), ("src/cli.py",), ("none.py",), ("z.ts",)], "name string")
    assert {tuple(r) for r in graph.entry_handlers(entries, calls).collect()} == {("src/main.py", "XmainY"), ("src/cli.py", "cli"), ("none.py", "none"), ("z.ts", "zz")}


def test_self_check(spark):
    files = spark.createDataFrame([("F.md", "---\nname: tool\ndescription: x\n---"), ("a.md", "Reads IT now")], "path string, text string")
    required = spark.createDataFrame([("F.md",), ("a.md",), ("b.md",)], "path string")
    got = {r["message"] for r in quality.self_check(files, required, "F.md", "tool", ["reads it"]).collect()}
    assert got == {"missing required file: b.md", "a.md declares legacy dependency: reads it"}
    assert quality.self_check(files, required.where("path = 'F.md'"), "F.md", "tool", ["reads it"]).count() == 0


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from tessella.scratch import scratch_root

    def session(master, folder=None):
        context = SimpleNamespace(applicationId="app-1", master=master, getCheckpointDir=lambda: None)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: folder))

    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch_root(session(master))
        assert scratch_root(session(master, "hdfs://n/x/")) == "hdfs://n/x/tessella-app-1"
    assert scratch_root(session("local[4]")).endswith("/tessella-app-1")


def test_scratch_is_released(spark):
    import os

    from tessella.scratch import discard, materialise, scratch_root

    one, two = materialise(spark.range(3), "one"), materialise(spark.range(4), "two")
    path = one._scratch
    assert os.path.isdir(path) and path.startswith(scratch_root(spark))
    discard(one)
    assert not os.path.exists(path) and two.count() == 4
