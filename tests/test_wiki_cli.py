import json

from pyspark.sql import functions as F

from tessella import cli
from tessella.operators import wiki

PAGE = "# T\n\n<details open>\n<summary>Relevant source files</summary>\n\n[a](file:///src/app.py#L1-L2)\n\n</details>\n\n## S\n\n| a |\n"
PLAN = {"pages": [{"page_id": "overview", "title": "Ov", "output_path": "overview.md", "page_type": "overview", "purpose": "p", "source_targets": ["src/app.py", "none.py"], "depends_on": [], "status": "planned"}], "generation_order": ["overview"], "menu_seed": [{"title": "Start", "page_ids": ["overview"]}]}


def run(spark, capsys, command, root):
    code = cli.main([command, str(root)], spark)
    return code, [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def test_commands(spark, capsys, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/app.py").write_text("def app():\n    helper()\n\ndef helper():\n    pass\n")
    (tmp_path / "app.py").write_text("def app():\n    go()\n\ndef go():\n    app()\n")
    (tmp_path / "README.md").write_text("# R\n")
    assert {r["created"] for r in run(spark, capsys, "init", tmp_path)[1]} >= {".tessella/config.yaml"} and run(spark, capsys, "init", tmp_path)[1] == []
    assert run(spark, capsys, "inventory", tmp_path)[1][0]["total_files"] == 3
    assert {r["path"] for r in run(spark, capsys, "analyse", tmp_path)[1]} == {"src/app.py", "app.py", "README.md"}
    assert any(r["language"] == "python" and len(r["definitions"]) == 2 for r in run(spark, capsys, "structure", tmp_path)[1] if "language" in r)
    assert [(r["src"], r["dst"]) for r in run(spark, capsys, "sequences", tmp_path)[1]] == [("app", "helper")]
    assert {r["status"] for r in run(spark, capsys, "changes", tmp_path)[1]} == {"added"}
    (tmp_path / "README.md").write_text("# R2\n")
    assert [(r["path"], r["change_type"]) for r in run(spark, capsys, "changes", tmp_path)[1]] == [("README.md", "doc-only-change")]
    cache = tmp_path / ".tessella/cache"
    (cache / "page-plan.json").write_text(json.dumps(PLAN))
    (tmp_path / ".tessella/wiki/overview.md").write_text(PAGE)
    assert run(spark, capsys, "validate-plan", tmp_path) == (0, [])
    ctx = {r["target"]: r for r in run(spark, capsys, "page-context", tmp_path)[1]}
    assert ctx["src/app.py"]["end_line"] == 6 and "not readable" in ctx["none.py"]["constraint"]
    assert [(r["section"], r["path"]) for r in run(spark, capsys, "menu", tmp_path)[1]] == [("Start", "overview.md")]
    assert run(spark, capsys, "quality", tmp_path)[1][0]["quality_level"] == "professional"
    assert run(spark, capsys, "finalise", tmp_path) == (0, [])
    (tmp_path / ".tessella/wiki/overview.md").write_text(PAGE + "[x](gone.md)\n```mermaid\nflowchart TD\nA[a b]\n```\n")
    code, rows = run(spark, capsys, "finalise", tmp_path)
    assert code == 1 and any("gone.md" in r["message"] for r in rows)
    assert run(spark, capsys, "diagrams", tmp_path)[1][0]["fixes"] == 1
    assert run(spark, capsys, "titles", tmp_path)[1][0]["title"] == "T" and run(spark, capsys, "folders", tmp_path)[1][0]["section"] == "概览"


def test_menu_from_folders(spark):
    docs = [("overview.md", "# O"), ("doc-map.md", ""), ("concepts/a.md", "# A"), ("concepts/index.md", ""), ("deep-dive/b.md", "x"), ("changelog.md", "# C"), ("guides/g.md", "# G"), ("assets/z.md", ""), ("_x/y.md", "")]
    got = [(r["section"], r["group"], r["title"], r["path"]) for r in wiki.menu_from_folders(spark.createDataFrame(docs, "path string, text string"), "en").orderBy("section_pos", "group", "pos").collect()]
    assert got == [("Overview", None, "O", "overview.md"), ("Overview", None, "Doc Map", "doc-map.md"), ("Concepts", None, "A", "concepts/a.md"), ("Deep Dive", None, "b", "deep-dive/b.md"), ("More", "Other", "C", "changelog.md"), ("More", "guides", "G", "guides/g.md")]


def test_lookups(spark):
    files = spark.createDataFrame([("src/a b.py",), ("app/main.py",)], "file string")
    refs = spark.createDataFrame([(r,) for r in ("file:///root/p/src/a%20b.py", "src/a b.py", "./app/main.py", "/app/main.py", "no.py")], "reference string")
    got = {r["reference"]: r["file"] for r in wiki.resolve_sources(refs, files, "/root/p").collect()}
    assert list(got.values()).count("src/a b.py") == 2 and got["./app/main.py"] == got["/app/main.py"] == "app/main.py" and got["no.py"] is None
    tree = wiki.folder_tree(spark.createDataFrame([("b/x.py",), ("a.py",), ("b/c/y.py",)], "path string"))
    assert [(r["folder"], r["name"], r["files"]) for r in tree.collect()] == [("", "b", 2), ("", "a.py", 1), ("b", "c", 1), ("b", "x.py", 1), ("b/c", "y.py", 1)]
    m = spark.createDataFrame([("package.json", '{"workspaces": {"packages": ["libs/*", "none/*"]}}'), ("pnpm-workspace.yaml", "packages:\n  - 'tools/*'\n")], "path string, text string")
    f = spark.createDataFrame([("libs/a/x",), ("tools/b",), ("apps/c",)], "path string")
    assert {(r["folder"], r["stated"]) for r in wiki.workspaces(m, f).collect()} == {("libs", True), ("tools", True), ("apps", False)}
    t = lambda rows: spark.createDataFrame(rows, "path string, v int")
    assert {tuple(r) for r in wiki.file_data([t([("a", 1)]), t([("a", 2), ("b", 3)])]).collect()} == {("a", 1), ("b", 3)}
    hit, miss = wiki.cached_or_parsed(files.select(F.col("file").alias("path")), t([("app/main.py", 1)]))
    assert hit.count() == miss.count() == 1
    e = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    got = {(r["src"], r["dst"]): r["verdict"] for r in wiki.reconcile_dependencies(e([("a", "b"), ("a", "c"), ("d", "e")]), e([("a", "b"), ("e", "d"), ("x", "y")])).collect()}
    assert got == {("a", "b"): "confirmed", ("a", "c"): "parsed_only", ("d", "e"): "conflict", ("x", "y"): "hinted_only"}
    r = spark.createDataFrame([("---\nname: x\ndesc: a b\n---\n[l](a.md) [m](http://x) [n](#q)",)], "t string").select(wiki.front_matter(F.col("t")).alias("m"), wiki.local_links(F.col("t")).alias("l")).first()
    assert r["m"] == {"name": "x", "desc": "a b"} and r["l"] == ["a.md"]
    mm = spark.sql("SELECT map('a', 1, 'b', 2) m").select(wiki.only_keys(F.col("m"), ["a"]).alias("o"), wiki.without_keys(F.col("m"), ["a"]).alias("w")).first()
    assert mm["o"] == {"a": 1} and mm["w"] == {"b": 2}
    top = wiki.menu_from_topology(spark.createDataFrame([(0, "S", None, 0, "p1"), (0, "S", None, 1, "zz")], "section_pos int, section string, group string, pos int, page_id string"), spark.createDataFrame([("p1", "T", "wiki/a.md")], "id string, title string, output_path string"))
    assert [(x["title"], x["path"]) for x in top.collect()] == [("T", "a.md")]
    parts = {r["page_type"]: r for r in wiki.components_of(spark.createDataFrame([("overview",), ("x",)], "page_type string")).collect()}
    assert "nav-links" in parts["overview"]["required"] and parts["x"]["required"] == parts["x"]["recommended"] == []
