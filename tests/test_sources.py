from pyspark.sql import functions as F

from tessella.functions import code, diagrams
from tessella.operators import inventory
from tessella.sources import sinks, tree
from tessella.streaming import incremental


def make(root, files):
    for name, body in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    return str(root)


def test_hidden_and_underscored_files_are_kept(spark, tmp_path):
    root = make(tmp_path, {"a/f.py": "x", "a/_p.py": "", "a/__init__.py": "", ".env": "", ".github/x.yml": "", "node_modules/z.js": "", "img.PNG": "", ".DS_Store": ""})
    got = {r["path"]: r["text"] for r in tree.read_tree(spark, root, partitionBytes="1").collect()}
    assert set(got) == {"a/f.py", "a/_p.py", "a/__init__.py", ".env", ".github/x.yml"} and got["a/f.py"] == "x"
    assert {r["path"] for r in tree.read_tree(spark, root, folders="true", content="false").where("is_dir").collect()} == {"a", ".github"}
    (tmp_path / ".gitignore").write_text("# c\n*.yml\n/x\n!keep\na/ # note\n**/deep\nq/**\n")
    assert {r["path"] for r in tree.read_tree(spark, root, gitignore="true").collect()} == {".env", ".gitignore"}
    assert tree.gitignore("*.log\nbuild/\n!x\n**/tmp\nq/**\n# c\n a # b") == (["build", "tmp", "q", "a"], ["*.log"])


def test_inventory_of_a_tree(spark, tmp_path):
    root = make(tmp_path, {"src/app.py": "print(1)", "tests/test_app.py": "", "README.md": "# x", "pyproject.toml": ""})
    inv = inventory.files(tree.read_tree(spark, root))
    assert {r["path"]: r["category"] for r in inv.collect()} == {"src/app.py": "code", "tests/test_app.py": "test", "README.md": "doc", "pyproject.toml": "config"}
    s = inventory.stats(inv).first()
    assert (s["total_files"], s["code_files"], s["languages"], s["max_depth"]) == (4, 1, "python", 2)
    assert inventory.managers_and_frameworks(inv, []).first()["uses_pip"]


def test_versions_of_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"cache_schema_version": 2, "x": 1}')
    schema = "cache_schema_version int, x int"
    assert tree.checked_json(spark, str(tmp_path / "a.json"), schema, 2).first()["x"] == 1
    assert tree.checked_json(spark, str(tmp_path / "a.json"), schema, 3).count() == 0
    import pytest

    with pytest.raises(ValueError):
        tree.checked_json(spark, str(tmp_path / "a.json"), schema, 3, strict=True)


PY = '"""Mod."""\nimport os\nfrom .core import x\nfrom a.b import c\n\nclass A(Base):\n    """A class.\n\n    Args:\n        n (int): how many\n            of them\n\n    Returns:\n        a thing\n    """\n    @deco\n    def m(self):\n        self.run()\n        helper(1); helper(2); len(x)\n        return os.path.join("a")\n\ndef helper(v):\n    if v:\n        return A().m()\n'


def test_python(spark):
    got = code.parse(PY, ".py")
    assert [(d["name"], d["kind"], d["parent"]) for d in got["definitions"]] == [("A", "class", ""), ("m", "method", "A"), ("helper", "function", "")]
    calls = {c["qname"]: c["calls"] for c in got["calls"]}
    assert calls["A.m"] == ["helper", "os.path.join"] or calls["A.m"][0] == "helper"
    assert got["imports"] == ["os", ".core", "a.b"]
    doc = next(d for d in got["docs"] if d["name"] == "A")
    assert doc["params"] == [{"name": "n", "type": "int", "description": "how many"}] and doc["returns"] == "a thing"
    assert 0 < got["complexity"] <= 100 and got["important_lines"] >= 6
    broken = code.parse("def f(:\n  x", ".py")
    assert broken["definitions"] == [] and broken["important_lines"] == 2
    assert code.parse("", ".py")["complexity"] == 0 and code.parse("a\n\nb", ".zz")["important_lines"] == 2


def test_languages_with_braces():
    js = code.parse("import a from './a';\nconst b = require('b');\n/** Adds.\n * @param {number} x - first\n * @returns {number} sum\n * @example add(1)\n */\nexport function add(x, y) { if (x) { log(x); this.dao.find(y); } return add2(x) }\nclass K {\n  run(a) { add(1, 2); }\n}\nconst f = (q) => { g(q) };\n", ".ts")
    assert {(d["name"], d["parent"]) for d in js["definitions"]} >= {("add", ""), ("K", ""), ("run", "K"), ("f", "")}
    calls = {c["qname"]: c["calls"] for c in js["calls"]}
    assert calls["add"] == ["log", "add2", "dao.find"] and calls["K.run"] == ["add"]
    assert js["imports"] == ["./a", "b"]
    assert js["docs"][0]["params"] == [{"name": "x", "type": "number", "description": "first"}] and js["docs"][0]["returns"] == "number: sum" and js["docs"][0]["examples"] == ["add(1)"]
    go = code.parse('package m\nimport (\n"fmt"\n"a/b"\n)\n// Run it.\nfunc (s *Srv) Run(x int) { fmt.Println(x); if x > 1 { help() } }\nfunc help() {}\ntype Srv struct {}\n', ".go")
    assert {(d["name"], d["parent"]) for d in go["definitions"]} == {("Run", "Srv"), ("help", ""), ("Srv", "")} and go["imports"] == ["fmt", "a/b"]
    assert go["docs"][0]["description"] == "Run it." and {c["qname"]: c["calls"] for c in go["calls"]}["Srv.Run"] == ["help", "fmt.Println"]
    rs = code.parse("use crate::core::x;\n/// Doc.\n/// # Examples\n/// ```\n/// y()\n/// ```\npub fn f<'a>(s: &'a str) { g(s) }\nstruct P {}\nimpl P { fn m(&self) { f(1) } }\n", ".rs")
    assert {(d["name"], d["parent"]) for d in rs["definitions"]} == {("f", ""), ("P", ""), ("m", "P")} and rs["imports"] == ["core::x"] and rs["docs"][0]["examples"] == ["```", "y()", "```"]
    jv = code.parse("import a.b.C;\n/** Does. @x */\npublic class T {\n  public int go(int a) { if (a > 1) { call(a); } return 1; }\n}\n", ".java")
    assert {(d["name"], d["parent"]) for d in jv["definitions"]} == {("T", ""), ("go", "T")} and jv["imports"] == ["a.b.C"] and jv["complexity"] > 0


def test_parsing_in_batches(spark):
    df = spark.createDataFrame([("a.py", ".py", PY), ("b.ts", ".ts", "function f() { g() }"), ("c", "", None)], "path string, ext string, text string")
    got = {r["path"]: r["p"] for r in df.select("path", code.parsed(F.col("text"), F.col("ext")).alias("p")).collect()}
    assert len(got["a.py"]["definitions"]) == 3 and got["b.ts"]["calls"][0]["calls"] == [] or got["b.ts"]["calls"][0]["qname"] == "f"
    docs = df.where("path = 'a.py'").select(code.parsed(F.col("text"), F.col("ext"))["docs"].alias("d")).select(code.markdown_of(F.col("d")).alias("en"), code.markdown_of(F.col("d"), zh=True).alias("zh")).first()
    assert docs["en"].startswith("### `") and docs["zh"].startswith("### `")


def test_imports_are_resolved_to_files_that_exist(spark):
    imports = [("src/a.py", "helper", ".py"), ("src/x/a.py", ".util", ".py"), ("a.ts", "lib/b", ".ts"), ("a.py", "p.q", ".py"), ("a.py", "gone", ".py"), ("a.ts", "lib/*", ".ts"), ("src/x/a.py", ".", ".py")]
    files = ["src/helper.pyi", "src/helper/__init__.py", "src/helper/mod.rs", "src/x/util.py", "lib/b.tsx", "p/q.py"]
    got = code.resolve_imports(spark.createDataFrame(imports, "source string, target string, ext string"), spark.createDataFrame([(f,) for f in files], "file string"), ["src", "lib"])
    assert {tuple(r) for r in got.collect()} == {("src/a.py", "helper", "src/helper.pyi"), ("src/a.py", "helper", "src/helper/__init__.py"), ("src/x/a.py", ".util", "src/x/util.py"), ("a.ts", "lib/b", "lib/b.tsx")}
    assert code.source_dirs(spark.createDataFrame([("src/a",), ("lib",), ("",)], "path string")) == ["lib", "src"]
    assert code.source_dirs(spark.createDataFrame([], "path string")) == code.USUAL_DIRS


def test_diagrams(spark):
    text, n = diagrams.fix("flowchart TD\n  A[数据处理] -->|error handler| B[Done]")
    assert n >= 2 and 'A["数据处理"]' in text and '|"error handler"|' in text and "B[Done]" in text
    assert diagrams.fix("sequenceDiagram\nparticipant A as My App")[0].endswith('participant A as "My App"')
    assert 'class "List<int>" as List' in diagrams.fix('classDiagram\nclass "List~int~"')[0]
    assert diagrams.fix("stateDiagram\nA --> B") == ("stateDiagram\nA --> B", 0)
    assert "A_2[two words]" in diagrams.fix("graph LR\nA[one]\nA[two words]")[0].replace('"', "")
    doc = "# x\n```mermaid\nflowchart TD\nA[a b]\n```\ntext\n```mermaid\nerDiagram\n```\n"
    r = spark.createDataFrame([(doc,)], "t string").select(diagrams.repair(F.col("t")).alias("r"), diagrams.blocks(F.col("t"), F.lit("s")).alias("b")).first()
    assert (r["r"]["blocks"], r["r"]["fixes"]) == (2, 1) and 'A["a b"]' in r["r"]["text"] and [b["diagram_type"] for b in r["b"]] == ["flowchart", "erDiagram"]
    rows = [(doc, 1, "```mermaid\ngraph LR\nX\n```"), (doc, 0, "  graph LR\nY\n"), (doc, 7, "Z"), ("no diagram", 0, "Z")]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, i int, d string").select(diagrams.with_fix(F.col("t"), F.col("i"), F.col("d"))).collect()]
    assert got == [doc.replace("```mermaid\nerDiagram\n```", "```mermaid\ngraph LR\nX\n```"), doc.replace("```mermaid\nflowchart TD\nA[a b]\n```", "```mermaid\ngraph LR\nY\n```"), doc, "no diagram"]


FLOW = [
    ("A[Data Processing] --> B", 'A["Data Processing"] --> B', 1),
    ("A[Process] --> B", "A[Process] --> B", 0),
    ('A["Skill.run("message, context")"] --> B["init"]', "A[\"Skill.run('message, context')\"] --> B[\"init\"]", 1),
    ('A["fn("x", "y")"] --> B["plain"]', "A[\"fn('x', 'y')\"] --> B[\"plain\"]", 1),
    ("A -->|error handler| B", 'A -->|"error handler"| B', 1),
    ("api-gw[HTTP 请求] --> chat[POST /api/chat]", 'api-gw["HTTP 请求"] --> chat["POST /api/chat"]', 2),
    ("C --> WS[WS /ws/{id}]", 'C --> WS["WS /ws/{id}"]', 1),
    ("MW --> WS[/ws/chat]", 'MW --> WS["/ws/chat"]', 1),
    ("S(HTTP 请求) --> D{ok?} --> DB[(SQLite DB)]", 'S("HTTP 请求") --> D{"ok?"} --> DB[("SQLite DB")]', 3),
    ('A(["text x"]) --> B((round x))', 'A(["text x"]) --> B(("round x"))', 1),
    ("A[open", "A[open", 0),
    ("style E4 fill:#f9f,stroke:#333", "style E4 fill:#f9f,stroke:#333", 0),
    ("A[First] --> B\nA[Second] --> C\nA --> D", "A[First] --> B\nA_2[Second] --> C\nA_2 --> D", 1),
]
CLASSES = [
    ('class "Model~TApi~" {\n  +string id\n}\nModel~TApi~ : "tagged with"', 'class "Model<TApi>" as Model {\n  +string id\n}\nModel : "tagged with"', 2),
    ("  +Record~string,string~ headers", "  +Record<string, string> headers", 1),
    ("  -Map~string, Api~ registry", "  -Map<string, Api> registry", 1),
    ("  +result() Promise~Message~", "  +result() Promise<Message>", 1),
    ("  +process data()", '  +"process data"()', 1),
    ("  +process()\n  -helper()\n  +get() X[]", "  +process()\n  -helper()\n  +get() X[]", 0),
    ("A --|> B : extends it", 'A --|> B : "extends it"', 1),
    ("A --> B : manages", "A --> B : manages", 0),
    ("class My.Type {", 'class "My.Type" {', 1),
    ('class "Box~T~"\nBox~T~ --> B : holds', 'class "Box<T>" as Box\nBox --> B : holds', 2),
]


def test_repairs_by_input_and_output():
    for kind, cases in (("flowchart TD", FLOW), ("classDiagram", CLASSES)):
        for text, want, n in cases:
            assert diagrams.fix(f"{kind}\n{text}") == (f"{kind}\n{want}", n), text
            again = diagrams.fix(f"{kind}\n{want}")
            assert again == (f"{kind}\n{want}", 0), want
    assert diagrams.fix("sequenceDiagram\nA->>B:send request\nA->>B:hello\nactor P as My App") == ('sequenceDiagram\nA->>B:"send request"\nA->>B:hello\nactor P as "My App"', 2)
    assert diagrams.fix("sequenceDiagram\nA->>B:send request", thorough=False)[1] == 0
    assert diagrams.fix("erDiagram\nUSER ||--o{ ORDER : places\nMY-T.x {\n  string id\n}") == ("erDiagram\nUSER ||--o{ ORDER : places\nMY_T_x {\n  string id\n}", 1)
    assert diagrams.fix("pie title Languages\n\"Python\" : 40") == ('pie title Languages\n"Python" : 40', 0)


def test_excludes_of_a_configuration():
    assert tree.excludes("a: 1\nexclude:\n  - dist # built\n  - 'x y'\n  - '**/*.log'\n  -\nb:\n  - no\n") == (["dist", "x y"], ["/*.log"])
    assert tree.excludes("exclude: [a, 'b', \"*.c\"]\n") == (["a", "b"], [".c"])
    assert tree.excludes("") == ([], [])


def test_a_table_is_replaced_by_what_is_read_from_it(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace(spark.range(5), path)
    for n in (4, 3):
        sinks.replace(spark.read.parquet(path).where(f"id < {n}"), path)
        assert spark.read.parquet(path).count() == n
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_trees_are_written_and_read_back(spark, tmp_path):
    rows = [("a/b.py", "x"), ("c.md", None), (".h/d", "é")]
    assert sinks.tree(spark.createDataFrame(rows, "path string, text string"), str(tmp_path / "r")) == 3
    assert {(r["path"], r["text"]) for r in tree.read_tree(spark, str(tmp_path / "r")).collect()} == {("a/b.py", "x"), ("c.md", ""), (".h/d", "é")}
    assert sinks.tree(spark.createDataFrame([], "path string, text string"), str(tmp_path / "e")) == 0


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    part = lambda rows: spark.createDataFrame(rows, "k string, v int, part int")
    sinks.merge(part([("a", 1, 0), ("a", 2, 1), ("b", 3, 0)]), path, "k", "part")
    sinks.merge(part([("b", 9, 0)]), path, "k", "part")
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("a", 2), ("b", 9)}
    rows = spark.createDataFrame([("p:1", "x")], "page_id string, body string")
    assert sinks.state(rows, str(tmp_path / "s")) and not sinks.state(rows.limit(0), str(tmp_path / "s")) and not sinks.exists(spark, str(tmp_path / "s"))
    sinks.pages(rows, str(tmp_path / "pages"))
    assert (tmp_path / "pages" / "page=p_1").is_dir()
    menu = spark.createDataFrame([(0, "S", 0, "T", "t.md")], "section_pos int, section string, pos int, title string, path string")
    sinks.menu(menu, str(tmp_path / "m"), "P")
    assert spark.read.text(str(tmp_path / "m")).first()[0] == '{"title":"P","items":[{"title":"S","items":[{"title":"T","path":"t.md"}]}]}'


def test_incremental_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    source = lambda: spark.readStream.schema("path string, hash string").json(str(inbox))
    for rows in ('{"path":"a","hash":"1"}\n{"path":"b","hash":"1"}', '{"path":"a","hash":"2"}'):
        (inbox / f"{len(list(inbox.iterdir()))}.json").write_text(rows)
        incremental.follow(source(), str(tmp_path / "stored"), str(tmp_path / "changes"), str(tmp_path / "cp")).awaitTermination(60)
    got = {(r["batch"], r["path"], r["status"]) for r in spark.read.parquet(str(tmp_path / "changes")).collect()}
    assert got == {(0, "a", "added"), (0, "b", "added"), (1, "a", "modified"), (1, "b", "deleted")}
