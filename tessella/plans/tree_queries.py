"""Queries over file trees and sinks. Suppliers become files of a tree that is written below the scratch folder and
read back; results are written by the sinks and read again."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import rules as R
from tessella.functions import text as T
from tessella.functions.columns import glob_regex
from tessella.operators import diff, inventory, pages, quality, wiki
from tessella.plans import bind
from tessella.plans.oracle import INV, PLAN, VDOCS, VFILES, q
from tessella.plans.oracle import ORACLE_SQL as ORACLE
from tessella.scratch import materialise, scratch_root
from tessella.session import ship
from tessella.sources import lines, sinks, tree, versions

FOLDERS = ["src", "dist", "node_modules", "docs", "a/.git", "lib/build/c", "vendor/x", "pkg/env", "_x", ".hidden", "gen/tmp"]
FILES = ["main.py", "logo.png", "notes.md", "debug.log", "secret.key", "x.min.js", ".DS_Store", "yarn.lock", "font.ttf", "page.svg", "Data.CSV", "Photo.JPG", "README.txt"]
GITIGNORE = "# local\n*.log\n**/tmp\nsecret.key # why\n!keep.md\nlib/build/**\n"
CONFIG = "language: en\nexclude:\n  - dist # built\n  - 'db'\n  - \"*test_c?re*\"\n  - \n  - utils\nother:\n  - src\n"
#: Files of a project's top, the first ones of known names.
TOP = ["README.md", "README.zh.md", "CHANGELOG.md", "docs/a.md", "docs/b/c.md", "src/index.ts", "main.py", "cmd/main.go", "src/main/java/A.java", "package.json", "tsconfig.base.json", "yarn.lock", "pnpm-workspace.yaml", "x.sln", "lib/a.go", "agents.md", "go.mod", "next.config.mjs"]
TEMPLATE = "Analyse {{ MODULE }} ({{SIZE}} bytes) as {{ ROLE }}; {{ MODULE }} only."


def place(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def supplier_files(spark, sf) -> DataFrame:
    """(n, path, text): a file for each supplier."""
    n = F.col("s_suppkey")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    path = F.concat(pick(FOLDERS, n), F.lit("/d"), n.cast("string"), F.lit("/"), pick(FILES, F.floor(n / len(FOLDERS))))
    return bind.read(spark, sf, "supplier").where("s_suppkey IS NOT NULL").select(n.alias("n"), path.alias("path"), F.coalesce("s_name", F.lit("")).alias("text"))


def _tree(spark, sf) -> str:
    root = place(spark, "tree")
    rules = spark.createDataFrame([(".gitignore", GITIGNORE)], "path string, text string")
    sinks.tree(supplier_files(ship(spark), sf).select("path", "text").unionByName(rules), root)
    return root


def _listed(files: DataFrame) -> DataFrame:
    return files.select("path", "size", F.md5("text").alias("text_md5"))


def tree_scan(spark, sf):
    """SC1: the current rules; ignored folders and names and binary files are left out, hidden ones not."""
    return _listed(tree.read_tree(spark, _tree(spark, sf)))


def tree_scan_archived(spark, sf):
    """SC2, SC5, SC6, X34, H28: the archived rules and the tree's own rule file."""
    return _listed(tree.read_tree(spark, _tree(spark, sf), rules="archived", gitignore="true"))


def tree_folders(spark, sf):
    """SC3: folders of the tree that rules don't leave out."""
    return tree.read_tree(spark, _tree(spark, sf), folders="true", content="false").where("is_dir").select("path")


def incremental_scan(spark, sf):
    """SC4: code and documents alone, with hashes."""
    files = bind.vfiles(spark, sf)
    return diff.included(files, R.MORE_IGNORED_DIRS).select("path", F.substring(F.sha2("text", 256), 1, 16).alias("hash"))


def config_excludes(spark, sf):
    """SC7: what a configuration's YAML excludes, on top of the folders."""
    literals, globs = tree.excludes(CONFIG)
    return diff.included(bind.vfiles(spark, sf), [], literals, globs).select("path")


def versioned_json(spark, sf):
    """SC8, H1, H4, H7, H8, H19: a JSON document a nation, some broken, some of other versions; read tolerantly."""
    n = F.col("n_nationkey")
    good = F.to_json(F.struct((n % 3).alias("cache_schema_version"), F.struct(n.alias("key"), F.col("n_name").alias("name")).alias("nation")))
    files = bind.read(spark, sf, "nation").select(F.concat(F.lit("n"), n.cast("string"), F.lit(".json")).alias("path"), F.when(n % 5 == 4, "{broken").otherwise(good).alias("text"))
    root = place(spark, "json")
    sinks.tree(files, root)
    return tree.checked_json(ship(spark), root, "cache_schema_version int, nation struct<key:int,name:string>", 1).select("nation.key", "nation.name")


def markdown_corpus(spark, sf):
    """SC9, H10, SC12: the wiki's documents, found by the ladder of places, without the map of documents."""
    n = F.col("n")
    name = F.when(n % 7 == 0, "doc-map.md").when(n % 3 == 0, F.concat(F.lit("s"), n.cast("string"), F.lit(".txt"))).otherwise(F.concat(F.lit("s"), n.cast("string"), F.lit(".md")))
    files = supplier_files(ship(spark), sf).select(F.concat(F.lit(".tessella/wiki/f"), n.cast("string"), F.lit("/"), name).alias("path"), "text")
    root = place(spark, "wiki")
    sinks.tree(files, root)
    return wiki.documents(spark, root).where(~F.col("path").endswith("doc-map.md")).select("path", "text")


def top_files(spark, sf) -> DataFrame:
    """The inventory of a project: the top's files (one a part, each once) and a document a part."""
    n = F.col("p_partkey")
    both = F.array(F.element_at(F.array(*map(F.lit, TOP)), (n % len(TOP) + 1).cast("int")), F.concat(F.lit("docs/p"), n.cast("string"), F.lit(".md")))
    paths = bind.read(spark, sf, "part").where("p_partkey IS NOT NULL").select(F.explode(both).alias("path")).distinct()
    return inventory.with_facts(paths.select("path", F.lit(1).alias("size"), F.lit("").alias("text")))


def known_documents(spark, sf):
    """SC10: documents of known names, in the order of the patterns."""
    return inventory.known_documents(top_files(spark, sf))


def entry_probes(spark, sf):
    """The usual entry files and folders that exist."""
    return inventory.probed_entries(top_files(spark, sf))


def top_level_listing(spark, sf):
    """SC11: names at the top, folders and files."""
    return inventory.top_level(top_files(spark, sf))


def project_kinds(spark, sf):
    """Families by marks at the top; managers and monorepo tools by lock files."""
    inv = top_files(spark, sf)
    return inventory.project_types(inv).select(F.lit("type").alias("what"), F.col("project_type").alias("name")).unionByName(inventory.lockfile_managers(inv).select(F.lit("tool").alias("what"), F.col("tool").alias("name")))


#: By the remainder of a project's number: its manifest, its mark and the archetype that follows.
PROJECTS = [
    ("package.json", '{"react": 1, "vuepress": 2}', "next.config.js", "fullstack-framework"),
    ("requirements.txt", "torchaudio\nflask==2", "x/a.py", "web-service"),
    ("Cargo.toml", "[[bin]]", "src/main.rs", "cli-tool"),
    ("go.mod", "module x", "lib/a.go", "sdk-library"),
    ("package.json", '{"react": 1}', "server/a.js", "generic"),
    ("notes.txt", "torch", "x/b.py", "generic"),
    ("pyproject.toml", "x-torch", "agents/a.md", "agent-project"),
    ("requirements.txt", "torch==2", "cmd/a.py", "ml-project"),
    ("package.json", '{"vue": 1}', "x/c.vue", "spa-frontend"),
]


def project_archetypes(spark, sf):
    """Projects of five parts each, told apart by manifests, marks and whole names of dependencies, all in one pass."""
    project = F.floor(F.col("p_partkey") / 5)
    parts = bind.read(spark, sf, "part").where("p_partkey IS NOT NULL").select(project.alias("project"), F.concat(F.lit("x/"), F.col("p_partkey").cast("string"), F.lit(".txt")).alias("path"))
    at = lambda k: F.element_at(F.array(*(F.lit(p[k]) for p in PROJECTS)), (F.col("project") % len(PROJECTS) + 1).cast("int"))
    own = parts.select("project").distinct()
    files = parts.unionByName(own.select("project", F.explode(F.array(at(0), at(2))).alias("path")))
    return inventory.archetype(files, own.select("project", at(0).alias("path"), at(1).alias("text")), ["project"])


def replaced_table(spark, sf):
    """SK1, SK4, SK6, SK9, SK10, SK11: a table is written, then replaced by what is read from itself."""
    path, inv = place(spark, "table"), inventory.with_facts(bind.vfiles(spark, sf))
    sinks.replace(inv.select("path", "size", "category"), path)
    sinks.replace(spark.read.parquet(path).where("category <> 'code'").withColumn("size", F.col("size") + 1), path)
    return spark.read.parquet(path)


def merged_results(spark, sf):
    """SK5, SK13: parts are merged into a stored table, the last part of a key wins; then into it once more."""
    path, files = place(spark, "merged"), bind.vfiles(spark, sf).select("path", "size", "doc_id")
    part = lambda n, every: files.where(F.col("doc_id") % every == 0).select("path", (F.col("size") * 10 + n).alias("size"), F.lit(n).alias("part"))
    sinks.merge(part(1, 2).unionByName(part(2, 6)), path, "path", "part")
    sinks.merge(part(3, 3), path, "path", "part")
    return spark.read.parquet(path)


def versioned_merge(spark, sf):
    """SK1, SK4, SK5, SK6, SK13: a table in versions: written, merged into twice, once refused for having built on an old
    version; the last version and the first, side by side."""
    path, files = place(spark, "versions"), bind.vfiles(ship(spark), sf).select("path", "size", "doc_id")
    part = lambda n, every: files.where(F.col("doc_id") % every == 0).select("path", (F.col("size") * 10 + n).alias("size"), F.lit(n).alias("part"))
    versions.replace(files.where("doc_id % 4 <> 1").select("path", "size"), path, "path", rows_a_file=500)
    versions.merge(part(1, 5).unionByName(part(2, 10)), path, "part", rows_a_file=500)
    versions.merge(part(3, 7), path, "part", rows_a_file=500)
    try:
        versions.merge(part(4, 1), path, "part", base=2)
    except versions.Conflict:
        refused = True
    return versions.read(spark, path).withColumn("version", F.lit(3)).unionByName(versions.read(spark, path, 1).withColumn("version", F.lit(1))).withColumn("refused", F.lit(refused))


def page_files(spark, sf):
    """SK2, SK8: a JSON file a page under its safe name; pages that are gone from the plan lose theirs."""
    path, plan = place(spark, "pages"), bind.plan_pages(spark, sf).select(F.concat("page_id", F.lit(":a/b")).alias("page_id"), "pos", "title")
    sinks.pages(plan, path)
    sinks.pages(plan.where("pos % 3 <> 0"), path)
    return spark.read.schema("page_id string, pos bigint, title string, page string").option("basePath", path).json(path)


def menu_documents(spark, sf):
    """SK3: the menu as JSON and the map of documents as Markdown, written and read back."""
    menu = pages.menu_by_type(bind.plan_pages(spark, sf))
    a, b = place(spark, "menu"), place(spark, "map")
    sinks.menu(menu, a, "Project")
    sinks.text(pages.doc_map(menu, "Project"), b)
    read = lambda p, kind: spark.read.text(p, wholetext=True).select(F.lit(kind).alias("kind"), F.regexp_replace("value", r"\n\z", "").alias("text"))
    return read(a, "menu").unionByName(read(b, "map"))


def stale_contexts(spark, sf):
    """SK7: modules whose inputs' hash isn't that of what was written."""
    m = bind.vfiles(spark, sf).select(F.col("path").alias("module"), F.md5("text").alias("input_hash"), "doc_id")
    done = m.where("doc_id % 4 <> 0").select("module", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("input_hash")).alias("input_hash"))
    return diff.stale(m.select("module", "input_hash"), done)


def state_files(spark, sf):
    """SK12: faults by project are stored while there are some: after a first run, and after a second by which some are
    mended and others have come."""
    path = place(spark, "state")
    faults = bind.read(spark, sf, "supplier").where("s_suppkey IS NOT NULL").select(F.col("s_suppkey").alias("n"), F.concat(F.lit("p"), (F.col("s_suppkey") % 40).cast("string")).alias("project"), F.col("s_name").alias("fault"))
    seen = None
    for run, every in ((1, 4), (2, 6)):
        sinks.states(faults.where(F.col("n") % every == 0).select("project", "fault"), path, "project")
        stored = spark.read.schema("project string, fault string").option("basePath", path).json(path)
        found = materialise(stored.groupBy("project").agg(F.count(F.lit(1)).alias("faults")).withColumn("run", F.lit(run)), "state")
        seen = found if seen is None else seen.unionByName(found)
    return seen


def initial_layout(spark, sf):
    """SK14, H16: what a new wiki begins with, for each supplier, written and read back."""
    projects = bind.read(ship(spark), sf, "supplier").where("s_suppkey IS NOT NULL").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("/state")).alias("root"), F.coalesce("s_name", F.lit("")).alias("name"))
    root = place(spark, "layout")
    sinks.tree(wiki.initial_layouts(projects), root)
    return tree.read_tree(spark, root).select("path", "text")


def rendered_prompts(spark, sf):
    """SK15, X32, H14: a prompt for each file by a template; unknown marks stay. The manifest's rows give way
    to new prompts of the same file (the last of several) and stay where there is none."""
    m = bind.vfiles(spark, sf)
    prompt = T.render(F.lit(TEMPLATE), {"MODULE": F.col("path"), "SIZE": F.col("size").cast("string")})
    made = m.select("path", prompt.alias("prompt"), F.lit(1).alias("turn"), "doc_id")
    again = made.where("doc_id % 2 = 0").withColumn("prompt", F.concat("prompt", F.lit(" Again."))).withColumn("turn", F.lit(2))
    stored = made.where("doc_id % 3 = 0").select("path", F.concat(F.lit("Old "), "path").alias("prompt"), F.lit(0).alias("turn"))
    return diff.upsert(stored, made.where("doc_id % 5 <> 0").unionByName(again).drop("doc_id"), "path", "turn")


def package_check(spark, sf):
    """A package's own check over a required guide a supplier: missing files, front matter, phrases."""
    n = F.col("s_suppkey")
    guides = bind.read(spark, sf, "supplier").where("s_suppkey IS NOT NULL").select(n, F.concat(F.lit("docs/g"), n.cast("string"), F.lit(".md")).alias("path"), F.when(n % 4 == 0, "Reads Table.json daily").otherwise("plain").alias("text"))
    return quality.self_check(guides.where(n % 3 != 0).select("path", "text"), guides.select("path"), "docs/g1.md", "tool", ["reads table.json", "input: table.json"])


def check_report(spark, sf):
    """Documents in all, failed and passed, by the current rules' issues."""
    docs = bind.vdocs(spark, sf)
    bad = quality.current(docs).where(F.size("issues") > 0).select(F.col("path").alias("item"))
    return quality.check_report(bad, docs.select(F.col("path").alias("item")))


def ranged_lines(spark, sf):
    """SC14, E25, X29, J28: lines of files by number, each read by its range of bytes through a sparse index of line offsets."""
    docs = bind.vdocs(ship(spark), sf)
    root, n = place(spark, "sources"), F.col("conv_id")
    sinks.tree(docs.select("path", "text"), root)
    marks = materialise(lines.index(tree.read_tree(spark, root), every=8), "marks")
    wanted = docs.select("path", (n % 40 * 3 + 1).alias("first"), (n % 40 * 3 + 1 + n % 5 * 4).alias("last"))
    return lines.ranges(wanted, marks, root, every=8).select("path", "number", F.md5("text").alias("text_md5"))


#: Many rules of every form: names of folders, whole names, beginnings, ends and others.
MANY = [f"gone{i}" for i in range(60)] + ["docs", "utils"], [f"*.x{i}" for i in range(60)] + ["*.lock", "test_*", "user?service.[gp]*", "READ*.md", "index.ts"]


def many_rules(spark, sf):
    """SC5, SC6, SC7, X34: files that none of 127 ignore rules leaves out; names, beginnings and ends are looked up in sets."""
    return diff.included(bind.vfiles(spark, sf), [], *MANY).select("path")


QUERIES = {
    f.__name__: f
    for f in (versioned_merge, ranged_lines, many_rules, tree_scan, tree_scan_archived, tree_folders, incremental_scan, config_excludes, versioned_json, markdown_corpus, known_documents, entry_probes, top_level_listing, project_kinds, project_archetypes, replaced_table, merged_results, page_files, menu_documents, stale_contexts, state_files, initial_layout, rendered_prompts, package_check, check_report)
}

SUPPLIED = f"""f AS (
  SELECT s_suppkey AS n, list_extract([{q(FOLDERS)}], (s_suppkey % {len(FOLDERS)} + 1)::INT) || '/d' || s_suppkey || '/' || list_extract([{q(FILES)}], (s_suppkey // {len(FOLDERS)} % {len(FILES)} + 1)::INT) AS path, coalesce(s_name, '') AS text
  FROM supplier WHERE s_suppkey IS NOT NULL),
r AS (SELECT path, text, string_split(path, '/') AS parts, lower(path) AS low FROM f UNION ALL SELECT '.gitignore', E'{GITIGNORE.replace(chr(10), chr(92) + "n")}', ['.gitignore'], '.gitignore')"""
LISTED = "path, octet_length(encode(text))::BIGINT AS size, md5(text) AS text_md5"


def ends(column: str, suffixes: list[str]) -> str:
    return "(" + " OR ".join(f"ends_with({column}, '{x}')" for x in suffixes) + ")"


#: Paths of top_files.
TOPS = f"""t AS (SELECT DISTINCT unnest([list_extract([{q(TOP)}], (p_partkey % {len(TOP)} + 1)::INT), 'docs/p' || p_partkey || '.md']) AS path FROM part WHERE p_partkey IS NOT NULL)"""
KNOWN = [(i, "^" + "[^/]*".join(map(re.escape, g.split("*"))) + "$") for i, g in enumerate(R.KNOWN_DOCS)]

ORACLE_SQL = {
    "tree_scan": f"WITH {SUPPLIED} SELECT {LISTED} FROM r WHERE NOT list_has_any(parts, [{q([*R.IGNORED_DIRS, *R.IGNORED_FILES])}]) AND NOT {ends('low', R.BINARY_SUFFIXES)}",
    "tree_scan_archived": f"""WITH {SUPPLIED} SELECT {LISTED} FROM r WHERE NOT list_has_any(parts, [{q([*R.MORE_IGNORED_DIRS, *R.MORE_IGNORED_FILES, "tmp", "secret.key", "lib/build"])}])
        AND NOT {ends("low", R.MORE_BINARY_SUFFIXES)} AND len(list_filter(parts, lambda x: ends_with(x, '.log'))) = 0""",
    "tree_folders": f"""WITH {SUPPLIED}, c AS (SELECT unnest(list_transform(range(1, len(parts)), lambda k: array_to_string(parts[1:k], '/'))) AS path FROM r)
        SELECT DISTINCT path FROM c WHERE NOT list_has_any(string_split(path, '/'), [{q([*R.IGNORED_DIRS, *R.IGNORED_FILES])}])""",
    "incremental_scan": f"""WITH {VFILES} SELECT path, substr(sha256(text), 1, 16) AS hash FROM vfiles WHERE NOT list_has_any(string_split(path, '/'), [{q(R.MORE_IGNORED_DIRS)}]) AND extension IN ({q([*R.CODE_SUFFIXES, *R.TEXT_DOC_SUFFIXES])})""",
    "config_excludes": f"""WITH {VFILES} SELECT path FROM vfiles WHERE NOT list_has_any(string_split(path, '/'), ['dist', 'db', 'utils']) AND NOT regexp_matches(name, '^test_c.re') AND extension IN ({q([*R.CODE_SUFFIXES, *R.TEXT_DOC_SUFFIXES])})""",
    "versioned_merge": f"""WITH {VFILES} SELECT path, CASE WHEN doc_id % 7 = 0 THEN size * 10 + 3 WHEN doc_id % 10 = 0 THEN size * 10 + 2 WHEN doc_id % 5 = 0 THEN size * 10 + 1 ELSE size END AS size, 3 AS version, true AS refused FROM vfiles WHERE doc_id % 4 <> 1 OR doc_id % 5 = 0 OR doc_id % 7 = 0
        UNION ALL SELECT path, size, 1, true FROM vfiles WHERE doc_id % 4 <> 1""",
    "ranged_lines": f"""WITH {VDOCS}, l AS (SELECT conv_id, path, string_split(regexp_replace(text, E'\\n$', ''), E'\\n') AS l, (conv_id % 40 * 3 + 1) AS a, (conv_id % 40 * 3 + 1 + conv_id % 5 * 4) AS b FROM vdocs),
        r AS (SELECT path, l, unnest(range(a, least(b, len(l)) + 1)) AS number FROM l) SELECT path, number::BIGINT AS number, md5(l[number]) AS text_md5 FROM r""",
    "many_rules": f"""WITH {VFILES} SELECT path FROM vfiles WHERE NOT list_has_any(string_split(path, '/'), ['docs', 'utils']) AND NOT starts_with(name, 'test_') AND NOT regexp_matches(name, '^user.service\\.[gp].*$') AND NOT regexp_matches(name, '^READ.*\\.md$') AND name <> 'index.ts'
        AND extension IN ({q([*R.CODE_SUFFIXES, *R.TEXT_DOC_SUFFIXES])}) AND extension <> '.lock'""",
    "versioned_json": "SELECT n_nationkey AS key, n_name AS name FROM nation WHERE n_nationkey % 5 <> 4 AND n_nationkey % 3 = 1",
    "markdown_corpus": f"WITH {SUPPLIED} SELECT 'f' || n || '/s' || n || '.md' AS path, text FROM f WHERE n % 7 <> 0 AND n % 3 <> 0",
    "known_documents": f"WITH {TOPS}, p(place, regex) AS (VALUES {', '.join(f'''({i}, '{x}')''' for i, x in KNOWN)}) SELECT path, place::INT AS place FROM t JOIN p ON regexp_matches(path, regex)",
    "entry_probes": f"""WITH {TOPS}, p(place, probe) AS (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(R.PROBED_ENTRIES))}) SELECT DISTINCT probe AS path, place::INT AS place FROM t JOIN p ON path = probe OR (starts_with(path, probe || '/') AND NOT contains(regexp_extract(probe, '[^/]*$'), '.'))""",
    "top_level_listing": f"WITH {TOPS} SELECT DISTINCT split_part(path, '/', 1) AS name, contains(path, '/') AS is_dir FROM t",
    "project_kinds": f"""WITH {TOPS}, m(what, name, regex) AS (VALUES {", ".join(f"('type', '{k}', '{glob_regex(g)}')" for k, globs in R.PROJECT_MARKS for g in globs)}, {", ".join(f"('tool', '{k}', '^{re.escape(f)}$')" for k, f in [*R.LOCKFILE_MANAGERS, *R.MONOREPO_TOOLS])})
        SELECT DISTINCT what, name FROM t JOIN m ON regexp_matches(path, regex) WHERE NOT contains(path, '/')""",
    "project_archetypes": f"""SELECT DISTINCT p_partkey // 5 AS project, list_extract([{q([p[3] for p in PROJECTS])}], (p_partkey // 5 % {len(PROJECTS)} + 1)::INT) AS archetype FROM part WHERE p_partkey IS NOT NULL""",
    "replaced_table": f"WITH {INV} SELECT path, size + 1 AS size, category FROM inv WHERE category <> 'code'",
    "merged_results": f"""WITH {VFILES} SELECT path, size * 10 + CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 1 END AS size FROM vfiles WHERE doc_id % 2 = 0 OR doc_id % 3 = 0""",
    "page_files": f"""WITH {PLAN} SELECT page_id || ':a/b' AS page_id, pos, title, page_id || '_a_b' AS page FROM plan WHERE pos % 3 <> 0""",
    "menu_documents": f"""WITH {PLAN}, s AS (SELECT section, min(pos) AS first, string_agg('{{"title":"' || shown || '","path":"' || output_path || '"}}', ',' ORDER BY pos) AS items, string_agg('- [' || shown || '](' || output_path || ')', E'\\n' ORDER BY pos) AS lines FROM labelled GROUP BY section)
        SELECT 'menu' AS kind, '{{"title":"Project","items":[' || string_agg('{{"title":"' || section || '","items":[' || items || ']}}', ',' ORDER BY first) || ']}}' AS text FROM s
        UNION ALL SELECT 'map', E'# Project Documentation Map\\n\\n' || string_agg('## ' || section || E'\\n\\n' || lines || E'\\n', E'\\n' ORDER BY first) FROM s""",
    "stale_contexts": f"WITH {VFILES} SELECT path AS module, md5(text) AS input_hash FROM vfiles WHERE doc_id % 4 = 0 OR doc_id % 5 = 0",
    "state_files": """SELECT 'p' || s_suppkey % 40 AS project, count(*) AS faults, run::INT AS run FROM supplier JOIN (VALUES (1, 4), (2, 6)) v(run, every) ON s_suppkey % every = 0 GROUP BY ALL""",
    "initial_layout": r"""SELECT 's' || s_suppkey || '/state/' || p AS path, CASE p WHEN 'config.yaml' THEN E'exclude: []\nlanguage: zh\n' WHEN 'meta.json' THEN '{"project_name":"' || s_name || '","cache_schema_version":1}' ELSE '# ' || s_name || chr(10) END AS text
        FROM supplier CROSS JOIN (VALUES ('config.yaml'), ('meta.json'), ('wiki/overview.md')) v(p)""",
    "rendered_prompts": f"""WITH {VFILES}, p AS (SELECT path, doc_id, 'Analyse ' || path || ' (' || size || ' bytes) as {{{{ ROLE }}}}; ' || path || ' only.' AS prompt FROM vfiles)
        SELECT path, CASE WHEN doc_id % 2 = 0 THEN prompt || ' Again.' WHEN doc_id % 5 <> 0 THEN prompt ELSE 'Old ' || path END AS prompt, CASE WHEN doc_id % 2 = 0 THEN 2 WHEN doc_id % 5 <> 0 THEN 1 ELSE 0 END::INT AS turn
        FROM p WHERE doc_id % 2 = 0 OR doc_id % 5 <> 0 OR doc_id % 3 = 0""",
    "package_check": """SELECT 'missing required file: docs/g' || s_suppkey || '.md' AS message FROM supplier WHERE s_suppkey % 3 = 0
        UNION ALL SELECT 'docs/g' || s_suppkey || '.md declares legacy dependency: reads table.json' FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 4 = 0
        UNION ALL SELECT 'docs/g1.md missing ' || unnest(['YAML frontmatter', 'name: tool', 'description']) FROM supplier WHERE s_suppkey = 1""",
    "check_report": f"WITH c AS ({ORACLE['doc_quality_current']}) SELECT count(*) AS total, count(*) FILTER (issues <> '') AS failed, count(*) FILTER (issues = '') AS passed FROM c",
}
