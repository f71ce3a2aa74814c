"""Queries over the wiki's operators that the other modules don't register: names, places, menus, module discovery,
evidence, diagrams. The bindings' faults are planted by number, so that SQL can say what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import classify as C
from tessella.functions import diagrams
from tessella.functions import rules as R
from tessella.functions import text as T
from tessella.functions.columns import base_name, flat_id, module_slug, safe_id, stem
from tessella.operators import graph, pages, quality, trees, wiki
from tessella.plans import bind
from tessella.plans.oracle import ADJ, PLAN, VDOCS, VFILES, q
from tessella.plans.oracle import ORACLE_SQL as ORACLE
from tessella.session import ship


def pick(values: list[str], k) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def safe_names(spark, sf):
    """Safe and flat ids and module slugs of odd names."""
    n = F.col("p_partkey")
    name = F.concat(pick([" a:b/", "/x.y\\", "__q/", "数据 "], n), n.cast("string"), pick(["", "/", " ?!", ".md_"], n))
    return bind.read(spark, sf, "part").select("p_partkey", safe_id(name).alias("safe"), flat_id(name).alias("flat"), module_slug(name).alias("slug"))


def doc_names(spark, sf):
    """A document's type, page id and title; some have no H1."""
    docs = bind.vdocs(spark, sf)
    n = F.col("conv_id")
    path = F.when(n % 11 == 0, "overview.md").when(n % 7 == 0, F.concat(F.lit("other/my-page_"), n.cast("string"), F.lit(".md"))).otherwise(F.col("path"))
    text = F.when(n % 4 == 1, F.regexp_replace("text", r"\A# ", "")).otherwise(F.col("text"))
    return docs.select("conv_id", C.doc_type(path).alias("type"), C.page_id_of(path).alias("page_id"), T.title_of(text, stem(base_name(path))).alias("title"))


def missing_pages(spark, sf):
    """Planned pages whose file isn't there, but for skipped ones."""
    p = bind.plan_pages(spark, sf)
    return quality.missing_pages(p, p.where("pos % 4 <> 0").select(F.col("output_path").alias("file")))


def final_check(spark, sf):
    """All checks of a finished wiki in one table, counted by kind."""
    docs = bind.vdocs(spark, sf)
    p = bind.plan_pages(spark, sf)
    found = quality.finalise(p, docs.select(F.col("path").alias("file")).unionByName(p.where("pos % 4 <> 0").select(F.col("output_path").alias("file"))), docs)
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("issues"))


def severities(spark, sf):
    """Issues by severity; passed without errors."""
    n = F.col("doc_id")
    return quality.severity(bind.vfiles(spark, sf).select(F.when(n % 6 == 0, "error").when(n % 6 < 3, "warning").otherwise("info").alias("severity")))


def page_by_id(spark, sf):
    """Every planned page looked up by its id; of equal ids the last."""
    p = bind.plan_pages(spark, sf)
    return p.select("page_id").distinct().join(pages.page_map(p), "page_id")


STEMS = ["server", "worker", "Loader", "cli", "gone"]


def entry_handlers(spark, sf):
    """An entry file's handler: a function of its name, else a known name that contains it and calls something."""
    n = F.col("s_suppkey")
    rows = bind.read(spark, sf, "supplier").where("s_suppkey IS NOT NULL")
    entries = rows.select(F.concat(F.lit("src/d"), n.cast("string"), F.lit("/"), pick(STEMS, n), F.when(n % 2 == 0, n.cast("string")).otherwise(""), F.lit(".py")).alias("name"))
    calls = rows.select(F.explode(F.array(
        F.struct(F.concat(F.lit("run_"), F.upper(pick(STEMS[:3], n)), F.lit("_z")).alias("qname"), F.array(F.lit("x")).alias("calls")),
        F.struct(F.lit("cli").alias("qname"), F.array().cast("array<string>").alias("calls")),
    )).alias("c")).select("c.*").dropDuplicates(["qname"])
    return graph.entry_handlers(entries, calls)


def link_forms(spark, sf):
    """Links to sources in every form: path, lines, whether the range is valid and the link external."""
    n, p = F.col("doc_id"), F.col("path")
    href = F.when(n % 5 == 0, F.concat(F.lit("file:///"), p, F.lit("#L"), n.cast("string"), F.lit("-L"), (n + 2).cast("string"))).when(n % 5 == 1, F.concat(p, F.lit("#L"), n.cast("string"))).when(n % 5 == 2, F.concat(F.lit("/api?path=x&start="), (n + 9).cast("string"), F.lit("&end="), n.cast("string"))).when(n % 5 == 3, F.concat(F.lit("HTTPS://h/"), n.cast("string"))).otherwise(F.concat(F.lit("mailto:a"), n.cast("string")))
    r = bind.vfiles(spark, sf).select("doc_id", href.alias("href")).withColumn("r", T.parse_reference(F.col("href")))
    return r.select("doc_id", "r.path", "r.start", "r.end", C.valid_range(F.col("r.start"), F.col("r.end")).alias("valid"), C.external_link(F.col("href")).alias("external"))


def resolved_sources(spark, sf):
    """SC15, H3: references to files, absolute, relative, as file addresses and encoded, resolved to files that exist."""
    files = bind.vfiles(spark, sf)
    n, p = F.col("doc_id"), F.col("path")
    reference = F.when(n % 5 == 0, F.concat(F.lit("file:///work/repo/"), p)).when(n % 5 == 1, F.concat(F.lit("/work/repo/./"), p)).when(n % 5 == 2, F.concat(F.lit("x/../"), p)).when(n % 5 == 3, F.replace(p, F.lit("/"), F.lit("%2F"))).otherwise(F.concat(p, F.lit(".gone")))
    return wiki.resolve_sources(files.select(reference.alias("reference")), files.select(F.col("path").alias("file")), "/work/repo")


def cached_parses(spark, sf):
    """SC16: what a cache holds for the files, and which files are left to parse."""
    files = bind.vfiles(spark, sf).select("path", "doc_id")
    known, rest = wiki.cached_or_parsed(files, files.where("doc_id % 3 = 0").select("path", F.lit("cached").alias("result")))
    return known.select("path", "result").unionByName(rest.select("path", F.lit("to parse").alias("result")))


def file_metadata(spark, sf):
    """A file's data over three tables, the first that has it counts."""
    f = bind.vfiles(spark, sf)
    part = lambda name, k: f.where(F.col("doc_id") % k == 0).select("path", F.lit(name).alias("found_in"), (F.col("size") + k).alias("size"))
    return wiki.file_data([part("core", 3), part("entry", 2), part("all", 1)])


def source_folders(spark, sf):
    """Modules below a folder; folders split while two children or more have code."""
    return graph.split_modules(_project(spark, sf), "src")


def container_modules(spark, sf):
    """An application folder as its entry files and the modules of its subfolders."""
    return graph.expand_container(_project(spark, sf), "src")


def _project(spark, sf) -> DataFrame:
    """(path, extension): a file a part, three folders deep; every sixth beside the others' folders, every tenth no code."""
    n = F.col("p_partkey")
    s = n.cast("string")
    name = F.when(n % 90 == 0, "main.py").otherwise(F.concat(F.lit("p"), s, F.when(n % 10 == 0, ".txt").otherwise(".py")))
    folder = F.when(n % 90 == 0, "src").when(n % 6 == 1, F.concat(F.lit("src/api_"), (n % 7).cast("string"))).otherwise(F.concat(F.lit("src/api_"), (n % 7).cast("string"), F.lit("/k"), (n % 3).cast("string")))
    path = F.concat(folder, F.lit("/"), name)
    parts = bind.read(spark, sf, "part").where("p_partkey IS NOT NULL").select(path.alias("path")).distinct()
    return parts.select("path", F.regexp_extract("path", r"(\.[a-z]+)$", 1).alias("extension"))


def workspace_packages(spark, sf):
    """SC13: workspace folders that manifests state, where they exist; else the usual ones."""
    n = F.col("p_partkey")
    files = bind.read(spark, sf, "part").where("p_partkey IS NOT NULL").select(F.concat(pick(["packages/a", "apps/b", "tools/c", "src"], n), F.lit("/f"), n.cast("string"), F.lit(".ts")).alias("path"))
    manifests = spark.createDataFrame([("package.json", '{"workspaces": {"packages": ["tools/*", "gone/*"]}}'), ("pnpm-workspace.yaml", "packages:\n  - 'packages/*'\n  - docs\n")], "path string, text string")
    return wiki.workspaces(manifests, files)


def page_modules(spark, sf):
    """A page's module by the plan, its document path, its name, or the module's name."""
    n = F.col("doc_id")
    f = bind.vfiles(spark, sf).select("doc_id", F.concat(F.lit("wiki/deep-dive/Mod-"), n.cast("string"), F.lit(".md")).alias("page"))
    s = n.cast("string")
    keys = f.select(F.concat(F.lit("mod_"), s).alias("module"), F.when(n % 4 == 1, F.concat(F.lit("deep-dive/Mod-"), s, F.lit(".md"))).when(n % 4 == 2, F.concat(F.lit("x/mod_"), s, F.lit(".md"))).alias("doc_path"), n.alias("pos")).where("pos % 5 <> 0")
    return quality.wiki_key(f.select("page"), keys, f.where("doc_id % 4 = 0").select("page", F.concat(F.lit("plan"), s).alias("module")))


def module_insights(spark, sf):
    """Each module's distinct insights in order, the first ten; core files have two, one of them shared."""
    n = F.col("p_partkey")
    files = bind.read(spark, sf, "part").where("p_partkey IS NOT NULL").select(F.col("p_brand").alias("module"), n.alias("pos"), F.array(F.concat(F.lit("i"), (n % 9).cast("string")), F.concat(F.lit("j"), (n % 4).cast("string"))).alias("insights"))
    return pages.insights(files).select("module", F.array_join("insights", ",").alias("insights"))


def page_composer(spark, sf):
    """A page's place in the menu, its module and its number of lines, with faults as messages."""
    docs = bind.vdocs(spark, sf)
    n = F.col("conv_id")
    menu = docs.where(n % 5 != 0).select(F.split("path", "/")[0].alias("section"), "path")
    modules = docs.where(n % 3 != 0).select("path", F.concat(F.lit("m"), n.cast("string")).alias("module"))
    met = docs.select("path", T.line_count(F.col("text")).alias("lines")).join(menu, "path", "left").join(modules, "path", "left")
    errors = quality.messages((F.col("section").isNull(), "not in the menu"), (F.col("module").isNull(), "no module"))
    return met.select("path", "lines", "section", "module", F.array_join(errors, "; ").alias("errors"))


def menu_from_topology(spark, sf):
    """Groupings of two and three levels joined with their pages, and how many pages each has."""
    p = bind.plan_pages(spark, sf)
    known = pages.page_map(p).select(F.col("page_id").alias("id"), "title", F.concat(F.lit("wiki/"), "path").alias("output_path"))
    n = F.col("pos")
    groupings = p.select((n % 3).alias("section_pos"), F.concat(F.lit("S"), (n % 3).cast("string")).alias("section"), F.when(n % 3 == 0, F.concat(F.lit("G"), (n % 2).cast("string"))).alias("group"), "pos", F.when(n % 7 == 0, "none").otherwise(F.col("page_id")).alias("page_id"))
    made = wiki.menu_from_topology(groupings, known)
    counts = made.groupBy(F.col("section").alias("s"), F.col("group").alias("g")).agg(F.count(F.lit(1)).alias("pages"))
    return made.join(counts, F.col("section").eqNullSafe(F.col("s")) & F.col("group").eqNullSafe(F.col("g"))).select("section", "group", "pos", "title", "path", "pages")


def menu_from_folders(spark, sf):
    """The menu from the documents' folders: overview, folders of knowledge, and the rest by group."""
    return wiki.menu_from_folders(_wiki_docs(spark, sf), "en")


def _wiki_docs(spark, sf) -> DataFrame:
    docs, n = bind.vdocs(spark, sf), F.col("conv_id")
    extra = spark.createDataFrame([("overview.md", "# Start"), ("doc-map.md", "no heading"), ("changelog.md", "x"), ("concepts/index.md", "# I"), ("assets/a.md", "# A"), ("_x/b.md", "# B")], "path string, text string")
    own = F.when(n % 4 == 0, F.concat(F.lit("guides/g"), n.cast("string"), F.lit(".md"))).otherwise(F.col("path"))
    return docs.select(own.alias("path"), F.when(n % 3 == 0, F.regexp_replace("text", r"\A# ", "")).otherwise(F.col("text")).alias("text")).unionByName(extra)


def nested_menu(spark, sf):
    """The menu as a tree of sections, groups and pages, walked to flat rows with their depth."""
    flat = wiki.menu_from_folders(_wiki_docs(spark, sf), "en")
    return wiki.walk(wiki.nest(flat))


def menu_reconciled(spark, sf):
    """A menu brought in line with the documents: gone pages, new titles, unlisted pages, double paths."""
    p = bind.plan_pages(spark, sf)
    n = F.col("pos")
    menu = p.select(pick(["A", "B"], n).alias("section"), "pos", "title", "output_path").select("section", "pos", "title", F.col("output_path").alias("path"))
    files = p.where(n % 5 != 0).select(F.col("output_path").alias("file"), F.when(n % 2 == 0, F.concat(F.lit("New "), n.cast("string"))).alias("title"))
    rest = p.select(F.concat(F.lit("more/"), n.cast("string"), F.lit(".md")).alias("file"), F.lit("More").alias("title")).where(n % 9 == 0)
    return pages.reconcile(menu, files.unionByName(rest), "Rest").select("section", "title", "path")


def package_groups(spark, sf):
    """Module pages by package; the menu is nested if any group has several."""
    m = bind.read(spark, sf, "part").where("p_partkey IS NOT NULL").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("name"), F.concat(F.lit("packages/pkg"), (F.col("p_partkey") % 7).cast("string"), F.lit("/src/x"), F.col("p_partkey").cast("string")).alias("path"), F.lit("Service").alias("code_purpose"), F.lit(None).cast("string").alias("semantic_group"))
    g = pages.package_groups(pages.topology(m))
    return g.select("group", "n", "nested", F.md5("pages").alias("pages_md5"))


def cross_cluster_edges(spark, sf):
    """Distinct dependencies between groups of modules: by the last letter of their names."""
    e, m = bind.edges(spark, sf), bind.members(spark, sf)
    groups = m.select("module", F.substring("module", -1, 1).alias("group")).distinct()
    return graph.cross_groups(graph.module_edges(e, m).select("src_module", "dst_module").distinct(), groups)


def listing_tree(spark, sf):
    """The listing of a tree to a depth: folders with how many files they hold."""
    return wiki.folder_tree(bind.vfiles(spark, sf).select("path"), 6)


def reconciled_edges(spark, sf):
    """Parsed and hinted edges between modules: confirmed, in conflict, parsed only, hinted only."""
    e = graph.module_edges(bind.edges(spark, sf), bind.members(spark, sf)).select(F.col("src_module").alias("src"), F.col("dst_module").alias("dst")).distinct()
    h = F.conv(F.substring(F.md5(F.concat("src", "dst")), 1, 1), 16, 10).cast("int") % 4
    one_way = e.where("src < dst")
    hinted = one_way.where(h == 0).unionByName(one_way.where(h == 1).select(F.col("dst").alias("src"), F.col("src").alias("dst"))).unionByName(one_way.where(h == 2).select("src", F.concat("dst", F.lit("?")).alias("dst")))
    return wiki.reconcile_dependencies(one_way, hinted)


def component_rules(spark, sf):
    """The components that each planned page's type requires and recommends."""
    p = wiki.components_of(bind.plan_pages(spark, sf).select("pos", "page_type"))
    return p.select("pos", F.array_join("required", ",").alias("required"), F.array_join("recommended", ",").alias("recommended"))


def evidence_ranges(spark, sf):
    """Ranges of a file from its core ranges and its interfaces, with labels and reasons filled in."""
    n = F.col("doc_id")
    some = lambda c: F.when(n % 3 == 0, c).otherwise(F.lit(""))
    core = F.array(F.struct(n.alias("start_line"), F.when(n % 2 == 0, n + 5).alias("end_line"), some(F.lit("Label")).alias("label"), F.lit("Name").alias("name"), F.lit("").alias("reason"), some(F.lit("Sum")).alias("summary")), F.struct(F.lit(0).cast("bigint").alias("start_line"), F.lit(None).cast("bigint").alias("end_line"), F.lit("x").alias("label"), F.lit("x").alias("name"), F.lit("x").alias("reason"), F.lit("x").alias("summary")))
    interfaces = F.array(F.struct((n + 7).alias("line"), F.lit(None).cast("bigint").alias("end_line"), some(F.lit("f")).alias("name")))
    return bind.vfiles(spark, sf).select("doc_id", F.inline(pages.source_ranges(core, interfaces)))


def signature_depths(spark, sf):
    """Exported names, and definitions cut to the depth of analysis."""
    n = F.col("doc_id")
    d = lambda name, line, parent, doc: F.struct(F.lit(name).alias("name"), F.lit("function").alias("kind"), F.lit(line).alias("line"), F.lit(line + 3).alias("end_line"), F.lit(parent).alias("parent"), F.lit(doc).alias("doc"))
    definitions = F.array(d("a", 1, "", "says"), d("b", 5, "", ""), d("m", 7, "C", "x"))
    lines = F.when(n % 3 == 0, F.array(F.lit(5))).otherwise(F.array(F.lit(99)))
    cut = F.transform(pages.signatures(definitions, pick(["deep", "standard", "quick"], n)), lambda x: F.concat_ws(":", x["name"], x["kind"], x["doc"]))
    return bind.vfiles(spark, sf).select("doc_id", F.array_join(pages.exports(definitions, lines), ",").alias("exported"), F.array_join(cut, ";").alias("cut"))


def key_filters(spark, sf):
    """Maps without some keys, and with some keys alone."""
    m = F.create_map(F.lit("path"), F.col("path"), F.lit("size"), F.col("size").cast("string"), F.lit("hash"), F.md5("text"))
    flat = lambda x: F.array_join(F.transform(F.array_sort(F.map_entries(x)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return bind.vfiles(spark, sf).select("doc_id", flat(wiki.without_keys(m, ["hash", "none"])).alias("without"), flat(wiki.only_keys(m, ["size", "none"])).alias("alone"))


def file_modules(spark, sf):
    """The module of a file that several list: the last one."""
    f = bind.vfiles(spark, sf)
    own = F.floor(F.col("doc_id") / 50)
    m = f.select(F.concat(F.lit("m"), own.cast("string")).alias("module"), own.alias("pos"), "path").groupBy("module", "pos").agg(F.collect_list("path").alias("files"))
    late = f.where("doc_id % 10 = 3").select(F.lit("late").alias("module"), F.lit(1 << 60).alias("pos"), F.array("path").alias("files"))
    return pages.file_to_module(m.unionByName(late))


def gated_evidence(spark, sf):
    """Q8: evidence is built from analyses without gaps alone."""
    n = F.col("doc_id")
    m = bind.vfiles(spark, sf).select(F.col("path").alias("module"), F.when(n % 4 == 0, "").otherwise("sum").alias("module_summary"), F.lit("role").alias("module_role"), F.array(F.lit("f")).alias("evidence_files"))
    gaps = pages.missing_fields(m, ["module_summary", "module_role"], "module")
    return pages.claims(m.join(gaps, "module", "left_anti")).select("claim_id", "claim_text", "confidence")


def front_pages(spark, sf):
    """The front matter of a document, and its links to local targets."""
    n = F.col("conv_id")
    text = F.concat(F.lit("---\ntitle: T "), n.cast("string"), F.lit("\nkind : note: x\n- no\n---\n[a](#x) [b](https://h) [c](mailto:m) [d]({{v}}) [e](p/"), n.cast("string"), F.lit(".md)"), F.when(n % 2 == 0, "[f](q.md#s)").otherwise(""))
    d = bind.vdocs(spark, sf).select("conv_id", text.alias("t"))
    m = wiki.front_matter(F.col("t"))
    return d.select("conv_id", m["title"].alias("title"), m["kind"].alias("kind"), F.array_join(wiki.local_links(F.col("t")), ",").alias("links"))


def diagram_blocks(spark, sf):
    """Every diagram of every document with its id and kind."""
    d = bind.vdocs(spark, sf).select("path", F.inline(diagrams.blocks(F.col("text"), stem(base_name(F.col("path"))))))
    return d.select("path", "block_id", "diagram_type", F.md5("text").alias("text_md5"))


def diagram_errors(spark, sf):
    """Lines that a validator's message names, and the diagram with its lines' numbers."""
    n = F.col("conv_id")
    message = F.concat(F.lit("Parse error on Line "), n.cast("string"), F.lit(": x, line:"), (n + 1).cast("string"))
    d = bind.vdocs(spark, sf).select("conv_id", F.array_join(diagrams.error_lines(message).cast("array<string>"), ",").alias("lines"), diagrams.numbered(F.concat(F.lit("graph TD\nA"), n.cast("string"), F.lit("\nB"))).alias("numbered"))
    return d


def diagram_fixes(spark, sf):
    """A repaired diagram is put in the place that its block's id names."""
    docs = bind.vdocs(ship(spark), sf).select("conv_id", "text")
    return docs.select("conv_id", diagrams.with_fix(F.col("text"), (F.col("conv_id") % 3).cast("int"), F.concat(F.lit("```mermaid\ngraph LR\nX"), F.col("conv_id").cast("string"), F.lit("\n```"))).alias("t")).select("conv_id", F.sha2("t", 256).alias("text_sha256"))


def menu_intervals(spark, sf):
    """Menus of three levels as intervals: numbers in order, last numbers below, depths, and each leaf's neighbours."""
    n = F.col("page_id")
    pages_ = bind.read(spark, sf, "pages").where("page_id IS NOT NULL").select(n, (n % 3).alias("tree"), (n % 7).alias("s"), F.when(n % 2 == 0, n % 4).alias("g"))
    section, group = F.concat(F.lit("s"), F.col("s").cast("string")), F.concat(F.lit("s"), F.col("s").cast("string"), F.lit("/g"), F.col("g").cast("string"))
    none = F.lit(None).cast("string")
    sections = pages_.select("tree", section.alias("id"), none.alias("parent"), F.col("s").alias("pos"), none.alias("path")).distinct()
    groups = pages_.where("g IS NOT NULL").select("tree", group.alias("id"), section.alias("parent"), F.col("g").alias("pos"), none.alias("path")).distinct()
    leaves = pages_.select("tree", F.concat(F.lit("p"), n.cast("string")).alias("id"), F.coalesce(group, section).alias("parent"), F.when(F.col("g").isNull(), n + 10).otherwise(n).alias("pos"), F.concat(F.lit("p"), n.cast("string"), F.lit(".md")).alias("path"))
    labels = trees.labelled(sections.unionByName(groups).unionByName(leaves))
    return labels.join(trees.leaf_neighbours(labels), ["tree", "path"], "left").select("tree", "id", "depth", "first", "last", "previous", "next")


QUERIES = {
    f.__name__: f
    for f in (menu_intervals, safe_names, doc_names, missing_pages, final_check, severities, page_by_id, entry_handlers, link_forms, resolved_sources, cached_parses, file_metadata, source_folders, container_modules, workspace_packages, page_modules, module_insights, page_composer, menu_from_topology, menu_from_folders, nested_menu, menu_reconciled, package_groups, cross_cluster_edges, listing_tree, reconciled_edges, component_rules, evidence_ranges, signature_depths, key_filters, file_modules, gated_evidence, front_pages, diagram_blocks, diagram_errors, diagram_fixes)
}

H1 = r"(?m)^#\s+(.+)$"
LAST = "last AS (SELECT page_id, shown AS title, output_path AS path FROM labelled QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos DESC) = 1)"
EDGE_KINDS = f"""{ADJ}, o AS (SELECT DISTINCT src_module AS src, dst_module AS dst FROM adj WHERE src_module < dst_module), k AS (SELECT *, ('0x' || substr(md5(src || dst), 1, 1))::INT % 4 AS h FROM o)"""
#: Code of the project that stands in for parts, by the two folders below src.
PROJECT = """p AS (SELECT DISTINCT CASE WHEN p_partkey % 90 = 0 THEN 'src' WHEN p_partkey % 6 = 1 THEN 'src/api_' || p_partkey % 7 ELSE 'src/api_' || p_partkey % 7 || '/k' || p_partkey % 3 END AS folder,
  CASE WHEN p_partkey % 90 = 0 THEN 'main.py' ELSE 'p' || p_partkey || CASE WHEN p_partkey % 10 = 0 THEN '.txt' ELSE '.py' END END AS name FROM part WHERE p_partkey IS NOT NULL),
c AS (SELECT folder, regexp_extract(folder, '^src/[^/]+') AS api, regexp_extract(folder, '^src/[^/]+/(.+)$', 1) AS k FROM p WHERE ends_with(name, '.py') AND folder <> 'src'),
a AS (SELECT api, count(*) AS files, count(DISTINCT k) FILTER (k <> '') AS kids FROM c GROUP BY api),
modules AS (SELECT folder AS path, count(*) AS files FROM c JOIN a USING (api) WHERE kids >= 2 AND k <> '' GROUP BY folder UNION ALL SELECT api, files FROM a WHERE kids < 2)"""
FOLDERS = f"""{VDOCS}, w AS (
  SELECT CASE WHEN conv_id % 4 = 0 THEN 'guides/g' || conv_id || '.md' ELSE path END AS path, CASE WHEN conv_id % 3 = 0 THEN regexp_replace(text, '^# ', '') ELSE text END AS text FROM vdocs
  UNION ALL VALUES ('overview.md', '# Start'), ('doc-map.md', 'no heading'), ('changelog.md', 'x')),
n AS (SELECT path, trim(regexp_extract(text, '{H1}', 1)) AS h, regexp_replace(path, '/?[^/]*$', '') AS folder, regexp_extract(path, '[^/]*$') AS name FROM w),
m AS (SELECT *, CASE WHEN path IN ('overview.md', 'doc-map.md') THEN 0 ELSE coalesce(list_position(['concepts', 'deep-dive', 'reference'], folder), 4) END AS section_pos FROM n),
menu AS (SELECT section_pos::INT AS section_pos, list_extract(['Overview', 'Concepts', 'Deep Dive', 'Reference', 'More'], section_pos::INT + 1) AS section, CASE WHEN section_pos = 4 THEN CASE WHEN folder = '' THEN 'Other' ELSE folder END END AS "group",
  CASE path WHEN 'overview.md' THEN '000000001' WHEN 'doc-map.md' THEN '000000003' ELSE name END AS pos, CASE WHEN h <> '' THEN h WHEN path = 'doc-map.md' THEN 'Doc Map' ELSE regexp_replace(name, '\\.md$', '') END AS title, path FROM m)"""
FENCED = "'```mermaid' || chr(10) || 'flowchart TD' || chr(10) || 'A[step one] --> B' || chr(10) || '```'"

ORACLE_SQL = {
    "menu_intervals": """WITH p AS (SELECT page_id, page_id % 3 AS tree, page_id % 7 AS s, CASE WHEN page_id % 2 = 0 THEN page_id % 4 END AS g FROM pages WHERE page_id IS NOT NULL),
        n AS (SELECT DISTINCT tree, 's' || s AS id, 0 AS depth, s, -1 AS c, -1 AS e, NULL AS path FROM p
          UNION ALL SELECT DISTINCT tree, 's' || s || '/g' || g, 1, s, g, -1, NULL FROM p WHERE g IS NOT NULL
          UNION ALL SELECT tree, 'p' || page_id, CASE WHEN g IS NULL THEN 1 ELSE 2 END, s, CASE WHEN g IS NULL THEN page_id + 10 ELSE g END, CASE WHEN g IS NULL THEN -1 ELSE page_id END, 'p' || page_id || '.md' FROM p),
        o AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY s, c, e) - 1 AS first,
            CASE WHEN path IS NOT NULL THEN 1 WHEN depth = 0 THEN count(*) OVER (PARTITION BY tree, s) ELSE count(*) OVER (PARTITION BY tree, s, c) END AS size FROM n),
        l AS (SELECT tree, id, lag(path) OVER w AS previous, lead(path) OVER w AS next FROM o WHERE path IS NOT NULL WINDOW w AS (PARTITION BY tree ORDER BY first))
        SELECT tree, id, depth::INT AS depth, first, first + size - 1 AS last, previous, next FROM o LEFT JOIN l USING (tree, id)""",
    "safe_names": f"""WITH n AS (SELECT p_partkey, list_extract([{q([" a:b/", "/x.y" + chr(92), "__q/", "数据 "])}], (p_partkey % 4 + 1)::INT) || p_partkey || list_extract([{q(["", "/", " ?!", ".md_"])}], (p_partkey % 4 + 1)::INT) AS name FROM part),
        s AS (SELECT *, regexp_replace(regexp_replace(name, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS kept FROM n)
        SELECT p_partkey, CASE WHEN kept = '' THEN 'page' ELSE kept END AS safe, translate(name, ':/\\.', '____') AS flat, regexp_replace(translate(name, '/\\', '__'), '^_+|_+$', '', 'g') AS slug FROM s""",
    "doc_names": f"""WITH {VDOCS}, h AS (SELECT conv_id, trim(regexp_extract(CASE WHEN conv_id % 4 = 1 THEN regexp_replace(text, '^# ', '') ELSE text END, '{H1}', 1)) AS h FROM vdocs)
        SELECT conv_id, CASE WHEN conv_id % 11 = 0 THEN 'overview' WHEN conv_id % 7 <> 0 AND conv_id % 3 = 1 THEN 'reference' ELSE 'module' END AS type,
               CASE WHEN conv_id % 11 = 0 THEN 'overview' WHEN conv_id % 7 = 0 THEN 'my-page_' || conv_id ELSE CASE conv_id % 3 WHEN 0 THEN 'deep-dive' WHEN 1 THEN 'reference' ELSE 'concept' END || ':c' || conv_id END AS page_id,
               CASE WHEN h <> '' THEN h WHEN conv_id % 11 = 0 THEN 'Overview' WHEN conv_id % 7 = 0 THEN 'My Page ' || conv_id ELSE 'C' || conv_id END AS title FROM h""",
    "missing_pages": f"WITH {PLAN} SELECT page_id, output_path FROM plan WHERE pos % 4 = 0",
    "final_check": f"""WITH {PLAN}, b AS ({ORACLE['page_links_broken']}), i AS ({ORACLE['doc_quality_current']}), k AS (SELECT 'missing' AS kind, count(*) AS issues FROM plan WHERE pos % 4 = 0
        UNION ALL SELECT 'link', count(*) FROM b UNION ALL SELECT 'quality', coalesce(sum(len(string_split(issues, '; '))) FILTER (issues <> ''), 0)::BIGINT FROM i) SELECT * FROM k WHERE issues > 0""",
    "severities": f"WITH {VFILES} SELECT count(*) FILTER (doc_id % 6 = 0) AS errors, count(*) FILTER (doc_id % 6 IN (1, 2)) AS warnings, count(*) FILTER (doc_id % 6 > 2) AS infos, count(*) FILTER (doc_id % 6 = 0) = 0 AS passed FROM vfiles",
    "page_by_id": f"WITH {PLAN}, {LAST} SELECT * FROM last",
    "entry_handlers": f"""WITH e AS (SELECT s_suppkey AS n, list_extract([{q(STEMS)}], (s_suppkey % 5 + 1)::INT) || CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey::VARCHAR ELSE '' END AS stem FROM supplier)
        SELECT 'src/d' || n || '/' || stem || '.py' AS name, CASE WHEN stem IN ('server', 'worker', 'Loader') THEN 'run_' || upper(stem) || '_z' ELSE stem END AS handler FROM e""",
    "link_forms": f"""WITH {VFILES}, n AS (SELECT *, doc_id AS n, doc_id % 5 AS k FROM vfiles),
        r AS (SELECT doc_id, CASE k WHEN 0 THEN '/' || path WHEN 1 THEN path WHEN 2 THEN '/api' WHEN 3 THEN 'HTTPS://h/' || n ELSE 'mailto:a' || n END AS path, CASE WHEN k <= 1 THEN n WHEN k = 2 THEN n + 9 END::BIGINT AS start, CASE k WHEN 0 THEN n + 2 WHEN 1 THEN n WHEN 2 THEN n END::BIGINT AS "end", k >= 3 AS external FROM n)
        SELECT doc_id, path, start, "end", coalesce(start >= 1 AND "end" >= start, false) AS valid, external FROM r""",
    "resolved_sources": f"""WITH {VFILES} SELECT CASE doc_id % 5 WHEN 0 THEN 'file:///work/repo/' || path WHEN 1 THEN '/work/repo/./' || path WHEN 2 THEN 'x/../' || path WHEN 3 THEN replace(path, '/', '%2F') ELSE path || '.gone' END AS reference,
        CASE WHEN doc_id % 5 <> 4 THEN path END AS file FROM vfiles""",
    "cached_parses": f"WITH {VFILES} SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'cached' ELSE 'to parse' END AS result FROM vfiles",
    "file_metadata": f"WITH {VFILES} SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'core' WHEN doc_id % 2 = 0 THEN 'entry' ELSE 'all' END AS found_in, size + CASE WHEN doc_id % 3 = 0 THEN 3 WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS size FROM vfiles",
    "source_folders": f"WITH {PROJECT} SELECT * FROM modules",
    "container_modules": f"""WITH {PROJECT} SELECT 'src/main.py' AS path, 'core' AS kind, 1::BIGINT AS files FROM p WHERE folder = 'src' AND name = 'main.py'
        UNION ALL SELECT path, CASE WHEN path LIKE '%/k_' THEN 'module' ELSE 'api' END, files FROM modules""",
    "workspace_packages": """SELECT folder, stated FROM (VALUES ('packages', true, 0), ('apps', false, 1), ('tools', true, 2)) v(folder, stated, k) WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey % 4 = k)""",
    "page_modules": f"""WITH {VFILES} SELECT 'wiki/deep-dive/Mod-' || doc_id || '.md' AS page, CASE WHEN doc_id % 4 = 0 THEN 'plan' ELSE 'mod_' END || doc_id AS module FROM vfiles WHERE doc_id % 4 = 0 OR doc_id % 5 <> 0""",
    "module_insights": """WITH x AS (SELECT p_brand AS module, unnest(['i' || p_partkey % 9, 'j' || p_partkey % 4]) AS x, unnest([p_partkey * 2, p_partkey * 2 + 1]) AS place FROM part),
        g AS (SELECT module, x, min(place) AS place FROM x GROUP BY ALL), f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY module ORDER BY place) <= 10) SELECT module, string_agg(x, ',' ORDER BY place) AS insights FROM f GROUP BY module""",
    "page_composer": f"""WITH {VDOCS} SELECT path, len(string_split(regexp_replace(text, E'\\n$', ''), E'\\n')) AS lines, CASE WHEN conv_id % 5 <> 0 THEN split_part(path, '/', 1) END AS section, CASE WHEN conv_id % 3 <> 0 THEN 'm' || conv_id END AS module,
        array_to_string(list_filter([CASE WHEN conv_id % 5 = 0 THEN 'not in the menu' END, CASE WHEN conv_id % 3 = 0 THEN 'no module' END], lambda x: x IS NOT NULL), '; ') AS errors FROM vdocs""",
    "menu_from_topology": f"""WITH {PLAN}, {LAST}, g AS (SELECT 'S' || pos % 3 AS section, CASE WHEN pos % 3 = 0 THEN 'G' || pos % 2 END AS "group", pos, page_id FROM plan WHERE pos % 7 <> 0)
        SELECT section, "group", pos, title, path, count(*) OVER (PARTITION BY section, "group") AS pages FROM g JOIN last USING (page_id)""",
    "menu_from_folders": f"WITH {FOLDERS} SELECT * FROM menu",
    "nested_menu": f"""WITH {FOLDERS} SELECT section, CASE WHEN "group" IS NULL THEN 1 ELSE 2 END::INT AS depth, title, path FROM menu UNION ALL SELECT DISTINCT section, 1::INT, "group", NULL FROM menu WHERE "group" IS NOT NULL""",
    "menu_reconciled": f"""WITH {PLAN} SELECT CASE WHEN pos % 2 = 0 THEN 'A' ELSE 'B' END AS section, CASE WHEN pos % 2 = 0 THEN 'New ' || pos ELSE title END AS title, output_path AS path FROM plan WHERE pos % 5 <> 0
        UNION ALL SELECT 'Rest', 'More', 'more/' || pos || '.md' FROM plan WHERE pos % 9 = 0""",
    "package_groups": """WITH g AS (SELECT 'pkg' || p_partkey % 7 AS "group", count(*) AS n, md5(string_agg('deep-dive:pkg' || p_partkey % 7 || '/m' || p_partkey, ',' ORDER BY 'deep-dive:pkg' || p_partkey % 7 || '/m' || p_partkey)) AS pages_md5 FROM part GROUP BY 1)
        SELECT "group", n, max(n) OVER () > 1 AS nested, pages_md5 FROM g""",
    "cross_cluster_edges": f"""WITH {ADJ} SELECT DISTINCT right(src_module, 1) AS "from", right(dst_module, 1) AS "to" FROM adj WHERE right(src_module, 1) <> right(dst_module, 1)""",
    "listing_tree": f"""WITH {VFILES}, p AS (SELECT path, string_split(path, '/') AS parts FROM vfiles), n AS (SELECT path, array_to_string(parts[1:k], '/') AS node FROM (SELECT *, unnest(range(1, least(len(parts), 6) + 1)) AS k FROM p))
        SELECT regexp_replace(node, '/?[^/]*$', '') AS folder, regexp_extract(node, '[^/]*$') AS name, bool_or(node = path) AS is_file, count(*) AS files FROM n GROUP BY node""",
    "reconciled_edges": f"WITH {EDGE_KINDS} SELECT src, dst, CASE h WHEN 0 THEN 'confirmed' WHEN 1 THEN 'conflict' ELSE 'parsed_only' END AS verdict FROM k UNION ALL SELECT src, dst || '?', 'hinted_only' FROM k WHERE h = 2",
    "component_rules": f"""WITH {PLAN}, v(page_type, required, recommended) AS (VALUES {", ".join(f"('{k}', '{','.join(a)}', '{','.join(b)}')" for k, (a, b) in R.PAGE_PROFILES.items())}) SELECT pos, coalesce(required, '') AS required, coalesce(recommended, '') AS recommended FROM plan LEFT JOIN v USING (page_type)""",
    "evidence_ranges": f"""WITH {VFILES} SELECT doc_id, doc_id AS start_line, CASE WHEN doc_id % 2 = 0 THEN doc_id + 5 ELSE doc_id END AS end_line, CASE WHEN doc_id % 3 = 0 THEN 'Label' ELSE 'Name' END AS label, CASE WHEN doc_id % 3 = 0 THEN 'Sum' ELSE 'core source range' END AS reason FROM vfiles WHERE doc_id <> 0
        UNION ALL SELECT doc_id, doc_id + 7, doc_id + 7, CASE WHEN doc_id % 3 = 0 THEN 'f' ELSE 'public interface' END, 'public interface' FROM vfiles""",
    "signature_depths": f"""WITH {VFILES} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'b' ELSE 'a,b' END AS exported, CASE doc_id % 3 WHEN 0 THEN 'a:function:says;b:function:;m:function:x' WHEN 1 THEN 'a:function:says;b;m:function:x' ELSE '' END AS cut FROM vfiles""",
    "key_filters": f"WITH {VFILES} SELECT doc_id, 'path=' || path || ';size=' || size AS without, 'size=' || size AS alone FROM vfiles",
    "file_modules": f"WITH {VFILES} SELECT path AS file, CASE WHEN doc_id % 10 = 3 THEN 'late' ELSE 'm' || doc_id // 50 END AS module FROM vfiles",
    "gated_evidence": f"""WITH {VFILES} SELECT 'deep-dive:' || path || ':module_summary' AS claim_id, 'sum' AS claim_text, 'high' AS confidence FROM vfiles WHERE doc_id % 4 <> 0 UNION ALL SELECT 'deep-dive:' || path || ':module_role', 'role', 'high' FROM vfiles WHERE doc_id % 4 <> 0""",
    "front_pages": f"WITH {VDOCS} SELECT conv_id, 'T ' || conv_id AS title, 'note: x' AS kind, 'p/' || conv_id || '.md' || CASE WHEN conv_id % 2 = 0 THEN ',q.md#s' ELSE '' END AS links FROM vdocs",
    "diagram_blocks": f"""WITH {VDOCS} SELECT path, 'c' || conv_id || ':' || unnest(range(answers::BIGINT)) AS block_id, 'flowchart' AS diagram_type, md5('flowchart TD' || chr(10) || 'A[step one] --> B' || chr(10)) AS text_md5 FROM vdocs WHERE conv_id % 2 = 0""",
    "diagram_errors": f"WITH {VDOCS} SELECT conv_id, conv_id || ',' || (conv_id + 1) AS lines, '1: graph TD' || chr(10) || '2: A' || conv_id || chr(10) || '3: B' AS numbered FROM vdocs",
    "diagram_fixes": f"""WITH {VDOCS}, s AS (SELECT conv_id, answers, (conv_id % 3)::INT AS i, text, string_split(text, {FENCED}) AS parts FROM vdocs)
        SELECT conv_id, sha256(CASE WHEN conv_id % 2 = 0 AND answers > i THEN array_to_string(parts[1:i + 1], {FENCED}) || '```mermaid' || chr(10) || 'graph LR' || chr(10) || 'X' || conv_id || chr(10) || '```' || array_to_string(parts[i + 2:], {FENCED}) ELSE text END) AS text_sha256 FROM s""",
}
