"""The registered queries over whole tables. Each names the operators it exercises by their survey ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import classify as C
from tessella.functions import diagrams
from tessella.functions import rules as R
from tessella.functions import text as T
from tessella.functions.columns import base_name, lookup, suffix
from tessella.operators import diff, graph, inventory, pages, quality, scoring
from tessella.plans import bind, code_queries, diagram_queries, oracle, schema_queries, stream_queries, tree_queries, wiki_queries
from tessella.scratch import materialise
from tessella.session import ship


def _inv(spark, sf):
    return inventory.with_facts(bind.vfiles(spark, sf))


def _scored(spark, sf):
    return scoring.importance(bind.vfiles(spark, sf))


def _normal(spark, sf):
    """Scores, written once: ids, paths and numbers without texts, over which several passes go."""
    return materialise(scoring.normalise(materialise(_scored(spark, sf).drop("text"), "scores")), "normalised")


def _ranked(spark, sf):
    return scoring.flag(_normal(spark, sf))


def inventory_files(spark, sf):
    """SC1 facts, P1-P4, P29, X33."""
    return _inv(spark, sf)


def inventory_stats(spark, sf):
    """A1-A3 in one aggregation."""
    return inventory.stats(_inv(spark, sf))


def entry_and_config(spark, sf):
    """P5, P6."""
    return inventory.entries_and_configs(_inv(spark, sf))


def managers_by_module(spark, sf):
    """P36, P37 for each module."""
    inv = _inv(spark, sf)
    named = inv.withColumn("module", F.concat_ws("/", F.slice(F.split("path", "/"), 1, 2)))
    return inventory.managers_and_frameworks(named, ["module"])


def ext_histogram(spark, sf):
    """A4."""
    return inventory.extension_histogram(_inv(spark, sf))


def size_buckets(spark, sf):
    """P9, A5."""
    return inventory.size_buckets(_inv(spark, sf))


def language_rank(spark, sf):
    """A6."""
    return inventory.language_rank(_inv(spark, sf))


def code_purpose(spark, sf):
    """P7 for each file."""
    return bind.vfiles(spark, sf).select("doc_id", C.code_purpose(F.col("path")).alias("purpose"))


def module_type(spark, sf):
    """P8 over the names of parts."""
    return bind.read(spark, sf, "part").select("p_partkey", C.module_kind(F.coalesce("p_name", F.lit(""))).alias("kind"))


def importance_score(spark, sf):
    """P10-P17."""
    return _scored(spark, sf).select("doc_id", *scoring.RAW, "total", "importance_score", "is_core", "is_high_priority")


def module_percentile(spark, sf):
    """The module is found by an equality join on ancestors."""
    files = materialise(_scored(spark, sf).drop("text"), "scores")
    found = scoring.with_module(files.drop("module"), bind.vmodules(files))
    return scoring.normalise(found).select("doc_id", "module", "percentile", "path_score_normalized", "importance_score")


def dynamic_thresholds(spark, sf):
    """W3."""
    return scoring.thresholds(_normal(spark, sf))


def module_scores(spark, sf):
    """A8, O3, O5."""
    return scoring.module_scores(_ranked(spark, sf))


def directory_scores(spark, sf):
    """SC3, Q6."""
    return inventory.directories(_inv(spark, sf))


def context_budget(spark, sf):
    """P34, W4, Q5, A20; files of the first tenth of each module are taken as not core, so that the deep list isn't empty."""
    files = _ranked(spark, sf).withColumn("is_core", F.col("is_core") & (F.col("doc_id") % 3 == 0))
    return scoring.budget(files)


def analysis_depth(spark, sf):
    """Line counts stand for complexity and important lines."""
    f = bind.vfiles(spark, sf)
    lines = T.loc(F.col("text"))
    return f.select("doc_id", C.analysis_depth(T.complexity(lines, F.lit(0), F.lit(10)), lines, C.code_purpose(F.col("path")), F.col("doc_id") % 4 == 0).alias("depth"))


def snapshot_diff(spark, sf):
    """J14, U1, U2, SK9."""
    return diff.snapshot_diff(*bind.snapshots(bind.vfiles(spark, sf)))


def change_types(spark, sf):
    """P25."""
    files = bind.vfiles(spark, sf)
    return diff.change_types(diff.snapshot_diff(*bind.snapshots(files)), files)


def affected_modules(spark, sf):
    """Folders of each depth count as modules."""
    files = bind.vfiles(spark, sf)
    return diff.affected_modules(diff.snapshot_diff(*bind.snapshots(files)), bind.vmodules(files))


def affected_pages(spark, sf):
    """A page a source, affected through its modules."""
    files = bind.vfiles(spark, sf)
    changed = files.where("doc_id % 13 = 0").select("module").distinct()
    plan = files.groupBy(F.split("module", "/")[0].alias("page_id")).agg(F.collect_set("module").alias("affected_modules"))
    return diff.affected_pages(plan, changed)


def reverse_propagation(spark, sf):
    """Brands whose parts import suppliers of changed nations."""
    e, m = bind.edges(spark, sf), bind.members(spark, sf)
    used = graph.module_edges(e, m).select(F.col("src_module").alias("name"), F.concat("dst_module", F.lit("/x")).alias("target")).distinct()
    modules = m.select(F.col("module").alias("name")).distinct().withColumn("path", F.col("name"))
    return diff.propagate(modules.where("name IN ('nation1', 'nation3')").select("name"), modules, used)


def upsert_merge(spark, sf):
    """SK5, SK13, U6, W8: parts override stored rows, the last part wins."""
    files = bind.vfiles(spark, sf)
    stored = files.where("doc_id % 3 <> 0").select("path", F.lit("stored").alias("origin"), "size")
    part = lambda n, every: files.where(F.col("doc_id") % every == 0).select("path", F.lit(f"part{n}").alias("origin"), (F.col("size") + n).alias("size"), F.lit(n).alias("part"))
    return diff.upsert(stored, part(1, 2).unionByName(part(2, 5)), "path", "part")


def import_in_degree(spark, sf):
    """A7, P14."""
    return graph.in_degree(bind.edges(spark, sf))


def module_adjacency(spark, sf):
    """J9, J10, A9."""
    return graph.adjacency(bind.edges(spark, sf), bind.members(spark, sf))


def cross_density(spark, sf):
    """A10, G5."""
    m = bind.members(spark, sf)
    return graph.density(graph.adjacency(bind.edges(spark, sf), m), m)


def dependency_hints(spark, sf):
    """J11."""
    return graph.dependency_hints(bind.edges(spark, sf), bind.members(spark, sf))


def import_filter(spark, sf):
    """Edges out of and into the suppliers of one nation."""
    files = bind.members(spark, sf).where("module = 'nation1'").select("file")
    return graph.of_module(bind.edges(spark, sf), files)


def module_components(spark, sf):
    """Turns of a conversation are one component."""
    c = bind.calls(spark, sf)
    nodes = bind.turns(spark, sf).select(bind.node().alias("node"))
    return graph.components(nodes, c)


def split_hints(spark, sf):
    """Conversations of equal last digit form a module."""
    t = bind.turns(spark, sf)
    m = t.select(bind.node().alias("file"), F.concat(F.lit("m"), (F.col("conv_id") % 10).cast("string")).alias("module"))
    return graph.internal_components(m, bind.calls(spark, sf))


def bfs_sequences(spark, sf):
    """Breadth-first order from each conversation's first turn."""
    starts = bind.turns(spark, sf).where("k = 0").select(bind.node().alias("start"))
    return graph.visits(bind.calls(spark, sf), starts)


def architecture_layers(spark, sf):
    """Files by source and language."""
    f = bind.vfiles(spark, sf)
    return graph.layers(graph.primary_purpose(f.select(F.concat_ws("/", "module", F.element_at(F.split("path", "/"), 3)).alias("module"), F.col("path").alias("file"))))


def dominant_purpose(spark, sf):
    """Of a module's files, ties to the first name."""
    f = bind.vfiles(spark, sf)
    return graph.dominant(f.select(F.col("module").alias("group"), C.code_purpose(F.col("path")).alias("purpose")))


def bidirectional_sections(spark, sf):
    """The first letters of nations' and brands' names as sections."""
    e = graph.module_edges(bind.edges(spark, sf), bind.members(spark, sf)).select("src_module", "dst_module").distinct()
    section = lambda c: F.substring(c, -1, 1)
    return graph.bidirectional(e.select(section("src_module").alias("src"), section("dst_module").alias("dst")))


def page_links_broken(spark, sf):
    """Markdown links of vdocs whose document doesn't exist."""
    docs = bind.vdocs(spark, sf)
    return quality.broken_links(docs, docs.select(F.col("path").alias("file")))


def unlisted_pages(spark, sf):
    """Site targets that no navigation of the first page lists."""
    links = bind.site_links(spark, sf)
    files = links.select(F.concat(F.col("target"), F.lit(".md")).alias("file")).distinct()
    menu = links.where("page_id % 2 = 0").select(F.concat(F.col("target"), F.lit(".md")).alias("file")).distinct()
    return quality.unlisted(files, menu)


def doc_metrics(spark, sf):
    """The archived measures."""
    return quality.archived_metrics(bind.vdocs(spark, sf))


def doc_quality_current(spark, sf):
    """Counts, issues and level."""
    q = quality.current(bind.vdocs(spark, sf))
    return q.withColumns({"issues": F.array_join("issues", "; "), "warnings": F.array_join("warnings", "; ")})


def _archived(spark, sf):
    docs = bind.vdocs(spark, sf)
    m = quality.archived_metrics(docs)
    files = docs.where("conv_id % 3 <> 2").select(F.concat(F.lit("user/"), F.col("conv_id").cast("string"), F.lit(".py")).alias("file"), (F.col("conv_id") % 7 + 2).alias("lines"))
    links = quality.source_links(docs, files)
    m = m.join(links, "path", "left").na.fill(0, ["valid", "broken", "missing_lines", "invalid_lines"])
    return m.withColumn("quality_level", quality.archived_level(F.col("valid"), F.col("broken"))), links


def doc_quality_archived(spark, sf):
    """P26, Q2."""
    return _archived(spark, sf)[0].select("path", "quality_level")


def expected_metrics(spark, sf):
    """Q3: conversations whose number ends in 0 or 1 have a module of known importance."""
    docs = bind.vdocs(spark, sf)
    modules = docs.where("conv_id % 10 <= 1").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("name"), (F.col("conv_id") % 9 / 10.0).alias("importance_score"))
    return quality.expected(docs.select("path"), modules)


def doc_issues(spark, sf):
    """Q4, N8."""
    m, _ = _archived(spark, sf)
    e = quality.expected(m, m.select(F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("importance_score")).limit(0))
    return e.select("path", F.size(quality.archived_issues(F.col("quality_level"), F.col("valid"), F.col("broken"), F.col("missing_lines"), F.col("invalid_lines"))).cast("bigint").alias("issues"))


def quality_rollup(spark, sf):
    """A17, A18."""
    return quality.rollup(_archived(spark, sf)[0])


def source_link_lines(spark, sf):
    """X3, J28."""
    return _archived(spark, sf)[1]


def interface_coverage(spark, sf):
    """Each conversation imports the names of its own turns from the next one."""
    docs = bind.vdocs(spark, sf)
    imports = bind.turns(spark, sf).select(F.col("conv_id").alias("source"), (F.col("conv_id") + 1).alias("target"), F.concat(F.lit("call"), F.col("turn").cast("string")).alias("interface"))
    return quality.missing_interfaces(imports, docs.select(F.col("conv_id").alias("module"), "text"))


def related_pages(spark, sf):
    """Pages that share a dependency edge."""
    p = bind.plan_pages(spark, sf)
    return pages.related(p.select("page_id", F.explode("depends_on").alias("depends_on")))


def page_excerpts(spark, sf):
    """J2, X28."""
    files = bind.vfiles(spark, sf)
    targets = files.select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("page_id"), F.when(F.col("doc_id") % 6 == 0, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("target"))
    return pages.contexts(targets, files).select("page_id", "target", F.length("excerpt").alias("chars"), "start_line", "end_line", F.col("constraint"))


def snippets(spark, sf):
    """Lines 2 to 4 of every document with context."""
    f = bind.vfiles(spark, sf)
    s = T.snippet(F.col("text"), F.lit(2), F.lit(4), context=1)
    return f.select("doc_id", F.sha2(s, 256).alias("snippet_sha256"), F.length(s).alias("chars"))


def source_lines(spark, sf):
    """E25, SC14: each line with its number and highlight."""
    f = bind.vfiles(spark, sf)
    return f.select("doc_id", F.inline(T.numbered_lines(F.col("text"), F.lit(2), F.lit(3)))).select("doc_id", "number", F.md5("text").alias("text_md5"), "highlight")


def menu_from_seed(spark, sf):
    """A section a page type, with one unknown id each."""
    p = bind.plan_pages(spark, sf)
    seed = p.groupBy("page_type").agg(F.sort_array(F.collect_list("pos")).alias("ids")).select(F.lit(0).alias("section_pos"), F.col("page_type").alias("section"), F.concat(F.array(F.lit("page-none")), F.transform("ids", lambda x: F.concat(F.lit("page-"), x.cast("string")))).alias("page_ids"))
    return pages.menu_from_seed(seed, p).drop("section_pos")


def menu_by_type(spark, sf):
    """A12."""
    return pages.menu_by_type(bind.plan_pages(spark, sf))


def menu_prev_next(spark, sf):
    """Within each page type."""
    m = pages.menu_by_type(bind.plan_pages(spark, sf)).withColumn("planned", F.col("pos") % 8 == 2)
    return pages.neighbours(m, ["section"])


def menu_dedupe(spark, sf):
    """Links of each page type, first of each target."""
    links = bind.site_links(spark, sf)
    m = links.select((F.col("page_id") % 5).alias("section"), (F.col("page_id") * 1000 + F.col("pos")).alias("pos"), F.col("target").alias("path"))
    return pages.dedupe(m, ["section"])


def menu_redundant(spark, sf):
    """Five built-in groups and an own one; links go by their place in the page, those of the third group by target."""
    links = bind.site_links(spark, sf)
    names = F.element_at(F.array(*map(F.lit, [*R.BUILTIN_GROUPS, "own"])), (F.col("page_id") % 6 + 1).cast("int"))
    path = F.when(F.col("page_id") % 6 == 2, F.col("target")).otherwise(F.concat(F.lit("p"), F.col("pos").cast("string")))
    return pages.redundant_groups(links.select(names.alias("group"), path.alias("path")))


def plan_validation(spark, sf):
    """A11, J5, P24, N8, U8."""
    p = bind.plan_pages(spark, sf)
    order = p.where("pos % 12 <> 1").select("page_id").unionByName(p.where("pos % 40 = 0").select(F.concat("page_id", F.lit("-x")).alias("page_id")))
    return pages.plan_errors(p, order)


def doc_topology(spark, sf):
    """Modules are parts, in workspaces for some."""
    n = F.col("p_partkey")
    kinds = ["Entry", "Dao", "Service", "Util", ""]
    m = bind.read(spark, sf, "part").select(
        F.concat(F.lit("mod-"), n.cast("string"), F.when(n % 2 == 0, "_x").otherwise("")).alias("name"),
        F.concat(F.when(n % 3 == 0, F.concat(F.lit("packages/pkg"), (n % 7).cast("string"), F.lit("/src/"))).when(n % 3 == 1, F.concat(F.lit("apps/a"), (n % 4).cast("string"), F.lit("/"))).otherwise("src/"), F.lit("mod_"), n.cast("string")).alias("path"),
        F.element_at(F.array(*map(F.lit, kinds)), (n % 5 + 1).cast("int")).alias("code_purpose"),
        F.when(n % 4 == 0, F.concat(F.lit(" Group "), (n % 9).cast("string"))).when(n % 4 == 1, "unknown").alias("semantic_group"),
    )
    return pages.topology(m)


def evidence_claims(spark, sf):
    """Documents as modules, labelled ones have evidence."""
    d = bind.vfiles(spark, sf).join(bind.read(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("q")), "doc_id", "left")
    m = d.select(F.col("path").alias("module"), F.col("text").alias("module_summary"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("role "), F.col("doc_id").cast("string"))).alias("module_role"), F.when(F.col("q") == 1, F.array(F.lit("f"))).otherwise(F.array().cast("array<string>")).alias("evidence_files"))
    return pages.claims(m)


def missing_required_fields(spark, sf):
    """Documents as analyses with gaps."""
    n = F.col("doc_id")
    gap = lambda k, c: F.when(n % k == 0, F.lit(None)).when(n % k == 1, F.lit("")).otherwise(c)
    d = bind.vfiles(spark, sf).select("path", *[gap(i + 3, F.col("module")).alias(c) for i, c in enumerate([*R.MODULE_REQUIRED, *R.MODULE_COGNITIVE])])
    return pages.missing_fields(d, [*R.MODULE_REQUIRED, *R.MODULE_COGNITIVE], "path")


def toc(spark, sf):
    """The title and the paragraphs' first words of each page stand for its headings."""
    p = bind.read(spark, sf, "pages").where("page_id IS NOT NULL")
    as_h2 = F.regexp_replace(F.coalesce("html", F.lit("")), F.lit(r"<(/?)h1>"), F.lit("<$1h2>"))
    return p.select("page_id", F.posexplode(T.headings(as_h2)).alias("pos", "h")).select("page_id", "pos", "h.level", "h.text")


def line_metrics(spark, sf):
    """X7-X9."""
    f = bind.vfiles(spark, sf)
    t = F.col("text")
    return f.select("doc_id", T.loc(t).alias("loc"), F.size(T.todo_lines(t)).cast("bigint").alias("todo"), T.complexity(F.size(F.split(t, r"\bif\b")) - 1, F.size(F.split(t, "the ")) - 1, T.loc(t)).alias("complexity"))


def mermaid_repair(spark, sf):
    """Diagrams of vdocs repaired in place."""
    docs = bind.vdocs(ship(spark), sf)
    return docs.select("conv_id", diagrams.repair(F.col("text")).alias("r")).select("conv_id", "r.blocks", "r.changed", "r.fixes", F.sha2("r.text", 256).alias("text_sha256"))


def token_costs(spark, sf):
    """P34, P28 for each file."""
    f = bind.vfiles(spark, sf)
    ext = suffix(base_name(F.col("path")))
    return f.select("doc_id", C.token_cost(F.col("size"), ext).alias("cost"), lookup(ext, R.TOKEN_RATIOS, 4).cast("bigint").alias("ratio"))


QUERIES = {
    f.__name__: f
    for f in (
        inventory_stats, inventory_files, entry_and_config, managers_by_module, ext_histogram, size_buckets, language_rank, code_purpose, module_type,
        importance_score, module_percentile, dynamic_thresholds, module_scores, directory_scores, context_budget, analysis_depth, token_costs,
        snapshot_diff, change_types, affected_modules, affected_pages, reverse_propagation, upsert_merge,
        import_in_degree, module_adjacency, cross_density, dependency_hints, import_filter, module_components, split_hints, bfs_sequences, architecture_layers, dominant_purpose, bidirectional_sections,
        page_links_broken, unlisted_pages, doc_metrics, doc_quality_current, doc_quality_archived, expected_metrics, doc_issues, quality_rollup, source_link_lines, interface_coverage,
        related_pages, page_excerpts, snippets, source_lines, menu_from_seed, menu_by_type, menu_prev_next, menu_dedupe, menu_redundant, plan_validation, doc_topology, evidence_claims, missing_required_fields, toc, line_metrics, mermaid_repair,
    )
}


QUERIES |= code_queries.QUERIES | diagram_queries.QUERIES | schema_queries.QUERIES | stream_queries.QUERIES | tree_queries.QUERIES | wiki_queries.QUERIES
ORACLE_SQL = oracle.ORACLE_SQL | code_queries.ORACLE_SQL | diagram_queries.ORACLE_SQL | schema_queries.ORACLE_SQL | stream_queries.ORACLE_SQL | tree_queries.ORACLE_SQL | wiki_queries.ORACLE_SQL


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return module_percentile(spark, sf)
