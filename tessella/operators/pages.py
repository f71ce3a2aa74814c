"""Plans of pages, menus, evidence and page contexts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import classify as C
from tessella.functions import rules as R
from tessella.functions import text as T
from tessella.functions.columns import lookup, slug, title_words


def field_errors(pages: DataFrame) -> DataFrame:
    """(pos, message) for each page of (pos, fields array<string>, page_id, output_path, source_targets array)."""
    at = F.concat(F.lit("pages["), F.col("pos").cast("string"), F.lit("] "))
    missing = F.array_except(F.array(*map(F.lit, R.PAGE_FIELDS)), F.col("fields"))
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    errors = F.array_compact(
        F.array(
            F.when(F.size(missing) > 0, F.concat(at, F.lit("missing fields: "), F.array_join(missing, ", "))),
            F.when(blank("page_id"), F.concat(at, F.lit("page_id must be non-empty"))),
            F.when(blank("output_path"), F.concat(at, F.lit("output_path must be non-empty"))).when(~C.safe_markdown_path(F.col("output_path")), F.concat(at, F.lit("output_path is unsafe or not markdown: "), F.col("output_path"))),
            F.when(F.coalesce(F.size("source_targets") == 0, F.lit(True)), F.concat(at, F.lit("source_targets must be non-empty"))),
        )
    )
    return pages.select("pos", F.explode(errors).alias("message"))


def plan_errors(pages: DataFrame, order: DataFrame) -> DataFrame:
    """(message) for a plan: fields, duplicates, and ids that the generation order (page_id) lacks or has in excess."""
    twice = lambda c: pages.where(F.coalesce(F.col(c) != "", F.lit(False))).groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.concat(F.lit(f"duplicate {c}: "), F.col(c)).alias("message"))
    ids = pages.where("page_id <> ''").select("page_id").distinct()
    lacks = ids.join(order, "page_id", "left_anti").select(F.concat(F.lit("generation_order misses: "), F.col("page_id")).alias("message"))
    excess = order.distinct().join(ids, "page_id", "left_anti").select(F.concat(F.lit("generation_order has unknown: "), F.col("page_id")).alias("message"))
    return reduce(lambda a, b: a.unionByName(b), [field_errors(pages).select("message"), twice("page_id"), twice("output_path"), lacks, excess])


def related(deps: DataFrame) -> DataFrame:
    """(page_id, related): what a page depends on and what depends on it. deps: (page_id, depends_on)."""
    both = deps.select("page_id", F.col("depends_on").alias("other")).union(deps.select(F.col("depends_on").alias("page_id"), F.col("page_id").alias("other")))
    return both.where("page_id <> other").groupBy("page_id").agg(F.array_join(F.sort_array(F.collect_set("other")), ",").alias("related"))


def contexts(targets: DataFrame, files: DataFrame, chars: int = R.EXCERPT_CHARS) -> DataFrame:
    """(page_id, target, excerpt, start_line, end_line, constraint) of each page's targets; unreadable ones give a constraint."""
    got = targets.join(files.select(F.col("path").alias("target"), "text"), "target", "left")
    e = T.excerpt(F.col("text"), chars)
    return got.withColumn("e", e).select("page_id", "target", F.col("e.text").alias("excerpt"), F.when(F.col("text").isNotNull(), F.col("e.start_line")).alias("start_line"), F.col("e.end_line").alias("end_line"), F.when(F.col("text").isNull(), F.concat(F.lit("Source target not readable: "), "target")).alias("constraint"))


def page_map(pages: DataFrame) -> DataFrame:
    """Pages with id and path; of equal ids the last."""
    known = pages.where("page_id <> '' AND output_path <> ''")
    return known.groupBy("page_id").agg(F.max_by(F.struct(F.coalesce(F.nullif("title", F.lit("")), "page_id").alias("title"), F.col("output_path").alias("path")), "pos").alias("p")).select("page_id", "p.title", "p.path")


def menu_from_seed(seed: DataFrame, pages: DataFrame) -> DataFrame:
    """(section_pos, section, pos, title, path) for seed (section_pos, section, page_ids); unknown ids and empty sections go."""
    wanted = seed.select("section_pos", F.coalesce("section", F.lit("Pages")).alias("section"), F.posexplode("page_ids").alias("pos", "page_id"))
    return wanted.join(page_map(pages), "page_id").select("section_pos", "section", "pos", "title", "path")


def menu_by_type(pages: DataFrame) -> DataFrame:
    """The same by page type, types in the order in which they first appear."""
    kind = F.coalesce("page_type", F.lit("custom"))
    first = pages.groupBy(kind.alias("kind")).agg(F.min("pos").alias("section_pos"))
    label = F.coalesce(lookup(F.col("kind"), R.TYPE_LABELS), F.initcap("kind"))
    return pages.withColumn("kind", kind).join(first, "kind").select("section_pos", label.alias("section"), "pos", F.coalesce(F.nullif("title", F.lit("")), "page_id").alias("title"), F.col("output_path").alias("path"))


def doc_map(menu: DataFrame, title: str) -> DataFrame:
    """One row: the menu as a Markdown list."""
    item = F.concat(F.lit("- ["), "title", F.lit("]("), "path", F.lit(")"))
    sections = menu.groupBy("section_pos", "section").agg(F.sort_array(F.collect_list(F.struct("pos", item.alias("line")))).alias("lines"))
    body = F.concat(F.lit("## "), "section", F.lit("\n\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n"))
    whole = sections.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section_pos", body.alias("text")))), lambda x: x["text"]), "\n").alias("body"))
    return whole.select(F.concat(F.lit(f"# {title} Documentation Map\n\n"), F.col("body")).alias("text"))


def neighbours(menu: DataFrame, by: list[str], block: int = 65_536) -> DataFrame:
    """Menu leaves with the paths of their neighbours; planned ones are skipped. The order is within by (a menu each).

    Leaves are ordered in blocks of places, so that a section however long lies in no single task; the ends of
    blocks meet on a table of one row a block.
    """
    leaves = menu.where("NOT planned").withColumn("_block", F.floor(F.col("pos") / block))
    keys = [*dict.fromkeys([*by, "section_pos"]), "_block"]
    inside, across = Window.partitionBy(*keys).orderBy("pos"), Window.partitionBy(*by).orderBy("section_pos", "_block")
    ends = leaves.groupBy(*keys).agg(F.min_by("path", "pos").alias("_first"), F.max_by("path", "pos").alias("_last"), F.count(F.lit(1)).alias("_n"))
    ends = ends.select(*keys, "_n", F.lag("_last").over(across).alias("_before"), F.lead("_first").over(across).alias("_after"))
    ranked = leaves.select("*", F.row_number().over(inside).alias("_k"), F.lag("path").over(inside).alias("_lag"), F.lead("path").over(inside).alias("_lead"))
    met = ranked.join(ends, keys)
    return met.select(*by, "path", F.when(F.col("_k") == 1, F.col("_before")).otherwise(F.col("_lag")).alias("previous"), F.when(F.col("_k") == F.col("_n"), F.col("_after")).otherwise(F.col("_lead")).alias("next"))


def dedupe(menu: DataFrame, by: list[str]) -> DataFrame:
    """Of items with the same path in a group the first stays; items without path all do."""
    with_path = menu.where("path <> ''").groupBy(*by, "path").agg(F.min("pos").alias("pos"))
    return menu.join(with_path, [*by, "path", "pos"], "left_semi").unionByName(menu.where("coalesce(path, '') = ''"))


def redundant_groups(leaves: DataFrame) -> DataFrame:
    """Built-in groups (group) all of whose paths lie in other groups as well. leaves: (group, path)."""
    pairs = leaves.distinct()
    spread = pairs.groupBy("path").agg(F.count(F.lit(1)).alias("groups"))
    return pairs.join(spread, "path").groupBy("group").agg(F.min("groups").alias("least")).where((F.col("least") > 1) & F.col("group").isin(*R.BUILTIN_GROUPS)).select("group")


def reconcile(menu: DataFrame, files: DataFrame, more: str = "更多") -> DataFrame:
    """A menu (section, pos, title, path) brought in line with documents (file, title): missing ones go, titles are
    renewed, equal sections merge, unlisted documents join a last section, double paths go."""
    kept = menu.join(files.select(F.col("file").alias("path"), F.col("title").alias("new")), "path").select("section", "pos", F.coalesce("new", "title").alias("title"), "path")
    rest = files.where(~F.col("file").isin(*R.TOP_LEVEL_PAGES)).join(menu.select(F.col("path").alias("file")), "file", "left_anti")
    added = rest.select(F.lit(more).alias("section"), F.lit(2**31 - 1).alias("pos"), "title", F.col("file").alias("path"))
    both = kept.withColumn("pos", F.col("pos").cast("int")).unionByName(added)
    return both.groupBy("section", "path").agg(F.min_by("title", "pos").alias("title"), F.min("pos").alias("pos")).select("section", "pos", "title", "path")


def topology(modules: DataFrame) -> DataFrame:
    """The static pages and one page a module: (id, type, title, output_path, package_group, source_module).
    modules: (name, path, code_purpose, semantic_group)."""
    spark = modules.sparkSession
    static = spark.createDataFrame([(*p, None, None) for p in R.STATIC_PAGES], "id string, type string, title string, output_path string, package_group string, source_module string")
    m = modules.withColumn("m", C.monorepo(F.col("path")))
    package = F.nullif(F.col("m.package"), F.lit(""))
    group = F.trim(F.coalesce("semantic_group", F.lit("")))
    title = F.when((group != "") & ~F.lower(group).isin("unknown", "other"), group).otherwise(title_words(F.col("name")))
    prefix = F.coalesce(F.concat(F.lit("deep-dive/"), package), F.lit("deep-dive"))
    own = F.when(F.col("m.slug") != "", F.col("m.slug")).otherwise(slug(F.col("name")))
    pages = m.select(
        F.coalesce(F.concat(F.lit("deep-dive:"), package, F.lit("/"), "name"), F.concat(F.lit("deep-dive:"), "name")).alias("id"),
        C.page_type(F.col("code_purpose")).alias("type"),
        title.alias("title"),
        F.concat(F.lit("wiki/"), prefix, F.lit("/"), own, F.lit(".md")).alias("output_path"),
        package.alias("package_group"),
        F.col("path").alias("source_module"),
    )
    return static.unionByName(pages)


def package_groups(topo: DataFrame) -> DataFrame:
    """Module pages by package (or title), and whether any group has several (the menu is nested then)."""
    own = topo.where(F.col("type").isin("capability", "internal"))
    g = own.groupBy(F.coalesce("package_group", "title").alias("group")).agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("pages"), F.count(F.lit(1)).alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.coalesce(F.max("n") > 1, F.lit(False)).alias("nested"))))


def source_ranges(core: Column, interfaces: Column) -> Column:
    """Ranges of a file from its core ranges (start_line, end_line, label, name, reason, summary) and its interfaces
    (line, end_line, name), in this order; those without a start go."""
    a = F.transform(F.filter(core, lambda r: F.coalesce(r["start_line"], F.lit(0)) != 0), lambda r: F.struct(r["start_line"].alias("start_line"), F.coalesce(r["end_line"], r["start_line"]).alias("end_line"), F.coalesce(F.nullif(r["label"], F.lit("")), F.nullif(r["name"], F.lit("")), F.lit("core source")).alias("label"), F.coalesce(F.nullif(r["reason"], F.lit("")), F.nullif(r["summary"], F.lit("")), F.lit("core source range")).alias("reason")))
    b = F.transform(F.filter(interfaces, lambda i: F.coalesce(i["line"], F.lit(0)) != 0), lambda i: F.struct(i["line"].alias("start_line"), F.coalesce(i["end_line"], i["line"]).alias("end_line"), F.coalesce(F.nullif(i["name"], F.lit("")), F.lit("public interface")).alias("label"), F.lit("public interface").alias("reason")))
    return F.concat(F.coalesce(a, F.array().cast("array<struct<start_line:bigint,end_line:bigint,label:string,reason:string>>")), F.coalesce(b, F.array().cast("array<struct<start_line:bigint,end_line:bigint,label:string,reason:string>>")))


def claims(modules: DataFrame) -> DataFrame:
    """(claim_id, page_id, claim_text, confidence) from (module, module_summary, module_role, evidence_files)."""
    long = modules.unpivot(["module", "evidence_files"], ["module_summary", "module_role"], "field", "claim_text").where("coalesce(claim_text, '') <> ''")
    return long.select(F.concat(F.lit("deep-dive:"), "module", F.lit(":"), "field").alias("claim_id"), F.concat(F.lit("deep-dive:"), "module").alias("page_id"), "claim_text", F.when(F.coalesce(F.size("evidence_files"), F.lit(0)) > 0, "high").otherwise("low").alias("confidence"))


def missing_fields(df: DataFrame, required: list[str], key: str) -> DataFrame:
    """(key, missing): names of required columns that are null or empty, those that have any."""
    empty = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c).cast("string") == "", F.lit(True)), F.lit(c)) for c in required]))
    return df.select(key, F.array_join(empty, ",").alias("missing")).where("missing <> ''")


def signatures(definitions: Column, depth: Column) -> Column:
    """Definitions (name, kind, line, end_line, doc, params, returns) cut to a depth of analysis: all for deep, names
    and places of undocumented ones for standard, none for quick."""
    none = lambda d, kind: F.lit(None).cast(kind)
    brief = lambda d: F.when(F.trim(F.coalesce(d["doc"], F.lit(""))) != "", F.struct(d["name"].alias("name"), d["kind"].alias("kind"), d["line"].alias("line"), d["end_line"].alias("end_line"), d["doc"].alias("doc"))).otherwise(F.struct(d["name"].alias("name"), none(d, "string").alias("kind"), d["line"].alias("line"), d["end_line"].alias("end_line"), none(d, "string").alias("doc")))
    full = lambda d: F.struct(d["name"].alias("name"), d["kind"].alias("kind"), d["line"].alias("line"), d["end_line"].alias("end_line"), d["doc"].alias("doc"))
    return F.when(depth == "deep", F.transform(definitions, full)).when(depth == "standard", F.transform(definitions, brief)).otherwise(F.slice(F.transform(definitions, full), 1, 0))


def exports(definitions: Column, export_lines: Column) -> Column:
    """Names of top-level definitions on lines that export; of all top-level ones if there are no such lines or none fits."""
    top = F.filter(definitions, lambda d: (F.coalesce(d["parent"], F.lit("")) == "") & (F.coalesce(d["name"], F.lit("")) != ""))
    exported = F.filter(top, lambda d: F.array_contains(export_lines, d["line"]))
    return F.transform(F.when(F.size(exported) > 0, exported).otherwise(top), lambda d: d["name"])


def insights(files: DataFrame, most: int = 10) -> DataFrame:
    """(module, insights): each module's distinct insights in order, the first few. files: (module, pos, insights).

    An insight counts where it is first met; ranks are cut off in every task before they meet, so that a module
    however large sends a few rows.
    """
    first = files.select("module", "pos", F.posexplode("insights").alias("at", "insight")).groupBy("module", "insight").agg(F.min(F.struct("pos", "at")).alias("place"))
    top = first.withColumn("k", F.row_number().over(Window.partitionBy("module").orderBy("place"))).where(F.col("k") <= most)
    found = top.groupBy("module").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "insight"))), lambda x: x["insight"]).alias("insights"))
    return files.select("module").distinct().join(found, "module", "left").select("module", F.coalesce("insights", F.array().cast("array<string>")).alias("insights"))


def file_to_module(modules: DataFrame) -> DataFrame:
    """(file, module): from (module, pos, files); the last module that lists a file wins."""
    return modules.select("module", "pos", F.explode("files").alias("file")).groupBy("file").agg(F.max_by("module", "pos").alias("module"))
