"""Quality of Markdown documents: measures, levels, issues, links, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import classify as C
from tessella.functions import rules as R
from tessella.functions import schema as S
from tessella.functions import text as T
from tessella.functions.columns import base_name, contains_any, lookup, normal_path, parent, stem


def messages(*pairs: tuple[Column, Column | str]) -> Column:
    """The messages whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(c, m if isinstance(m, Column) else F.lit(m)) for c, m in pairs]))


def current(docs: DataFrame) -> DataFrame:
    """(path, text) → counts, issues, warnings and level by the current rules."""
    t = F.col("text")
    m = docs.select(
        "path",
        T.line_count(t).alias("line_count"),
        T.count(t, r"(?m)^##\s+").alias("section_count"),
        T.count(t, T.DIAGRAM).alias("diagram_count"),
        T.count(t, T.SOURCE_LINK).alias("source_link_count"),
        T.count(t, T.RANGED_LINK).alias("source_link_with_lines_count"),
        t.rlike(r"\A\s*#\s+").alias("h1"),
        t.rlike("(?i)" + T.TOP_SOURCE).alias("top"),
        T.has_preface(t).alias("preface"),
        t.contains("|").alias("bar"),
    )
    issues = messages(
        (~F.col("h1"), "Document must start with an H1 title."),
        (~F.col("top"), "H1 must be followed by an open Relevant source files/相关源文件 block."),
        (F.col("source_link_count") == 0, "Document must include file:/// source tracing links."),
        (F.col("source_link_with_lines_count") != F.col("source_link_count"), "All file:/// source links must include #L line ranges."),
        (~F.col("preface"), "Every Mermaid diagram must have a short explanatory paragraph before it."),
    )
    warnings = messages((F.col("section_count") < 1, "Document should include at least one H2 section."), ((F.col("diagram_count") == 0) & ~F.col("bar"), "Document should include a Mermaid diagram or a structured table."))
    m = m.withColumns({"issues": issues, "warnings": warnings})
    score = F.lit(100) - F.size("issues") * 30 - F.size("warnings") * 10
    return m.withColumn("score", score.cast("bigint")).withColumn("quality_level", F.when(score >= 85, "professional").when(score >= 60, "standard").otherwise("basic")).drop("h1", "top", "preface", "bar")


def archived_metrics(docs: DataFrame) -> DataFrame:
    """(path, text) → the measures of the archived rules."""
    t, low = F.col("text"), F.lower("text")
    return docs.select(
        "path",
        F.size(F.split("text", "\n")).cast("bigint").alias("line_count"),
        T.count(t, "(?m)^## ").alias("section_count"),
        T.count(t, "(?m)^### ").alias("subsection_count"),
        T.count(t, "(?s)```mermaid.*?```").alias("diagram_count"),
        T.count(t, "classDiagram").alias("class_diagram_count"),
        T.count(t, "(?s)```(?!mermaid).*?```").alias("code_example_count"),
        T.count(t, r"(?m)^\|[\s\-:|]+\|[\s\-:|]*$").alias("table_count"),
        T.count(t, r"\[.*?\]\((?!http).*?\.md.*?\)").alias("cross_link_count"),
        t.rlike(r"file:///[^)\s#]+").alias("has_source_tracing"),
        t.rlike("(?i)" + T.ANY_TOP_SOURCE).alias("has_relevant_source_files"),
        (T.count(t, "\U0001f7e2") + T.count(t, "\U0001f7e1") + T.count(t, "\U0001f534")).alias("confidence_count"),
        contains_any(low, ["最佳实践", "best practice"]).alias("has_best_practices"),
        contains_any(low, ["性能优化", "性能考量", "performance"]).alias("has_performance"),
        contains_any(low, ["错误处理", "调试", "故障排除", "troubleshoot", "debug"]).alias("has_troubleshooting"),
    )


def archived_level(valid: Column, broken: Column) -> Column:
    """Level from the measures: gates on tracing and on all links being broken, then weighted criteria by document type."""
    kind = C.doc_type(F.col("path"))
    at = lambda c, n=1: (F.col(c) >= n).cast("int")
    yes = lambda c: F.col(c).cast("int")
    total = lambda xs: reduce(lambda a, b: a + b, xs)
    links = [at("diagram_count"), at("cross_link_count"), at("table_count")]
    must = {"overview": [at("section_count", 3), yes("has_source_tracing")], "other": [at("section_count", 3), at("code_example_count")]}
    should = {"overview": links, "getting-started": links, "reference": [at("cross_link_count"), at("table_count"), yes("has_source_tracing")], "module": [at("diagram_count"), at("cross_link_count"), yes("has_troubleshooting")]}
    nice = {"overview": [yes("has_best_practices"), yes("has_performance"), at("class_diagram_count")], "getting-started": [yes("has_troubleshooting"), at("code_example_count", 2), yes("has_source_tracing")], "reference": [yes("has_best_practices"), at("code_example_count", 2), at("class_diagram_count")], "module": [yes("has_best_practices"), yes("has_performance"), at("class_diagram_count")]}
    by = lambda table: F.when(kind == "overview", total(table["overview"])).when(kind == "getting-started", total(table["getting-started"])).when(kind == "reference", total(table["reference"])).otherwise(total(table["module"]))
    m = F.when(kind == "overview", total(must["overview"])).otherwise(total(must["other"]))
    score = F.when(kind == "overview", m / 2.0 * 40 + by(should) / 3.0 * 30 + by(nice) / 3.0 * 30).otherwise(m / 2.0 * 50 + by(should) / 3.0 * 30 + by(nice) / 3.0 * 20)
    score = F.when(F.col("confidence_count") >= 3, F.least(score + 5, F.lit(100.0))).otherwise(score)
    return F.when(~F.col("has_source_tracing") | ((valid == 0) & (broken > 0)), "basic").when(score >= 80, "professional").when(score >= 50, "standard").otherwise("basic")


def expected(docs: DataFrame, modules: DataFrame) -> DataFrame:
    """docs with what is expected of each: by its module's importance, else by the kind of name."""
    name = F.regexp_replace(base_name(F.col("path")), r"\.md$", "")
    out = docs.withColumn("_name", name).join(modules.select(F.col("name").alias("_name"), F.col("importance_score").alias("_i")), "_name", "left")
    low = F.lower("_name")
    tier = (
        F.when(F.col("_i") >= 0.6, "high").when(F.col("_i") >= 0.4, "middle").when(F.col("_i").isNotNull(), "low")
        .when(F.col("_name").isin("index", "_index", "TOC", "doc-map"), "index")
        .when(low.isin("core", "agent", "editor", "main", "client"), "high")
        .when(low.isin("util", "helper", "common", "shared", "constant", "config", "type"), "low")
        .otherwise("default")
    )
    columns = {"min_lines": {"high": 200, "middle": 120, "low": 80, "index": 50, "default": 100}, "min_sections": {"high": 8, "middle": 6, "low": 5, "index": 3, "default": 6}, "min_diagrams": {"high": 2, "middle": 1, "low": 1, "index": 1, "default": 1}, "min_examples": {"high": 3, "middle": 2, "low": 2, "index": 0, "default": 2}}
    out = out.withColumn("_tier", tier)
    return out.withColumns({c: lookup(F.col("_tier"), table) for c, table in columns.items()}).drop("_name", "_i", "_tier")


def archived_issues(level: Column, valid: Column, broken: Column, missing: Column, invalid: Column) -> Column:
    """Issues of a document with measures and expectations, in order."""
    c, f = F.col, F.format_string
    standard = level == "standard"
    return messages(
        (c("line_count") < c("min_lines"), f("行数不足: %s/%s (基于模块复杂度)", c("line_count"), c("min_lines"))),
        (c("section_count") < c("min_sections"), f("章节数不足: %s/%s", c("section_count"), c("min_sections"))),
        (c("diagram_count") < c("min_diagrams"), f("图表数不足: %s/%s", c("diagram_count"), c("min_diagrams"))),
        ((c("class_diagram_count") < 1) & (c("min_diagrams") >= 2), "核心模块缺少 classDiagram 类图"),
        (c("code_example_count") < c("min_examples"), f("代码示例不足: %s/%s", c("code_example_count"), c("min_examples"))),
        (~c("has_source_tracing"), "缺少源码追溯 (file:// 链接)"),
        ((C.doc_type(c("path")) == "module") & ~c("has_relevant_source_files"), "模块文档标题后应立即包含「相关源文件」(Relevant source files) 折叠源码索引（使用 <details open>）"),
        (broken > 0, f("失效的源码链接: %s 个 (有效: %s)", broken, valid)),
        (missing > 0, f("缺少行号范围的源码链接: %s 个", missing)),
        (invalid > 0, f("行号超出范围的源码链接: %s 个", invalid)),
        (c("cross_link_count") < 1, "缺少相关文档交叉链接"),
        (standard & ~c("has_best_practices"), "[建议] 缺少最佳实践章节 (添加可提升至 Professional)"),
        (standard & ~c("has_performance"), "[建议] 缺少性能优化章节 (添加可提升至 Professional)"),
        (standard & (c("confidence_count") < 3), "[建议] 文档缺少置信度标注 (添加可提升至 Professional)"),
    )


def rollup(levels: DataFrame) -> DataFrame:
    """One row: documents by level, and the severity of the whole: 2 if over half are basic, 1 if any is, else 0."""
    one = levels.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("quality_level") == x).alias(x) for x in ("professional", "standard", "basic")])
    return one.withColumn("exit_code", F.when(F.col("basic") * 2 > F.col("total"), 2).when(F.col("basic") > 0, 1).otherwise(0))


def source_links(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(path) → counts of distinct source links: valid, broken, without lines, lines out of bounds. files: (file, lines)."""
    links = docs.select("path", F.explode(F.array_distinct(T.found(F.col("text"), T.SOURCE_LINK))).alias("link"))
    parts = links.select("path", F.regexp_replace(F.regexp_replace("link", "^file:///", ""), "#.*$", "").alias("file"), F.regexp_extract("link", r"#L(\d+)", 1).alias("a"), F.regexp_extract("link", r"#L\d+-L?(\d+)", 1).alias("b"))
    n = lambda c: F.when(F.col(c) != "", F.col(c)).cast("bigint")
    parts = parts.select("path", "file", n("a").alias("first"), F.coalesce(n("b"), n("a")).alias("last")).join(files.select("file", "lines"), "file", "left")
    out_of = F.col("lines").isNotNull() & F.col("first").isNotNull() & ((F.col("first") < 1) | (F.col("last") > F.col("lines")) | (F.col("last") < F.col("first")))
    return parts.groupBy("path").agg(F.count_if(F.col("lines").isNotNull()).alias("valid"), F.count_if(F.col("lines").isNull()).alias("broken"), F.count_if(F.col("first").isNull()).alias("missing_lines"), F.count_if(out_of).alias("invalid_lines"))


def broken_links(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(path, target) of Markdown links whose file is neither beside the page nor below the root. files: (file)."""
    links = docs.select("path", F.explode(F.array_distinct(T.found(F.col("text"), T.LINK, 2))).alias("target")).withColumn("target", F.trim("target"))
    local = links.where(~C.external_link(F.col("target")) & ~F.col("target").startswith("#"))
    clean = F.regexp_replace(F.regexp_replace("target", "^file://", ""), "#.*$", "")
    local = local.withColumn("clean", clean).where("clean <> ''")
    beside = normal_path(F.concat(parent(F.col("path")), F.lit("/"), F.col("clean")))
    tried = local.withColumns({"beside": F.when(F.col("clean").startswith("/"), F.col("clean")).otherwise(beside), "below": normal_path(F.regexp_replace("clean", "^/+", ""))})
    return tried.join(files.select(F.col("file").alias("beside")), "beside", "left_anti").join(files.select(F.col("file").alias("below")), "below", "left_anti").select("path", "target")


def unlisted(files: DataFrame, menu: DataFrame) -> DataFrame:
    """Documents (file) that the menu (file) doesn't list; none if the menu is empty."""
    rest = files.where(~F.col("file").isin(*R.TOP_LEVEL_PAGES)).join(menu, "file", "left_anti")
    return rest.join(F.broadcast(menu.limit(1).select(F.lit(True).alias("some"))), how="cross").select("file").distinct()


def missing_interfaces(imports: DataFrame, docs: DataFrame) -> DataFrame:
    """(source, target, interface) that a module imports but the target's document doesn't name; targets without
    a document are left alone. imports: (source, target, interface). docs: (module, text)."""
    known = docs.select(F.col("module").alias("target"), F.explode(T.documented_names(F.col("text"))).alias("interface")).distinct()
    return imports.distinct().join(docs.select(F.col("module").alias("target")).distinct(), "target", "left_semi").join(known, ["target", "interface"], "left_anti").select("source", "target", "interface")


def severity(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("severity") == "info").alias("infos")).withColumn("passed", F.col("errors") == 0)


def missing_pages(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Planned pages, but for skipped ones, whose file isn't there."""
    return pages.where(~F.coalesce(F.col("status") == "skipped", F.lit(False))).join(files.select(F.col("file").alias("output_path")), "output_path", "left_anti").select("page_id", "output_path")


def finalise(pages: DataFrame, files: DataFrame, docs: DataFrame) -> DataFrame:
    """(kind, subject, message): all checks of a finished wiki in one table; it is fine if there are no rows."""
    missing = missing_pages(pages, files).select(F.lit("missing").alias("kind"), F.coalesce("output_path", "page_id").alias("subject"), F.lit("missing planned page").alias("message"))
    links = broken_links(docs, files).select(F.lit("link").alias("kind"), F.col("path").alias("subject"), F.concat(F.lit("broken link: "), "target").alias("message"))
    issues = current(docs).select(F.lit("quality").alias("kind"), F.col("path").alias("subject"), F.explode("issues").alias("message"))
    return missing.unionByName(links).unionByName(issues)


def wiki_key(df: DataFrame, keys: DataFrame, plan: DataFrame) -> DataFrame:
    """(page, module): by the plan, else by an equal document path, else by the file's stem, else by the stem of the key.
    keys: (module, doc_path, pos). plan: (page, module)."""
    norm = lambda c: F.lower(F.translate(stem(base_name(c)), "-", "_"))
    pages = df.select("page", F.regexp_replace("page", "^wiki/", "").alias("p"), norm(F.col("page")).alias("s"))
    tries = [
        pages.join(plan.select("page", "module"), "page").select("page", "module", F.lit(0).alias("tier"), F.lit(0).alias("pos")),
        pages.join(keys.select("module", "pos", F.regexp_replace("doc_path", "^wiki/", "").alias("p")), "p").select("page", "module", F.lit(1).alias("tier"), "pos"),
        pages.join(keys.where("doc_path IS NOT NULL").select("module", "pos", norm(F.col("doc_path")).alias("s")), "s").select("page", "module", F.lit(2).alias("tier"), "pos"),
        pages.join(keys.select("module", "pos", norm(F.col("module")).alias("s")), "s").select("page", "module", F.lit(3).alias("tier"), "pos"),
    ]
    found = reduce(lambda a, b: a.unionByName(b), tries)
    return found.groupBy("page").agg(F.min_by("module", F.struct("tier", "pos")).alias("module"))


def self_check(files: DataFrame, required: DataFrame, front: str, name: str, phrases: list[str]) -> DataFrame:
    """(message) for a package's files (path, text): required ones (path) that are missing, a front page without its
    front matter, name or description, and phrases that required files must not have. It is fine if there are no rows."""
    missing = required.join(files.select("path"), "path", "left_anti").select(F.concat(F.lit("missing required file: "), "path").alias("message"))
    says = lambda lack, what: (~lack, f"{front} missing {what}")
    page = files.where(F.col("path") == front).select(F.explode(messages(says(F.col("text").startswith("---"), "YAML frontmatter"), says(F.col("text").contains(f"name: {name}"), f"name: {name}"), says(F.col("text").contains("description:"), "description"))).alias("message"))
    hits = F.filter(F.array(*map(F.lit, phrases)), lambda x: F.contains(F.lower("text"), x))
    declares = files.join(required, "path", "left_semi").select("path", F.explode(hits).alias("phrase")).select(F.concat("path", F.lit(" declares legacy dependency: "), "phrase").alias("message"))
    return missing.unionByName(page).unionByName(declares)


def check_report(errors: DataFrame, total: DataFrame) -> DataFrame:
    """One row of counts: total, failed and passed items. errors: (item) with an error each; total: (item)."""
    failed = errors.select("item").distinct().agg(F.count(F.lit(1)).alias("failed"))
    return total.agg(F.count(F.lit(1)).alias("total")).crossJoin(F.broadcast(failed)).select("total", "failed", (F.col("total") - F.col("failed")).alias("passed"))


def schema_faults(documents: DataFrame, schema: dict, text_col: str = "text", levels: int = 4) -> DataFrame:
    """A row for each fault of a JSON document under a schema: documents' other columns, path, rule, message."""
    rest = [c for c in documents.columns if c != text_col]
    return documents.select(*rest, F.inline(S.faults(F.try_parse_json(text_col), schema, levels)))
