"""How the operators are bound to the tables. The bindings are ours; each has a SQL twin in the catalogue.

vfiles: documents as a tree of files. vdocs: conversations as Markdown documents. The part-supplier pairs
of lineitem are imports between files, brands and nations their modules; turns of conversations call
the next two turns; links of pages lead to files of their site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIRS = ["src", "lib/core", "cmd", "tests", "api/controller", "ui/components", "docs", "db/migrations", "config", "utils", "agents", "dist"]
NAMES = ["main", "index", "user_service", "auth_handler", "test_core", "helpers", "README", "settings", "package", "schema"]
SUFFIXES = [".py", ".ts", ".md", ".json", ".yaml", ".lock", ".sql", ".go", ".rs"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _pick(values: list[str], divisor: int) -> Column:
    n = F.expr(f"CAST(pmod(doc_id div {divisor}, {len(values)}) AS int) + 1")
    return F.element_at(F.array(*map(F.lit, values)), n)


def vfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, size, text, module): module is the folder of source and language."""
    d = read(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    module = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("und")))
    path = F.concat(module, F.lit("/"), _pick(DIRS, 3), F.lit("/d"), F.col("doc_id").cast("string"), F.lit("/"), _pick(NAMES, 5), _pick(SUFFIXES, 1))
    return d.select("doc_id", path.alias("path"), F.coalesce("n_chars", F.lit(0)).alias("size"), F.coalesce("text", F.lit("")).alias("text"), module.alias("module"))


def vmodules(files: DataFrame) -> DataFrame:
    """(path, pos) of the modules of vfiles; all of the same depth, so the order among them doesn't matter."""
    return files.select(F.col("module").alias("path")).distinct().withColumn("pos", F.lit(0))


def snapshots(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(old, new) tables of (path, hash): every seventh file is new, every eleventh gone, every fifth altered."""
    h = F.substring(F.sha2("text", 256), 1, 16)
    old = files.where("doc_id % 7 <> 0").select("path", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("x"), F.substring(h, 2, 15))).otherwise(h).alias("hash"))
    new = files.where("doc_id % 11 <> 0").select("path", h.alias("hash"))
    return old, new


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports (src, dst): parts import their suppliers; a supplier imports the parts of first lines."""
    li = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber")
    part, supp = F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    both = F.array(F.struct(part.alias("src"), supp.alias("dst")), F.when(F.col("l_linenumber") == 1, F.struct(supp.alias("src"), part.alias("dst"))))
    return li.select(F.inline(F.array_compact(both))).distinct()


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, module): parts by brand, suppliers by nation."""
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("file"), F.col("p_brand").alias("module"))
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("file"), F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("module"))
    return p.unionByName(s)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, text, k): k numbers a conversation's turns from 0."""
    from pyspark.sql import Window

    c = read(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    c = c.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m")).select("conv_id", "turn", F.coalesce("m.role", F.lit("none")).alias("role"), F.coalesce("m.text", F.lit("")).alias("text"))
    return c.withColumn("k", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("bigint"))


def node(conv: str = "conv_id", k: str = "k") -> Column:
    return F.concat(F.lit("c"), F.col(conv).cast("string"), F.lit("."), F.lpad(F.col(k).cast("string"), 5, "0"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, pos, dst): a turn calls the next one and the one after it."""
    t = turns(spark, sf_dir).select("conv_id", "k")
    ahead = lambda n: t.select("conv_id", (F.col("k") - n).alias("from_k"), F.lit(n - 1).alias("pos"), node().alias("dst"))
    both = ahead(1).unionByName(ahead(2)).where("from_k >= 0")
    return both.select(node(k="from_k").alias("src"), "pos", "dst")


def vdocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, path, text): each conversation as a Markdown document."""
    fence = "```"
    t = turns(spark, sf_dir)
    answer = F.col("role") == "assistant"
    diagram = F.concat(F.when(F.col("conv_id") % 5 == 0, "").otherwise("This diagram shows the steps.\n\n"), F.lit(f"{fence}mermaid\nflowchart TD\nA[step one] --> B\n{fence}\n\n"))
    code = F.lit(f"{fence}python\nprint(1)\n{fence}\n\n")
    ranged = F.when(F.col("turn") % 4 == 3, "").otherwise(F.concat(F.lit("#L"), (F.col("turn") + 1).cast("string"), F.lit("-L"), (F.col("turn") + 3).cast("string")))
    piece = F.concat(
        F.lit("## Turn "), F.col("turn").cast("string"), F.lit("\n\n"),
        F.when(answer & (F.col("conv_id") % 2 == 0), diagram).when(answer, code).otherwise(""),
        F.col("text"), F.lit("\n\n[source](file:///"), F.col("role"), F.lit("/"), F.col("conv_id").cast("string"), F.lit(".py"), ranged, F.lit(") and [next](c"), (F.col("conv_id") + 1).cast("string"), F.lit(".md) and `call"), F.col("turn").cast("string"), F.lit("`.\n\n"),
    )
    folder = F.when(F.col("conv_id") % 3 == 0, "deep-dive").when(F.col("conv_id") % 3 == 1, "reference").otherwise("concepts")
    head = F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n\n"), F.when(F.col("conv_id") % 4 != 0, "<details open>\n<summary>Relevant source files</summary>\n\n</details>\n\n").otherwise(""))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", piece.alias("piece")))), lambda x: x["piece"]), "")
    return t.groupBy("conv_id").agg(body.alias("body")).select("conv_id", F.concat(folder, F.lit("/c"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), F.concat(head, "body").alias("text"))


def site_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, target, pos) of the links in pages, each target of a page once."""
    p = read(spark, sf_dir, "pages").where("page_id IS NOT NULL")
    return p.select("page_id", F.posexplode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('<a href="([^"]*)"'), F.lit(1)))).alias("pos", "target"))


def plan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, page_id, title, output_path, page_type, purpose, source_targets, depends_on, status, fields): a plan of pages
    with planted faults: every 10th id repeats the one before, every 15th path is unsafe, every 20th lacks targets."""
    n = F.col("page_id")
    s = n.cast("string")
    own = F.when(n % 10 == 9, (n - 1).cast("string")).otherwise(s)
    kind = F.element_at(F.array(*map(F.lit, ["overview", "concept", "deep-dive", "reference", "custom"])), (n % 5 + 1).cast("int"))
    return read(spark, sf_dir, "pages").where("page_id IS NOT NULL").select(
        n.alias("pos"),
        F.concat(F.lit("page-"), own).alias("page_id"),
        F.when(n % 6 == 0, "").otherwise(F.concat(F.lit("Title "), s)).alias("title"),
        F.concat(F.when(n % 15 == 7, "../").otherwise("pages/"), s, F.when(n % 25 == 3, ".txt").otherwise(".md")).alias("output_path"),
        kind.alias("page_type"),
        F.lit("explain").alias("purpose"),
        F.when(n % 20 == 5, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("d"), s))).alias("source_targets"),
        F.when(n % 4 == 1, F.array(F.concat(F.lit("page-"), F.floor(n / 2).cast("string")))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
        F.when(n % 8 == 2, "skipped").otherwise("planned").alias("status"),
        F.when(n % 30 == 11, F.array(*map(F.lit, ["page_id", "output_path", "page_type", "purpose", "source_targets", "depends_on"]))).otherwise(F.array(*map(F.lit, ["depends_on", "output_path", "page_id", "page_type", "purpose", "source_targets", "status", "title"]))).alias("fields"),
    )
