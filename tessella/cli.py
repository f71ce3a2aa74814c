"""Commands over a project's folder: python -m tessella.cli COMMAND ROOT. State lies in ROOT/.tessella; results are printed as JSON lines."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import code, diagrams
from tessella.functions import schema as S
from tessella.functions import text as T
from tessella.operators import diff, graph, inventory, pages, quality, scoring, wiki
from tessella.sources import sinks, tree

PLAN = "pages array<struct<page_id:string,title:string,output_path:string,page_type:string,purpose:string,source_targets:array<string>,depends_on:array<string>,status:string>>, generation_order array<string>, menu_seed array<struct<title:string,page_ids:array<string>>>"


def _files(spark: SparkSession, root: str) -> DataFrame:
    return tree.read_tree(spark, root)


def _plan(spark: SparkSession, root: str) -> DataFrame:
    return tree.checked_json(spark, f"{root}/.tessella/cache/page-plan.json", PLAN, strict=True)


def _pages(plan: DataFrame) -> DataFrame:
    p = plan.select(F.posexplode("pages").alias("pos", "p")).select("pos", "p.*")
    return p.withColumn("fields", F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in pages.R.PAGE_FIELDS])))


def init(spark: SparkSession, root: str) -> DataFrame:
    made = []
    for path, body in wiki.initial_files(Path(root).resolve().name).items():
        target = Path(root) / path
        if not target.exists():
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(body, encoding="utf-8")
            made.append((path,))
    return spark.createDataFrame(made, "created string")


def prepare_inventory(spark: SparkSession, root: str) -> DataFrame:
    inv = inventory.files(_files(spark, root))
    inv.write.mode("overwrite").parquet(f"{root}/.tessella/cache/inventory")
    return inventory.stats(spark.read.parquet(f"{root}/.tessella/cache/inventory"))


def analyse(spark: SparkSession, root: str) -> DataFrame:
    """Importance of files, modules being the top folders."""
    files = scoring.importance(_files(spark, root))
    modules = files.select(F.regexp_extract("path", "^([^/]+)/", 1).alias("path")).where("path <> ''").distinct().withColumn("pos", F.lit(0))
    return scoring.flag(scoring.normalise(scoring.with_module(files, modules))).select("path", "module", "importance_score", "is_core", "is_high_priority").orderBy(F.desc("importance_score"), "path")


def structure(spark: SparkSession, root: str) -> DataFrame:
    """Definitions and calls of every source file."""
    files = inventory.files(_files(spark, root)).select("path", "extension").join(_files(spark, root).select("path", "text"), "path")
    return files.select("path", code.parsed(F.col("text"), F.col("extension")).alias("p")).select("path", "p.language", "p.complexity", "p.important_lines", "p.imports", F.transform("p.definitions", lambda d: F.concat_ws(":", d["kind"], d["parent"], d["name"], d["line"].cast("string"))).alias("definitions"))


def sequences(spark: SparkSession, root: str) -> DataFrame:
    """Breadth-first call orders from the project's entry files."""
    inv = inventory.files(_files(spark, root))
    parsed = inv.select("path", "extension").join(_files(spark, root).select("path", "text"), "path").select("path", F.explode(code.parsed(F.col("text"), F.col("extension"))["calls"]).alias("c")).select("path", "c.qname", "c.calls")
    known = parsed.groupBy("qname").agg(F.max_by("calls", "path").alias("calls"))
    handlers = graph.entry_handlers(inventory.probed_entries(inv).select(F.col("path").alias("name")), known)
    edges = known.select(F.col("qname").alias("src"), F.posexplode("calls").alias("pos", "dst"))
    return graph.sequences(graph.visits(edges, handlers.select(F.col("handler").alias("start")).distinct(), nodes=known.select(F.col("qname").alias("node")))).orderBy("start", "ord")


def changes(spark: SparkSession, root: str) -> DataFrame:
    """What changed since the last call; the snapshot is stored."""
    files, stored = _files(spark, root).cache(), f"{root}/.tessella/cache/checksums"
    new = inventory.files(files).select("path", "hash")
    old = spark.read.parquet(stored) if sinks.exists(spark, stored) else new.limit(0)
    found = diff.change_types(diff.snapshot_diff(old, new), files).collect()
    sinks.replace(new, stored)
    return spark.createDataFrame(found, "path string, status string, change_type string")


def validate_plan(spark: SparkSession, root: str) -> DataFrame:
    plan = _plan(spark, root)
    return pages.plan_errors(_pages(plan), plan.select(F.explode("generation_order").alias("page_id")))


def page_context(spark: SparkSession, root: str) -> DataFrame:
    p = _pages(_plan(spark, root))
    return pages.contexts(p.select("page_id", F.explode("source_targets").alias("target")), _files(spark, root).select("path", "text"))


def menu(spark: SparkSession, root: str) -> DataFrame:
    plan = _plan(spark, root)
    seed = plan.select(F.posexplode_outer("menu_seed").alias("section_pos", "s")).where("s IS NOT NULL").select("section_pos", F.col("s.title").alias("section"), F.col("s.page_ids").alias("page_ids"))
    made = pages.menu_from_seed(seed, _pages(plan))
    made = pages.menu_by_type(_pages(plan)) if made.isEmpty() else made
    sinks.menu(made, f"{root}/.tessella/cache/menu", Path(root).resolve().name)
    sinks.text(pages.doc_map(made, Path(root).resolve().name), f"{root}/.tessella/cache/doc-map")
    return made.orderBy("section_pos", "pos")


def diagram_report(spark: SparkSession, root: str) -> DataFrame:
    return wiki.documents(spark, root).select("path", diagrams.repair(F.col("text")).alias("r")).select("path", "r.blocks", "r.fixes").where("blocks > 0")


def quality_report(spark: SparkSession, root: str) -> DataFrame:
    return quality.current(wiki.documents(spark, root).where(F.col("path") != "doc-map.md")).orderBy("path")


def finalise(spark: SparkSession, root: str) -> DataFrame:
    docs = wiki.documents(spark, root)
    files = docs.select(F.col("path").alias("file")).union(_files(spark, root).select("path"))
    return quality.finalise(_pages(_plan(spark, root)), files, docs)


def titles(spark: SparkSession, root: str) -> DataFrame:
    return wiki.documents(spark, root).select("path", T.title_of(F.col("text"), F.regexp_extract("path", r"([^/]+)\.md$", 1)).alias("title"))


def folders(spark: SparkSession, root: str) -> DataFrame:
    return wiki.menu_from_folders(wiki.documents(spark, root)).orderBy("section_pos", "pos")


#: Stored documents and their contracts.
STORED = {"page-plan.json": S.PAGE_PLAN, "semantic-analysis.json": S.ANALYSIS, "menu.json": S.STORED_MENU}


def validate_schemas(spark: SparkSession, root: str) -> DataFrame:
    """Faults of the stored documents under their contracts; documents that aren't there have none."""
    found = spark.createDataFrame([], "file string, path string, rule string, message string")
    for name, schema in STORED.items():
        if sinks.exists(spark, at := f"{root}/.tessella/cache/{name}"):
            text = spark.read.text(at, wholetext=True).select(F.lit(name).alias("file"), F.col("value").alias("text"))
            found = found.unionByName(quality.schema_faults(text, schema))
    return found


#: Commands whose rows are faults: they make the exit code one.
CHECKS = {"validate-plan": validate_plan, "validate-schemas": validate_schemas, "finalise": finalise}
COMMANDS = {"init": init, "inventory": prepare_inventory, "analyse": analyse, "structure": structure, "sequences": sequences, "changes": changes, "page-context": page_context, "menu": menu, "diagrams": diagram_report, "quality": quality_report, "titles": titles, "folders": folders, **CHECKS}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessella", description=__doc__)
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("root")
    args = parser.parse_args(argv)
    if spark is None:
        from tessella.session import local_session

        spark = local_session()
    some = False
    for line in COMMANDS[args.command](spark, args.root.rstrip("/")).toJSON().toLocalIterator():
        print(json.dumps(json.loads(line), ensure_ascii=False))
        some = True
    return int(some and args.command in CHECKS)


if __name__ == "__main__":
    sys.exit(main())
