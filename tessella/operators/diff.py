"""Snapshots of files: what changed, what that affects, and merging of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import classify as C
from tessella.functions.columns import ancestors


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status): added, deleted, modified or unchanged, by one full outer join of (path, hash) tables."""
    a, b = old.select("path", F.col("hash").alias("before"), F.lit(True).alias("in_old")), new.select("path", F.col("hash").alias("after"), F.lit(True).alias("in_new"))
    status = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "deleted").when(F.col("before").eqNullSafe(F.col("after")), "unchanged").otherwise("modified")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def change_types(diff: DataFrame, content: DataFrame) -> DataFrame:
    """(path, status, change_type) of what isn't unchanged; texts are looked at only for modified files."""
    changed = diff.where("status <> 'unchanged'")
    out = changed.join(content.select("path", "text"), "path", "left")
    return out.select("path", "status", C.change_type(F.col("status"), F.col("path"), F.col("text")).alias("change_type"))


def affected_modules(diff: DataFrame, modules: DataFrame) -> DataFrame:
    """Modules (path) that hold a changed file, by an equality join on the files' ancestors."""
    parts = diff.where("status <> 'unchanged'").select(F.explode(ancestors(F.col("path"))).alias("module")).distinct()
    return modules.select(F.col("path").alias("module")).join(parts, "module", "left_semi")


def affected_pages(pages: DataFrame, modules: DataFrame, recompile_all: bool = False) -> DataFrame:
    """page_id of pages whose modules (array affected_modules) meet the given ones; all of them if so asked, once anything changed."""
    if recompile_all:
        return pages.select("page_id").where("page_id IS NOT NULL").distinct() if not modules.isEmpty() else pages.select("page_id").limit(0)
    return pages.select("page_id", F.explode("affected_modules").alias("module")).join(modules, "module", "left_semi").select("page_id").where("page_id IS NOT NULL").distinct()


def propagate(changed: DataFrame, modules: DataFrame, imports: DataFrame) -> DataFrame:
    """Modules (name) that import a changed one, one hop: an import matches a module's folder if either is a prefix
    of the other, at part boundaries for dotted names. Prefixes become equality joins on ancestors.

    changed: (name). modules: (name, path). imports: (name, target): what a module's core files import.
    """
    folder = modules.join(changed, "name", "left_semi").select(F.concat(F.regexp_replace("path", "/+$", ""), F.lit("/")).alias("folder")).distinct()
    asked = imports.join(changed, "name", "left_anti").select("name", "target", F.concat(F.regexp_replace(F.translate("target", ".", "/"), "/+$", ""), F.lit("/")).alias("norm"))
    chain = lambda c: F.transform(ancestors(F.regexp_replace(c, "/+$", "")), lambda x: F.concat(x, F.lit("/")))
    below = asked.select("name", F.explode(F.array_union(chain(F.col("norm")), chain(F.col("target")))).alias("folder")).join(folder, "folder", "left_semi").select("name")
    # The other way round: the folder begins with the import, be it a whole part or a part's beginning.
    starts = folder.select("folder", F.explode(F.transform(F.sequence(F.lit(1), F.length("folder")), lambda n: F.substring("folder", F.lit(1), n))).alias("head"))
    above = asked.select("name", F.explode(F.array("norm", "target")).alias("head")).join(starts, "head", "left_semi").select("name")
    return below.union(above).distinct()


def upsert(existing: DataFrame, parts: DataFrame, key: str, order: str) -> DataFrame:
    """existing with the rows of parts in place of those with the same key; of several parts the last in order wins."""
    rest = [c for c in existing.columns if c != key]
    last = parts.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
    return existing.join(last.select(key), key, "left_anti").select(*existing.columns).unionByName(last.select(*existing.columns))


def stale(inputs: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of inputs (module, input_hash) that done hasn't with the same hash: what must be written again."""
    return inputs.join(done.select("module", "input_hash"), ["module", "input_hash"], "left_anti")


def included(df: DataFrame, dirs: list[str], literals: list[str] = (), globs: list[str] = ()) -> DataFrame:
    """Paths of code and documents that no rule leaves out."""
    from tessella.functions import rules as R

    p = F.col("path")
    return df.where(~C.ignored_by(p, [*dirs, *literals], list(globs)) & C.suffix_exact(p).isin(*R.CODE_SUFFIXES, *R.TEXT_DOC_SUFFIXES))
