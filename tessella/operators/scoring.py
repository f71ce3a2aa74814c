"""Importance of files, modules and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import classify as C
from tessella.functions import rules as R
from tessella.functions.columns import ancestors, base_name, contains_any, ladder, py_round, stem, suffix

RAW = ["path_score", "identity_score", "lang_score", "size_score", "degree_score"]


def raw_scores(path: Column, size: Column, degree: Column, archetype: str | None = None) -> dict[str, Column]:
    """The five scores of a file, each of a group of exclusive signals."""
    low, parts, name = F.lower(path), F.split(path, "/"), base_name(path)
    ext, root = suffix(name), F.lower(stem(name))
    contract = path.isin(*R.CONTRACT_PATHS) if archetype == "agent-project" else F.lit(False)
    has = lambda p: F.array_contains(parts, p)
    words = F.array(*map(F.lit, R.BUSINESS_WORDS))
    return {
        "path_score": ladder([(contract | has("src") | has("lib"), 1.0), (has("cmd") | has("bin"), 0.8), (contains_any(low, ["database", "schema", "migration"]), 0.6), (F.size(parts) == 1, 0.3)], 0.2),
        "identity_score": ladder([(contract | root.isin("main", "index", "app", "mod"), 1.0), (contains_any(root, R.BUSINESS_WORDS), 0.8), (F.arrays_overlap(F.split(low, "/"), words), 0.5), (contains_any(low, ["config", "setup", "setting"]), 0.3)], 0.0),
        "lang_score": ladder([(contract | ext.isin(*R.PRIMARY_SUFFIXES, *R.SCRIPT_SUFFIXES, *R.FRONT_SUFFIXES), 1.0), (ext.isin(*R.DATABASE_SUFFIXES), 0.9), (ext.isin(*R.BUILD_SUFFIXES) | name.isin(*R.BUILD_NAMES), 0.5), (ext.isin(*R.SETTING_SUFFIXES), 0.4), (ext.isin(*R.STYLE_SUFFIXES, *R.TEMPLATE_SUFFIXES), 0.3), (ext.isin(*R.LOCK_SUFFIXES), 0.1)], 0.0),
        "size_score": ladder([(contract | size.between(1024, 51200), 1.0), (size.between(100, 1023), 0.5)], 0.0),
        "degree_score": F.least(degree / F.lit(10.0), F.lit(1.0)),
    }


def weighted(scores: list[Column], archetype: str | None = None) -> Column:
    """Weighted sum in the order of the groups, at most one. The weights may sum to more than one."""
    out = None
    for s, w in zip(scores, R.WEIGHTS.get(archetype, R.DEFAULT_WEIGHTS), strict=True):
        out = s * F.lit(w) if out is None else out + s * F.lit(w)
    return F.least(out, F.lit(1.0))


def importance(df: DataFrame, archetype: str | None = None, degree: str | None = None) -> DataFrame:
    """df with the five scores, importance (4 digits) and the first flags."""
    d = F.col(degree) if degree else F.lit(0)
    out = df.withColumns(raw_scores(F.col("path"), F.col("size"), d, archetype))
    out = out.withColumn("total", F.round(weighted([F.col(c) for c in RAW], archetype), 4))
    return out.withColumns({"importance_score": py_round(F.col("total"), 2), "is_core": F.col("total") >= R.CORE_LEAST, "is_high_priority": F.col("total") >= R.HIGH_LEAST})


def with_module(df: DataFrame, modules: DataFrame, unmatched: bool = True) -> DataFrame:
    """df with the module (path, pos) whose folder holds each file; of nested modules the last one. The prefix test
    is an equality join on each file's ancestors, not a loop over modules."""
    chains = df.select("path", F.explode(ancestors(F.col("path"))).alias("module"))
    own = chains.join(modules.select(F.col("path").alias("module"), "pos"), "module").groupBy("path").agg(F.max_by("module", "pos").alias("module"))
    return df.join(own, "path", "left" if unmatched else "inner")


def percentile_score(p: Column) -> Column:
    return ladder([(p >= 0.9, 1.0), (p >= 0.7, 0.8), (p >= 0.5, 0.6), (p >= 0.3, 0.4)], 0.2)


def normalise(df: DataFrame, module: str = "module", archetype: str | None = None) -> DataFrame:
    """Within each module, scores paths by the share of files whose raw score is strictly lower; a module of
    one file keeps the raw score. Rows without module keep their importance.

    Shares come from a histogram of the few raw scores a module has, so no module's rows meet in one task.
    """
    hist = df.where(F.col(module).isNotNull()).groupBy(module, "path_score").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(module).orderBy("path_score")
    share = hist.select(module, "path_score", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("lower"), F.sum("n").over(Window.partitionBy(module)).alias("members"))
    out = df.join(share, [module, "path_score"], "left")
    score = F.when(F.col("members") < 2, F.col("path_score")).otherwise(percentile_score(F.col("lower") / F.col("members")))
    again = py_round(weighted([score, *[F.col(c) for c in RAW[1:]]], archetype), 2)
    return out.withColumns({"percentile": F.when(F.col("members") >= 2, F.col("lower") / F.col("members")), "path_score_normalized": F.when(F.col("members").isNotNull(), score), "importance_score": F.when(F.col("members").isNotNull(), again).otherwise(F.col("importance_score"))})


def thresholds(df: DataFrame) -> DataFrame:
    """One row (core, high): the scores at 35 and 15 % of the descending order, within 0.2 and 0.9; fixed ones below 20 files.

    Scores have two digits, so their histogram is small however many files there are.
    """
    hist = df.groupBy("importance_score").agg(F.count(F.lit(1)).alias("n"))
    one = hist.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sort_array(F.collect_list(F.struct("importance_score", "n")), False).alias("h"))

    def nth(share: float) -> Column:
        k = F.floor(F.col("n") * F.lit(share))
        start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("at"))
        found = F.aggregate("h", start, lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["at"].isNull() & (a["seen"] + x["n"] > k), x["importance_score"]).otherwise(a["at"]).alias("at")))
        return F.greatest(F.lit(0.2), F.least(F.lit(0.9), found["at"]))

    small = F.col("n") < 20
    return one.select(F.when(small, F.lit(R.CORE_LEAST)).otherwise(nth(0.35)).alias("core"), F.when(small, F.lit(R.HIGH_LEAST)).otherwise(nth(0.15)).alias("high"))


def flag(df: DataFrame) -> DataFrame:
    """df with is_core and is_high_priority by its own thresholds (a broadcast of one row)."""
    out = df.drop("is_core", "is_high_priority").crossJoin(F.broadcast(thresholds(df)))
    return out.withColumns({"is_core": F.col("importance_score") >= F.col("core"), "is_high_priority": F.col("importance_score") >= F.col("high")}).drop("core", "high")


def module_scores(df: DataFrame, module: str = "module") -> DataFrame:
    """Each module's mean importance, and its first core files (by path)."""
    hundredths = F.round(F.col("importance_score") * 100).cast("bigint")
    total = df.groupBy(module).agg(F.count(F.lit(1)).alias("files"), F.sum(hundredths).alias("s"))
    # The first few of each module: of each of 64 parts of it first, so that no module's files meet in one task.
    cored = df.where("is_core").select(module, "path", F.pmod(F.xxhash64("path"), F.lit(64)).alias("_part"))
    first = lambda rows, *keys: rows.withColumn("_rn", F.row_number().over(Window.partitionBy(module, *keys).orderBy("path"))).where(F.col("_rn") <= R.MAX_CORE_FILES)
    core = first(first(cored, "_part")).groupBy(module).agg(F.sort_array(F.collect_list("path")).alias("core_files"))
    out = total.join(core, module, "left")
    return out.select(module, "files", py_round(F.col("s") / 100.0 / F.col("files"), 2).alias("importance_score"), F.coalesce(F.size("core_files"), F.lit(0)).cast("bigint").alias("core_files_count"), F.coalesce(F.array_join("core_files", ","), F.lit("")).alias("core_files"))


def budget(df: DataFrame) -> DataFrame:
    """One row: tokens, budget, reserve and how many files fit. Files are taken in order of importance until
    the first that doesn't fit; a running sum over a compact order finds it."""
    ext = suffix(base_name(F.col("path")))
    costed = df.select("path", "importance_score", "is_core", "is_high_priority", C.token_cost(F.col("size"), ext).alias("cost"), ext.isin(*R.CODE_SUFFIXES).alias("code"))
    one = costed.agg(
        F.coalesce(F.sum(F.when(F.col("code"), F.col("cost"))), F.lit(0)).alias("code_tokens"),
        F.count_if("is_core").alias("quick_files"),
        F.coalesce(F.sum(F.when(F.col("is_core"), F.floor(F.col("cost") / 10))), F.lit(0)).alias("quick_cost"),
    )
    t = F.col("code_tokens")
    low, high = F.when(t < 100_000, 50_000).when(t < 1_000_000, 150_000).otherwise(300_000), F.when(t < 100_000, 200_000).when(t < 1_000_000, 400_000).otherwise(600_000)
    one = one.withColumn("total_budget", F.greatest(low, F.least(high, F.floor(t * F.lit(0.3)))).cast("bigint"))
    one = one.withColumn("reserved", F.floor(F.col("total_budget") * F.lit(0.33)).cast("bigint"))
    one = one.withColumn("available", F.col("total_budget") - F.col("reserved")).withColumn("left", F.col("available") - F.col("quick_cost"))
    # Costs are at least 100, so no more files than a hundredth of the largest budget can fit: the order is cut there.
    deep = costed.where("is_high_priority AND NOT is_core").orderBy(F.desc("importance_score"), "path").limit(6001)
    running = deep.withColumn("sum", F.sum("cost").over(Window.orderBy(F.desc("importance_score"), "path").rowsBetween(Window.unboundedPreceding, 0)))
    fits = running.crossJoin(F.broadcast(one.select("left"))).where(F.col("sum") <= F.col("left")).agg(F.count(F.lit(1)).alias("deep_files"), F.coalesce(F.max("sum"), F.lit(0)).alias("deep_cost"))
    return one.crossJoin(fits).withColumn("remaining", F.col("left") - F.col("deep_cost")).drop("left")
