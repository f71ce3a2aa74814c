"""Inventory of files: one row a file, and the aggregates over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import classify as C
from tessella.functions import rules as R
from tessella.functions.columns import base_name, contains_any, glob_regex, lookup, parent, suffix


def files(df: DataFrame, path: str = "path", size: str = "size", content: str = "text") -> DataFrame:
    """The inventory: path, name, extension, size, hash, category, language and flags. Binary files and
    ignored paths are left out before anything is hashed."""
    p = F.col(path)
    kept = df.where(~C.ignored(p, R.IGNORED_DIRS, R.IGNORED_FILES) & ~suffix(base_name(p)).isin(*R.BINARY_SUFFIXES))
    return with_facts(kept, path, size, content)


def with_facts(df: DataFrame, path: str = "path", size: str = "size", content: str = "text") -> DataFrame:
    p, kind = F.col(path), C.category(F.col(path))
    name = base_name(p)
    return df.select(
        p.alias("path"),
        name.alias("name"),
        suffix(name).alias("extension"),
        F.col(size).cast("bigint").alias("size"),
        F.substring(F.sha2(F.col(content), 256), 1, 16).alias("hash"),
        kind.alias("category"),
        C.language(suffix(name)).alias("language"),
        (kind == "test").alias("is_test"),
        (kind == "config").alias("is_config"),
        (kind == "doc").alias("is_doc"),
        C.is_generated(p).alias("is_generated"),
        F.size(F.split(p, "/")).cast("bigint").alias("depth"),
    )


def stats(inv: DataFrame) -> DataFrame:
    """One row of counts, languages and depth, in one aggregation."""
    flag = lambda c: F.count_if(c)
    return inv.agg(
        F.count(F.lit(1)).alias("total_files"),
        flag(F.col("category") == "code").alias("code_files"),
        flag(F.col("is_test")).alias("test_files"),
        flag(F.col("is_config")).alias("config_files"),
        flag(F.col("is_doc")).alias("doc_files"),
        flag(F.col("is_generated")).alias("generated_files"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
        F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"),
    )


def entries_and_configs(inv: DataFrame) -> DataFrame:
    entry = inv.where(F.col("name").isin(*R.ENTRY_NAMES)).select("path", F.lit("entry").alias("role"), F.lit("main-like filename").alias("detail"))
    config = inv.where(F.col("name").isin(*R.CONFIG_KIND)).select("path", F.lit("config").alias("role"), lookup(F.col("name"), R.CONFIG_KIND).alias("detail"))
    return entry.unionByName(config)


def managers_and_frameworks(inv: DataFrame, by: list[str]) -> DataFrame:
    """Package managers and frameworks of each group of files (of all, without by), as booleans over names."""
    name, has = F.col("name"), lambda names: F.bool_or(F.col("name").isin(*names))
    aggregates = [has(names).alias(f"uses_{m}") for m, names in R.PACKAGE_MANAGERS]
    aggregates += [
        has(["next.config.js"]).alias("nextjs"),
        has(["vite.config.ts", "vite.config.js"]).alias("vite"),
        has(["manage.py"]).alias("django"),
        (F.bool_or(F.col("path").startswith("app/")) & F.bool_or(name == "package.json")).alias("frontend_app"),
    ]
    return inv.groupBy(*by).agg(*aggregates)


def lockfile_managers(inv: DataFrame) -> DataFrame:
    """Managers and monorepo tools that files at the top give away."""
    top = inv.where(~F.col("path").contains("/"))
    pairs = [(m, f) for m, f in R.LOCKFILE_MANAGERS + R.MONOREPO_TOOLS]
    return top.select(F.explode(F.filter(F.array(*[F.struct(F.lit(m).alias("tool"), F.lit(f).alias("file")) for m, f in pairs]), lambda x: x["file"] == F.col("name"))).alias("t")).select("t.tool").distinct()


def project_types(inv: DataFrame) -> DataFrame:
    """Project families by the files at the top."""
    top = inv.where(~F.col("path").contains("/"))
    tests = [F.when(_any_glob(F.col("name"), globs), F.lit(t)) for t, globs in R.PROJECT_MARKS]
    return top.select(F.explode(F.array_compact(F.array(*tests))).alias("project_type")).distinct()


def _any_glob(name, globs: list[str]):
    out = F.lit(False)
    for g in globs:
        out = out | (name.rlike(glob_regex(g)) if "*" in g else name == g)
    return out


def archetype(inv: DataFrame, content: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The first archetype whose rule holds: one row, or one for each project (the columns `by`) that has files.
    content: (path, text) of the manifests."""
    by = by or []
    manifests = content.where(F.col("path").isin(*R.MANIFESTS))
    needed = sorted({d for _, deps, _, _ in R.ARCHETYPES for d in deps} | set(R.LIBRARY_NOT))
    has = manifests.groupBy(*by).agg(*[F.coalesce(F.bool_or(C.dependency(F.col("text"), d)), F.lit(False)).alias(f"d_{i}") for i, d in enumerate(needed)], F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or((F.col("path") == "Cargo.toml") & F.col("text").contains("[[bin]]")), F.lit(False)).alias("bin"))
    places = sorted({x for _, _, some, none in R.ARCHETYPES for x in (*some, *none)} | {"lib/", "src/", "pages/", "app/"})
    there = inv.groupBy(*by).agg(*[F.coalesce(F.bool_or(F.col("path").startswith(x) if x.endswith("/") else F.col("path") == x), F.lit(False)).alias(f"p_{i}") for i, x in enumerate(places)])
    said = lambda c: F.coalesce(F.col(c), F.lit(False))
    dep, at = {d: said(f"d_{i}") for i, d in enumerate(needed)}, {x: F.col(f"p_{i}") for i, x in enumerate(places)}
    any_of = lambda cols: F.lit(False) if not cols else any_of(cols[1:]) | cols[0]
    out = F.lit(None).cast("string")
    rule = []
    for name, deps, some, none in R.ARCHETYPES:
        ok = any_of([dep[d] for d in deps] + [at[x] for x in some] + ([said("bin")] if name == "cli-tool" else []))
        for x in none:
            ok = ok & ~at[x]
        rule.append((ok, name))
    rule.append(((at["lib/"] | at["src/"]) & ~any_of([dep[d] for d in R.LIBRARY_NOT]) & (F.coalesce(F.col("n"), F.lit(0)) > 0) & ~at["pages/"] & ~at["app/"], "sdk-library"))
    for ok, name in rule[::-1]:
        out = F.when(ok, F.lit(name)).otherwise(out)
    met = there.join(has, by, "left") if by else has.crossJoin(there)
    return met.select(*by, F.coalesce(out, F.lit("generic")).alias("archetype"))


def extension_histogram(inv: DataFrame) -> DataFrame:
    return inv.where(F.col("extension").isin(*R.CODE_SUFFIXES)).groupBy("extension").agg(F.count(F.lit(1)).alias("files"))


def size_buckets(inv: DataFrame) -> DataFrame:
    """Counts by size; all four buckets appear."""
    bucket = C.size_bucket(F.col("size"))
    one = inv.agg(*[F.count_if(bucket == b).alias(b) for b in ("tiny", "small", "medium", "large")])
    return one.unpivot([], ["tiny", "small", "medium", "large"], "bucket", "files")


def language_rank(inv: DataFrame) -> DataFrame:
    """Languages by how many files they have; ties in the order of declaration."""
    place = {s: i for i, (_, own) in enumerate(R.LANGUAGE_SUFFIXES) for s in own}
    named = inv.select(lookup(F.col("extension"), place).alias("place")).where("place IS NOT NULL")
    return named.groupBy("place").agg(F.count(F.lit(1)).alias("files")).select(F.element_at(F.array(*[F.lit(n) for n, _ in R.LANGUAGE_SUFFIXES]), F.col("place") + 1).alias("language"), "files", "place")


def directories(inv: DataFrame) -> DataFrame:
    """Every folder that holds files at some depth, with its direct code files, subfolders and score."""
    folders = inv.select("path", F.col("extension").isin(*R.CODE_SUFFIXES).alias("code"), parent(F.col("path")).alias("folder"))
    direct = folders.where("folder <> ''").groupBy("folder").agg(F.count_if("code").alias("code_files"))
    chain = direct.select("folder", "code_files", F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.size(F.split("folder", "/"))), lambda n: F.array_join(F.slice(F.split("folder", "/"), 1, n), "/")), lambda x: x != "")).alias("path"))
    every = chain.groupBy("path").agg(F.sum(F.when(F.col("path") == F.col("folder"), F.col("code_files")).otherwise(0)).alias("file_count"))
    below = every.select(parent(F.col("path")).alias("path"), base_name(F.col("path")).alias("child")).where(~F.col("child").isin(*R.MORE_IGNORED_DIRS) & ~F.col("child").startswith(".")).groupBy("path").agg(F.count(F.lit(1)).alias("subs"))
    name = base_name(F.col("path"))
    n, subs = F.col("file_count"), F.coalesce("subs", F.lit(0))
    tenths = F.when(name.isin("src", "lib", "pkg", "cmd", "internal"), 4).otherwise(0) + F.when(contains_any(F.lower(name), ["core", "main", "engine", "kernel"]), 3).otherwise(0) + F.when(n > 5, 2).when(n > 0, 1).otherwise(0) + F.when(subs > 2, 1).otherwise(0)
    return every.join(below, "path", "left").select("path", name.alias("name"), n.alias("file_count"), subs.alias("subdirectory_count"), (F.least(tenths, F.lit(10)) / 10.0).alias("importance_score"))


def known_documents(inv: DataFrame) -> DataFrame:
    """Documents that match the known patterns, in the patterns' order."""
    patterns = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(glob_regex(g).replace(".*", "[^/]*")).alias("regex")) for i, g in enumerate(R.KNOWN_DOCS)])
    return inv.select("path", F.explode(F.filter(F.transform(patterns, lambda x: F.when(F.regexp_like(F.col("path"), x["regex"]), x["place"])), lambda x: x.isNotNull())).alias("place"))


def probed_entries(inv: DataFrame) -> DataFrame:
    """The usual entry files that exist, in their order."""
    place = {p: i for i, p in enumerate(R.PROBED_ENTRIES)}
    exact = inv.select("path", lookup(F.col("path"), place).alias("place")).where("place IS NOT NULL")
    folders = [p for p in R.PROBED_ENTRIES if "." not in base(p)]
    under = inv.select(F.explode(F.array_compact(F.array(*[F.when(F.col("path").startswith(p + "/"), F.lit(p)) for p in folders]))).alias("path")).distinct().select("path", lookup(F.col("path"), place).alias("place"))
    return exact.unionByName(under)


def base(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def top_level(inv: DataFrame) -> DataFrame:
    """Names at the top, each a folder or a file."""
    return inv.select(F.split("path", "/")[0].alias("name"), F.col("path").contains("/").alias("is_dir")).distinct()
