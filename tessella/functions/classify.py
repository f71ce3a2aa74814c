"""Classification of files, modules and documents by fixed rules (scalar columns, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import rules as R
from tessella.functions.columns import base_name, contains_any, glob_regex, ladder, lookup, slug, stem, suffix


def is_test(path: Column) -> Column:
    return contains_any(F.concat(F.lit("/"), path), R.TEST_MARKS)


def is_generated(path: Column) -> Column:
    return contains_any(F.concat(F.lit("/"), path), R.GENERATED_MARKS)


def language(ext: Column) -> Column:
    return lookup(ext, R.LANGUAGE_OF)


def category(path: Column) -> Column:
    """test, config, doc, code, asset, data or other; the first that applies."""
    name = base_name(path)
    ext = suffix(name)
    return ladder([(is_test(path), "test"), (name.isin(*R.CONFIG_KIND), "config"), (ext.isin(*R.DOC_SUFFIXES), "doc"), (ext.isin(*R.LANGUAGE_OF), "code"), (ext.isin(*R.BINARY_SUFFIXES), "asset"), (ext.isin(*R.DATA_SUFFIXES), "data")], "other")


def ignored(path: Column, dirs: list[str], names: list[str]) -> Column:
    """Whether any part of a relative path, or its name, is left out."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, dirs))) | base_name(path).isin(*names)


def ignored_by(path: Column, literals: list[str], globs: list[str]) -> Column:
    """Literal rules hold for any part of a path, globs for its name.

    Rules are looked up in sets, of parts, of names, and of beginnings and ends of each length that rules have; what
    is left is one pattern. So the cost doesn't grow with the number of rules, but for globs of other forms.
    """
    name, out = base_name(path), F.lit(False)
    if literals:
        out = out | F.exists(F.split(path, "/"), lambda p: p.isin(*literals))
    whole, heads, tails, other = glob_sets(globs)
    if whole:
        out = out | name.isin(*whole)
    for size, own in heads.items():
        out = out | F.left(name, F.lit(size)).isin(*own)
    for size, own in tails.items():
        out = out | F.right(name, F.lit(size)).isin(*own)
    return out | name.rlike("|".join(f"(?:{glob_regex(g)})" for g in other)) if other else out


def glob_sets(globs: list[str]) -> tuple[list[str], dict[int, list[str]], dict[int, list[str]], list[str]]:
    """Globs as whole names, beginnings by length, ends by length, and those of other forms."""
    whole, heads, tails, other = [], {}, {}, []
    for g in dict.fromkeys(globs):
        wild = [c for c in g if c in "*?["]
        if not wild:
            whole.append(g)
        elif wild == ["*"] and len(g) > 1 and g[-1] == "*":
            heads.setdefault(len(g) - 1, []).append(g[:-1])
        elif wild == ["*"] and len(g) > 1 and g[0] == "*":
            tails.setdefault(len(g) - 1, []).append(g[1:])
        else:
            other.append(g)
    return whole, heads, tails, other


def code_purpose(path: Column) -> Column:
    low = F.lower(path)
    return ladder([(contains_any(low, marks), name) for name, marks in R.PURPOSES], "Other")


def layer(purpose: Column) -> Column:
    return ladder([(purpose.isin(*own), name) for name, own in R.LAYERS], None)


def module_kind(name: Column) -> Column:
    low = F.lower(name)
    return ladder([(contains_any(low, marks), kind) for kind, marks in R.MODULE_KINDS], "module")


def size_bucket(size: Column) -> Column:
    return ladder([(size < 1024, "tiny"), (size < 10240, "small"), (size < 51200, "medium")], "large")


def analysis_depth(complexity: Column, important_lines: Column, purpose: Column, workspace: Column) -> Column:
    return ladder([((complexity >= 30) | (important_lines >= 20), "deep"), ((complexity >= 15) | (important_lines >= 8) | purpose.isin(*R.STANDARD_PURPOSES) | workspace, "standard")], "quick")


def token_cost(size: Column, ext: Column) -> Column:
    """Estimated tokens of a file: at least 100, 200 for one that is missing (null size)."""
    return F.when(size.isNull(), F.lit(200).cast("bigint")).otherwise(F.greatest(F.floor(size / lookup(ext, R.TOKEN_RATIOS, 4)), F.lit(100).cast("bigint")))


def page_type(purpose: Column) -> Column:
    return F.when(F.coalesce(purpose, F.lit("")).isin(*R.INTERNAL_PURPOSES), "internal").otherwise("capability")


def monorepo(path: Column) -> Column:
    """struct(package, slug): the part after the first workspace folder that has one after it, and what follows it."""
    parts = F.split(path, "/")
    hits = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: F.lower(F.element_at(parts, i)).isin(*R.MONOREPO_DIRS) & (i < F.size(parts)))
    at = F.try_element_at(hits, F.lit(1))
    package = F.when(at.isNotNull(), F.element_at(parts, at + 1))
    rest = F.slice(parts, at + 2, F.greatest(F.size(parts) - at - 1, F.lit(0)))
    rest = F.when(F.lower(F.try_element_at(rest, F.lit(1))).isin("src", "lib"), F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest)
    own = F.when(F.size(rest) > 0, slug(F.array_join(rest, "-"))).otherwise(slug(package))
    return F.struct(F.coalesce(package, F.lit("")).alias("package"), F.when(at.isNull(), "").otherwise(own).alias("slug"))


def safe_markdown_path(path: Column) -> Column:
    return ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..") & (suffix_exact(path) == ".md")


def suffix_exact(path: Column) -> Column:
    return F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)$", 1)


def change_type(status: Column, path: Column, text: Column) -> Column:
    return ladder([(status == "added", "new"), (status == "deleted", "deleted"), (suffix_exact(path).isin(*R.TEXT_DOC_SUFFIXES), "doc-only-change"), (contains_any(F.coalesce(text, F.lit("")), R.API_MARKS), "api-change")], "impl-change")


def doc_type(path: Column) -> Column:
    name = F.lower(stem(base_name(path)))
    folder = F.lower(F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit("")))
    return ladder([(name.isin("overview", "index"), "overview"), (name.isin("getting-started", "quickstart"), "getting-started"), (folder == "reference", "reference")], "module")


def page_id_of(path: Column) -> Column:
    """The page id of a document's path within the wiki."""
    own = stem(base_name(path))
    return F.when(path.isin("overview.md", "getting-started.md", "doc-map.md"), F.regexp_replace(path, r"\.md$", "")).when(path.startswith("deep-dive/"), F.concat(F.lit("deep-dive:"), own)).when(path.startswith("concepts/"), F.concat(F.lit("concept:"), own)).when(path.startswith("reference/"), F.concat(F.lit("reference:"), own)).otherwise(own)


def external_link(target: Column) -> Column:
    return F.lower(target).rlike(r"^(https?|mailto):")


def valid_range(start: Column, end: Column) -> Column:
    return F.coalesce((start >= 1) & (end >= start), F.lit(False))


def dependency(text: Column, name: str) -> Column:
    """Whether a manifest's text names a dependency as a token of its own."""
    import re

    return F.lower(text).rlike(rf"(?<![.\w-]){re.escape(name.lower())}(?![.\w-])")
