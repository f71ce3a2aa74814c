"""Operators that work on a wiki as a tree of Markdown files: places, menus from folders or a topology, lookups."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import rules as R
from tessella.functions import text as T
from tessella.functions.columns import ancestors, base_name, normal_path, parent, stem

#: Folders of knowledge and labels of sections, in menu order.
KNOWLEDGE = ["concepts", "deep-dive", "reference"]
LABELS = {"zh": ["概览", "理解项目", "深入理解", "参考资料", "更多"], "en": ["Overview", "Concepts", "Deep Dive", "Reference", "More"]}
OVERVIEW = ["overview.md", "getting-started.md", "doc-map.md"]


def wiki_root(spark: SparkSession, root: str) -> str:
    """Where a project's wiki lies: the folder itself if it is called so, else the state folder's, else wiki/, else the root."""
    from tessella.sources.sinks import exists

    root = root.rstrip("/")
    if root.rsplit("/", 1)[-1] == "wiki":
        return root
    return next((p for p in (f"{root}/.tessella/wiki", f"{root}/wiki") if exists(spark, p)), root)


def documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of a project's Markdown documents."""
    from tessella.sources.tree import read_tree

    return read_tree(spark, wiki_root(spark, root)).where(F.col("path").endswith(".md")).select("path", "text")


def menu_from_folders(docs: DataFrame, language: str = "zh") -> DataFrame:
    """(section_pos, section, group, pos, title, path) of documents (path, text): overview pages, a section a folder
    of knowledge, and a last one with other top-level pages and other folders as groups."""
    labels = LABELS[language]
    folder, name = parent(F.col("path")), base_name(F.col("path"))
    place = F.array_position(F.array(*map(F.lit, OVERVIEW)), F.col("path")).cast("int")
    known = F.array_position(F.array(*map(F.lit, KNOWLEDGE)), folder).cast("int")
    d = docs.where(~folder.contains("/") & F.col("path").endswith(".md")).select("path", "text", folder.alias("folder"), name.alias("name"), place.alias("place"), known.alias("known"))
    d = d.where(~((F.col("known") > 0) & F.col("name").isin("index.md", "_index.md")) & ~F.col("folder").rlike("^[._]") & (F.col("folder") != "assets"))
    section = F.when(F.col("place") > 0, 0).when(F.col("known") > 0, F.col("known")).otherwise(len(KNOWLEDGE) + 1)
    heading = F.trim(F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1))
    title = F.when(heading != "", heading).when(F.col("place") > 0, T.title_of(F.col("text"), stem(F.col("name")))).otherwise(stem(F.col("name")))
    group = F.when(section == len(KNOWLEDGE) + 1, F.when(F.col("folder") == "", "其他" if language == "zh" else "Other").otherwise(F.col("folder")))
    return d.select(section.alias("section_pos"), F.element_at(F.array(*map(F.lit, labels)), section + 1).alias("section"), group.alias("group"), F.when(F.col("place") > 0, F.lpad(F.col("place").cast("string"), 9, "0")).otherwise(F.col("name")).alias("pos"), title.alias("title"), "path")


def nest(menu: DataFrame) -> DataFrame:
    """(section_pos, section, items) of a flat menu: items are pages (title, path) and, after them, groups with pages
    of their own. A section is one row: a menu is a document, which somebody is to read."""
    page = F.struct("pos", "title", "path")
    strip = lambda xs: F.transform(F.array_sort(xs), lambda x: F.struct(x["title"].alias("title"), x["path"].alias("path")))
    own = menu.groupBy("section_pos", "section", "group").agg(strip(F.collect_list(page)).alias("pages"))
    none = F.array().cast("array<struct<title:string,path:string>>")
    single = F.transform("pages", lambda x: F.struct(x["title"].alias("title"), x["path"].alias("path"), none.alias("pages")))
    grouped = F.array(F.struct(F.col("group").alias("title"), F.lit(None).cast("string").alias("path"), F.col("pages").alias("pages")))
    made = own.select("section_pos", "section", F.coalesce("group", F.lit("")).alias("g"), F.when(F.col("group").isNull(), single).otherwise(grouped).alias("items"))
    return made.groupBy("section_pos", "section").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("g", "items"))), lambda x: x["items"])).alias("items"))


def walk(nested: DataFrame) -> DataFrame:
    """(section, depth, title, path) of every node of nested sections: items at depth one, a group's pages at two."""
    items = nested.select("section", F.inline("items"))
    below = items.select("section", F.explode("pages").alias("p")).select("section", F.lit(2).alias("depth"), "p.title", "p.path")
    return items.select("section", F.lit(1).alias("depth"), "title", "path").unionByName(below)


def menu_from_topology(groupings: DataFrame, pages: DataFrame) -> DataFrame:
    """(section_pos, section, group, pos, title, path) of groupings (section_pos, section, group, pos, page_id) joined with
    pages (id, title, output_path); ids without a page go, paths lose their wiki/ prefix."""
    own = pages.select(F.col("id").alias("page_id"), "title", F.regexp_replace("output_path", "^wiki/", "").alias("path"))
    return groupings.join(own, "page_id").select("section_pos", "section", "group", "pos", "title", "path")


def resolve_sources(references: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """(reference, file) for references in any usual form: absolute, relative, file addresses, encoded; the first of the
    forms that exists among files (file, relative to root)."""
    plain = F.url_decode(F.regexp_replace(F.regexp_replace(F.trim("reference"), "(?i)^file://", ""), r"\+", "%2B"))
    plain = F.regexp_replace(plain, r"^/([A-Za-z]:)", "$1")
    inside = F.regexp_replace(plain, f"^\\Q{root.rstrip('/')}\\E/+", "")
    tries = F.array(normal_path(inside), normal_path(F.regexp_replace(plain, r"^[/\\]+", "")))
    found = references.select("reference", F.posexplode(tries).alias("tier", "file")).join(files.select("file"), "file").groupBy("reference").agg(F.min_by("file", "tier").alias("file"))
    return references.join(found, "reference", "left").select("reference", "file")


def folder_tree(files: DataFrame, max_depth: int = 5) -> DataFrame:
    """(folder, name, is_file, files) of a tree's listing, folders first, to a depth: a roll-up over path prefixes."""
    nodes = files.select(F.explode(ancestors(F.col("path"))).alias("node"), "path").where(F.size(F.split("node", "/")) <= max_depth)
    one = nodes.groupBy("node").agg(F.bool_or(F.col("node") == F.col("path")).alias("is_file"), F.count(F.lit(1)).alias("files"))
    return one.select(parent(F.col("node")).alias("folder"), base_name(F.col("node")).alias("name"), "is_file", "files").orderBy("folder", "is_file", F.lower("name"))


def workspaces(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """(folder) of workspace packages: from package.json's list or object and a workspace list with '/*' (YAML items), if
    the folder exists; else packages/ and apps/. manifests: (path, text). files: (path)."""
    text, listed = F.col("text"), "array<string>"
    parsed = F.coalesce(F.from_json(F.get_json_object(text, "$.workspaces.packages"), listed), F.from_json(F.get_json_object(text, "$.workspaces"), listed))
    yaml = F.regexp_extract_all(text, F.lit(r"""(?m)^\s*-\s*['"]?([^'"\n#]+?)['"]?\s*$"""), F.lit(1))
    stated = manifests.where(F.col("path").isin("package.json", "pnpm-workspace.yaml")).select(F.explode(F.when(F.col("path") == "package.json", F.coalesce(parsed, F.array().cast(listed))).otherwise(yaml)).alias("p")).where(F.col("p").contains("/*")).select(F.trim(F.regexp_replace("p", r"/\*+", "")).alias("folder"))
    implied = manifests.sparkSession.createDataFrame([("packages",), ("apps",)], "folder string")
    there = files.select(F.explode(ancestors(parent(F.col("path")))).alias("folder")).distinct()
    real = stated.distinct().join(there, "folder", "left_semi").withColumn("stated", F.lit(True)).unionByName(implied.join(there, "folder", "left_semi").withColumn("stated", F.lit(False)))
    return real.groupBy("folder").agg(F.bool_or("stated").alias("stated"))


def file_data(tables: list[DataFrame], key: str = "path") -> DataFrame:
    """Rows of several tables with equal columns, of each key that of the first table that has it."""
    whole = None
    for i, t in enumerate(tables):
        own = t.withColumn("_tier", F.lit(i))
        whole = own if whole is None else whole.unionByName(own)
    rest = [c for c in tables[0].columns if c != key]
    return whole.groupBy(key).agg(F.min_by(F.struct(*rest), "_tier").alias("r")).select(key, "r.*")


def cached_or_parsed(files: DataFrame, cache: DataFrame, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """(what the cache holds for files, files that it lacks and that are to be parsed)."""
    return files.join(cache, key), files.join(cache.select(key), key, "left_anti")


def front_matter(text: Column) -> Column:
    """The 'key: value' pairs between a text's opening '---' lines, as a map."""
    head = F.regexp_extract(text, r"(?s)\A---\s*\n(.*?)\n---", 1)
    pairs = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^\s*[\w-]+\s*:"))
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^\s*([\w-]+)\s*:", 1)), F.regexp_replace(F.regexp_extract(x, r"^\s*[\w-]+\s*:(.*)$", 1), r"^\s+|\s+$", ""))))


def local_links(text: Column) -> Column:
    """Link targets that are neither anchors, addresses, mail nor templates."""
    return F.filter(T.found(text, T.LINK, 2), lambda x: ~x.startswith("#") & ~x.contains("://") & ~x.startswith("mailto:") & ~x.contains("{"))


def only_keys(map_: Column, keys: list[str]) -> Column:
    return F.map_filter(map_, lambda k, _: k.isin(*keys))


def without_keys(map_: Column, keys: list[str]) -> Column:
    return F.map_filter(map_, lambda k, _: ~k.isin(*keys))


def components_of(pages: DataFrame) -> DataFrame:
    """pages (page_type among others) with the components that their type requires and recommends (arrays, empty
    for types without a rule), from the small fixed table, as a lookup without a join."""
    table = lambda i: F.create_map(*[x for k, v in R.PAGE_PROFILES.items() for x in (F.lit(k), F.array(*map(F.lit, v[i])))])
    own = lambda i: F.coalesce(F.try_element_at(table(i), F.col("page_type")), F.array().cast("array<string>"))
    return pages.withColumns({"required": own(0), "recommended": own(1)})


def reconcile_dependencies(parsed: DataFrame, hinted: DataFrame) -> DataFrame:
    """(src, dst, verdict) of edges found by parsing and edges that an analysis hints at. A parsed edge always stays:
    confirmed if it is hinted at, conflict if only its reverse is, parsed_only otherwise. A hint without an edge of
    either direction stays as hinted_only; one that conflicts goes."""
    a, b = parsed.select("src", "dst", F.lit(True).alias("p")).distinct(), hinted.select("src", "dst", F.lit(True).alias("h")).distinct()
    turned = lambda t, name: t.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias(name))
    both = a.join(b, ["src", "dst"], "full_outer").join(turned(b, "rh"), ["src", "dst"], "left").join(turned(a, "rp"), ["src", "dst"], "left")
    verdict = F.when(F.col("p") & F.col("h"), "confirmed").when(F.col("p") & F.col("rh"), "conflict").when(F.col("p"), "parsed_only").when(F.col("rp").isNull(), "hinted_only")
    return both.select("src", "dst", verdict.alias("verdict")).where("verdict IS NOT NULL")


def initial_layouts(projects: DataFrame) -> DataFrame:
    """(path, text) of what new wikis begin with. projects: (root, name)."""
    files = {"config.yaml": F.lit("exclude: []\nlanguage: zh\n"), "meta.json": F.to_json(F.struct(F.col("name").alias("project_name"), F.lit(1).alias("cache_schema_version"))), "wiki/overview.md": F.concat(F.lit("# "), F.col("name"), F.lit("\n"))}
    return projects.select(F.inline(F.array(*(F.struct(F.concat("root", F.lit(f"/{p}")).alias("path"), t.alias("text")) for p, t in files.items()))))


def initial_files(name: str) -> dict[str, str]:
    """What a new wiki begins with: path to content."""
    return {".tessella/config.yaml": "exclude: []\nlanguage: zh\n", ".tessella/meta.json": json.dumps({"project_name": name, "cache_schema_version": 1}), ".tessella/wiki/overview.md": f"# {name}\n"}
