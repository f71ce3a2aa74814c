"""Graphs of files and modules: degrees, adjacency, density, components, visiting orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import classify as C
from tessella.functions import rules as R
from tessella.functions.columns import lookup
from tessella.scratch import discard, materialise


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.count(F.lit(1)).alias("in_degree")).withColumn("degree_score", F.least(F.col("in_degree") / F.lit(10.0), F.lit(1.0)))


def module_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges (src, dst) between files as edges between the modules of members (file, module), without loops."""
    a = members.select(F.col("file").alias("src"), F.col("module").alias("src_module"))
    b = members.select(F.col("file").alias("dst"), F.col("module").alias("dst_module"))
    return edges.join(a, "src").join(b, "dst").where("src_module <> dst_module")


def adjacency(edges: DataFrame, members: DataFrame) -> DataFrame:
    return module_edges(edges, members).groupBy("src_module", "dst_module").agg(F.count(F.lit(1)).alias("imports"))


def density(adj: DataFrame, members: DataFrame, merge_above: float = 0.5) -> DataFrame:
    """For each unordered pair of modules with imports: both counts, the density, and whether merging is suggested."""
    sizes = members.groupBy("module").agg(F.count(F.lit(1)).alias("files"))
    pairs = adj.groupBy(F.least("src_module", "dst_module").alias("module_a"), F.greatest("src_module", "dst_module").alias("module_b")).agg(
        F.sum(F.when(F.col("src_module") < F.col("dst_module"), F.col("imports")).otherwise(0)).alias("a_to_b"),
        F.sum(F.when(F.col("src_module") > F.col("dst_module"), F.col("imports")).otherwise(0)).alias("b_to_a"),
    )
    out = pairs.join(sizes.select(F.col("module").alias("module_a"), F.col("files").alias("fa")), "module_a").join(sizes.select(F.col("module").alias("module_b"), F.col("files").alias("fb")), "module_b")
    d = (F.col("a_to_b") + F.col("b_to_a")) / (F.col("fa") + F.col("fb"))
    return out.select("module_a", "module_b", "a_to_b", "b_to_a", d.alias("density"), ((d > merge_above) & (F.col("a_to_b") > 0) & (F.col("b_to_a") > 0)).alias("merge"))


def dependency_hints(edges: DataFrame, members: DataFrame) -> DataFrame:
    """For each module those it imports and those it is imported by."""
    pairs = module_edges(edges, members).select("src_module", "dst_module").distinct()
    both = pairs.select(F.col("src_module").alias("module"), F.col("dst_module").alias("imports"), F.lit(None).cast("string").alias("imported_by")).unionByName(pairs.select(F.col("dst_module").alias("module"), F.lit(None).cast("string").alias("imports"), F.col("src_module").alias("imported_by")))
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return both.groupBy("module").agg(joined("imports").alias("imports"), joined("imported_by").alias("imported_by"))


def of_module(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges that leave the given files, and those of other files that lead to them."""
    out = edges.join(files.select(F.col("file").alias("src")), "src", "left_semi").withColumn("direction", F.lit("out"))
    into = edges.join(files.select(F.col("file").alias("dst")), "dst", "left_semi").join(files.select(F.col("file").alias("src")), "src", "left_anti").withColumn("direction", F.lit("in"))
    return out.unionByName(into)


def call_graph_of(calls: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of a call graph whose name is among the given files; names are functions, so in practice none."""
    return calls.join(files.select(F.col("file").alias("qname")), "qname", "left_semi")


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over edges (src, dst) taken both ways. Large-star and
    small-star rounds, of which a logarithmic number suffices; an error if they don't settle. Each round's
    stars are written and read again, and the round's before deleted."""
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    stars = materialise(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct(), "stars")
    before = state(stars)
    for _ in range(max_rounds):
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(low, "u")
        done, stars = stars, materialise(met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(met.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars")
        discard(done)
        if (after := state(stars)) == before:
            break
        before = after
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return nodes.select("node").distinct().join(stars.select(F.col("u").alias("node"), F.col("v").alias("c")), "node", "left").select("node", F.coalesce("c", "node").alias("component"))


def internal_components(members: DataFrame, edges: DataFrame, split_below: float = 0.5) -> DataFrame:
    """For each module the connected parts of its files, and whether splitting is suggested."""
    a = members.select(F.col("file").alias("src"), F.col("module").alias("ma"))
    b = members.select(F.col("file").alias("dst"), F.col("module").alias("mb"))
    inside = edges.join(a, "src").join(b, "dst").where("ma = mb").select("src", "dst")
    found = components(members.select(F.col("file").alias("node")), inside)
    sizes = found.join(members.select(F.col("file").alias("node"), "module"), "node").groupBy("module", "component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("module").agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"), F.sum("n").alias("files")).withColumn("split", F.col("largest") < F.col("files") * F.lit(split_below))


def visits(calls: DataFrame, starts: DataFrame, max_depth: int = R.MAX_DEPTH, nodes: DataFrame | None = None) -> DataFrame:
    """(start, node, depth, ord): breadth-first order from each start over calls (src, pos, dst), as a queue gives
    it: by the visit order of the caller, then by the place of the call. One join a level. nodes: (node) what is
    known, without it whatever calls something; only known nodes are visited."""
    known = materialise((calls.select(F.col("src").alias("node")) if nodes is None else nodes.select("node")).distinct(), "known")
    edges = materialise(calls.join(known.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "pos", "dst"), "calls")
    seen = materialise(starts.select(F.col("start"), F.col("start").alias("node")).join(known, "node", "left_semi").select("start", "node", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("ord")), "seen")
    frontier = seen
    for depth in range(1, max_depth + 1):
        reach = frontier.join(edges, frontier["node"] == edges["src"]).select("start", F.col("dst").alias("node"), F.struct("ord", "pos").alias("at"))
        fresh = reach.groupBy("start", "node").agg(F.min("at").alias("at")).join(seen, ["start", "node"], "left_anti")
        counted = seen.groupBy("start").agg(F.count(F.lit(1)).alias("base"))
        w = Window.partitionBy("start").orderBy("at")
        frontier = materialise(fresh.join(counted, "start").select("start", "node", F.lit(depth).alias("depth"), (F.col("base") + F.row_number().over(w) - 1).alias("ord")), "frontier")
        if frontier.isEmpty():
            break
        seen = materialise(seen.unionByName(frontier), "seen")
    return seen


def sequences(visited: DataFrame) -> DataFrame:
    """Steps (start, ord, src, dst) between consecutive visits."""
    w = Window.partitionBy("start").orderBy("ord")
    return visited.select("start", "ord", F.col("node").alias("src"), F.lead("node").over(w).alias("dst")).where("dst IS NOT NULL")


def participants(visited: DataFrame) -> DataFrame:
    """The first parts of visited names in order of their first visit."""
    first = visited.groupBy("start", F.split("node", r"\.")[0].alias("participant")).agg(F.min("ord").alias("ord"))
    return first.groupBy("start").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "participant"))), lambda x: x["participant"]), ",").alias("participants"))


def entry_handlers(entries: DataFrame, calls: DataFrame) -> DataFrame:
    """(name, handler): the file's stem if it is a known function, else the first usual name that calls something,
    else the first known name that contains the stem and calls something, else the stem."""
    busy = calls.where(F.size("calls") > 0).select("qname")
    usual = busy.where(F.col("qname").isin(*R.HANDLER_NAMES)).select(F.min_by("qname", lookup(F.col("qname"), {n: i for i, n in enumerate(R.HANDLER_NAMES)})).alias("usual"))
    e = entries.select("name", F.regexp_extract("name", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("stem"))
    exact = e.join(calls.select(F.col("qname").alias("stem"), F.lit(True).alias("known")), "stem", "left")
    # A stem lies within a name if it is one of the name's parts of that length: an equality join, for the few lengths that stems have.
    sizes = sorted(r[0] for r in e.select(F.length("stem")).distinct().collect())
    cut = lambda n: F.when(F.length("qname") >= n, F.transform(F.sequence(F.lit(1), F.length("qname") - n + 1), lambda i: F.substring(F.lower("qname"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    parts = busy.select("qname", F.explode(F.array_distinct(F.flatten(F.array(*map(cut, sizes))))).alias("low")) if sizes else busy.select("qname", F.lit("").alias("low"))
    part = e.join(parts, F.lower("stem") == F.col("low")).groupBy("name").agg(F.min("qname").alias("part"))
    return exact.join(part, "name", "left").crossJoin(F.broadcast(usual)).select("name", F.when(F.col("known"), F.col("stem")).otherwise(F.coalesce("usual", "part", "stem")).alias("handler"))


def primary_purpose(files: DataFrame) -> DataFrame:
    """(module, purpose): of the purposes of a module's files the first in priority; pages and widgets count as other."""
    place = {p: i for i, p in enumerate(R.PURPOSE_ORDER)}
    ranked = files.select("module", F.coalesce(lookup(C.code_purpose(F.col("file")), place), F.lit(len(place) - 1)).alias("p"))
    names = F.array(*map(F.lit, R.PURPOSE_ORDER))
    return ranked.groupBy("module").agg(F.min("p").alias("p")).select("module", F.element_at(names, F.col("p") + 1).alias("purpose"))


def layers(purposes: DataFrame) -> DataFrame:
    """Modules by architecture layer; tests belong to none."""
    order = {n: i for i, (n, _) in enumerate(R.LAYERS)}
    own = purposes.select(C.layer(F.col("purpose")).alias("layer"), "module").where("layer IS NOT NULL")
    return own.groupBy("layer").agg(F.array_join(F.sort_array(F.collect_list("module")), ",").alias("modules"), F.count(F.lit(1)).alias("n")).withColumn("place", lookup(F.col("layer"), order))


def dominant(groups: DataFrame) -> DataFrame:
    """(group, purpose): the most frequent purpose of a group's modules; ties to the first by name."""
    n = groups.groupBy("group", "purpose").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("group").agg(F.min_by("purpose", F.struct((-F.col("n")).alias("n"), F.col("purpose"))).alias("purpose"), F.max("n").alias("n"))


def cross_groups(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct dependencies between groups of modules."""
    a = groups.select(F.col("module").alias("src_module"), F.col("group").alias("from"))
    b = groups.select(F.col("module").alias("dst_module"), F.col("group").alias("to"))
    return edges.join(a, "src_module").join(b, "dst_module").where("from <> to").select("from", "to").distinct()


def bidirectional(pairs: DataFrame) -> DataFrame:
    """Unordered pairs of sections that occur twice or more among (src, dst)."""
    return pairs.where("src <> dst").groupBy(F.least("src", "dst").alias("section_a"), F.greatest("src", "dst").alias("section_b")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("section_a", "section_b")


def split_modules(inv: DataFrame, root: str, max_depth: int = 8) -> DataFrame:
    """Modules (path, files) below a folder: folders split while two children or more have code, down to max_depth.

    One pass over each file's chain of folders, then a level at a time over folders alone.
    """
    from tessella.functions.columns import ancestors, parent

    code = inv.where(F.col("extension").isin(*R.CODE_SUFFIXES) & F.col("path").startswith(root + "/"))
    folders = code.select(F.explode(ancestors(parent(F.col("path")))).alias("path")).where((F.col("path") == root) | F.col("path").startswith(root + "/")).groupBy("path").agg(F.count(F.lit(1)).alias("files"))
    children = folders.groupBy(parent(F.col("path")).alias("path")).agg(F.count(F.lit(1)).alias("children"))
    depth: Column = F.size(F.split("path", "/"))
    known = materialise(folders.join(children, "path", "left").withColumn("splits", (F.coalesce("children", F.lit(0)) >= 2) & (depth < max_depth)), "folders")
    level = known.where(F.col("path") == root)
    done = None
    for _ in range(max_depth + 1):
        leaf = level.where(~F.col("splits")).select("path", "files")
        done = leaf if done is None else done.unionByName(leaf)
        up = level.where("splits").select(F.col("path").alias("above"))
        level = materialise(known.join(up, parent(known["path"]) == up["above"], "left_semi"), "level")
        if level.isEmpty():
            break
    return done


def expand_container(inv: DataFrame, folder: str) -> DataFrame:
    """An application folder as its entry files and the modules of its subfolders (path, kind, files)."""
    from tessella.functions.columns import base_name, parent

    entry = inv.where((parent(F.col("path")) == folder) & base_name(F.col("path")).isin(*R.ENTRY_FILES)).select("path", F.lit("core").alias("kind"), F.lit(1).cast("bigint").alias("files"))
    inner = split_modules(inv, folder).where(F.col("path") != folder).select("path", C.module_kind(base_name(F.col("path"))).alias("kind"), "files")
    return entry.unionByName(inner)
