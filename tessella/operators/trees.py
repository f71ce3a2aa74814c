"""Trees of rows labelled by intervals: a node's number in pre-order, and the last number below it.

With the labels, order, subtree, depth and neighbours are predicates and sorts on rows; no section of a tree ever
lies in one row or one task. Sizes are summed from the deepest level up, numbers are given from the roots down, and
what stands before a node among its siblings is a prefix sum over blocks of places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.pages import neighbours
from tessella.scratch import materialise

#: Places (values of pos) of siblings whose sum is taken in one task.
BLOCK = 65_536


def before(df: DataFrame, keys: list[str], value: str, block: int = BLOCK) -> DataFrame:
    """df with `before`: the sum of value over the rows of the same keys with a smaller (pos, id)."""
    placed = df.withColumn("_block", F.floor(F.col("pos") / block))
    inside = Window.partitionBy(*keys, "_block").orderBy("pos", "id").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum")).select(*(F.col(k).alias(f"_of_{k}") for k in [*keys, "_block"]), F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_above"))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in [*keys, "_block"]]
    met = placed.withColumn("_within", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(sums, same)
    return met.select(*df.columns, (F.col("_within") + F.col("_above")).alias("before"))


def labelled(nodes: DataFrame, max_depth: int = 16) -> DataFrame:
    """nodes (tree, id, parent, pos and others; roots have no parent) with depth, first and last.

    A node's subtree is the rows of its tree whose first lies from its own first to its last. Siblings are in the order
    of pos, then id. Ids are expected to be unique within a tree; nodes that no root reaches are left out; a
    tree that is deeper than max_depth is an error.
    """
    levels = [materialise(nodes.where("parent IS NULL").withColumn("depth", F.lit(0)), "level")]
    while len(levels) <= max_depth:
        above = levels[-1].select("tree", F.col("id").alias("parent"))
        found = materialise(nodes.join(above, ["tree", "parent"], "left_semi").withColumn("depth", F.lit(len(levels))), "level")
        if found.isEmpty():
            break
        levels.append(found)
    else:
        raise ValueError(f"deeper than {max_depth} levels")
    sized: list[DataFrame] = []
    for level in levels[::-1]:
        below = sized[-1].groupBy("tree", F.col("parent").alias("id")).agg(F.sum("size").alias("below")) if sized else None
        done = level.join(below, ["tree", "id"], "left").withColumn("size", 1 + F.coalesce("below", F.lit(0))).drop("below") if sized else level.withColumn("size", F.lit(1).cast("bigint"))
        sized.append(materialise(done, "sizes"))
    out = None
    for n, level in enumerate(sized[::-1]):
        placed = before(level, ["tree", "parent"], "size")
        if n:
            placed = placed.join(above_first.select("tree", F.col("id").alias("parent"), F.col("first").alias("_parent")), ["tree", "parent"])
            placed = placed.withColumn("first", F.col("_parent") + 1 + F.col("before")).drop("_parent")
        else:
            placed = placed.withColumn("first", F.col("before"))
        above_first = materialise(placed.drop("before").withColumn("last", F.col("first") + F.col("size") - 1).drop("size"), "numbered")
        out = above_first if out is None else out.unionByName(above_first)
    return out


def subtree(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of labels at or below roots (tree, id), with the root as `of`."""
    tops = labels.join(roots.select("tree", "id"), ["tree", "id"], "left_semi").select(F.col("tree").alias("_tree"), F.col("id").alias("of"), F.col("first").alias("_first"), F.col("last").alias("_last"))
    return labels.join(tops, (labels["tree"] == tops["_tree"]) & labels["first"].between(tops["_first"], tops["_last"])).drop("_tree", "_first", "_last")


def leaf_neighbours(labels: DataFrame) -> DataFrame:
    """(tree, path, previous, next) of leaves (rows with a path) in the tree's order."""
    leaves = labels.where("path IS NOT NULL").select("tree", "path", F.lit(0).alias("section_pos"), F.col("first").alias("pos"), F.lit(False).alias("planned"))
    return neighbours(leaves, ["tree"])
