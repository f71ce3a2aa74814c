"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

Each input partition is a run: its documents' digests, sorted and reduced to one entry a digest. Runs
merge in rounds of a binomial tree. In round k the runs whose numbers agree after division by
``fan_in**k`` are partners: together they are cut into ``fan_in**k`` slices of equal width by the first
bits of the digest (SHA-256 is uniform, so no sample is needed), and every slice has a task of its own.
An exchange by place hands each partner's part of a slice to that task; there the parts are put in one
order and merged by a streaming aggregate over sorted entries, which holds one digest at a time and
keeps its best row and its count. The number of tasks thus stays that of the runs in every round, and
the entries leave each round as sorted runs again. With the default fan-in of two the rounds are those
of recursive halving; a larger one takes fewer rounds. Every few rounds the runs are written, so that
a lost executor costs no more than those.

The root's decisions travel back through (run, digest), so that a group of copies that holds a third
of all rows is met as at most one entry a run on every exchange, and its rows stay spread over their
runs.

An entry is a text's SHA-256, a second hash of 64 bits and its length in bytes; entries merge only
if all three agree, which verifies each retained identifier at every level.

Cases: a null text equals the empty text. A null id loses against any other id. Of repeated rows
(same id and text) exactly one is kept. An empty table gives an empty result. Columns other than id
and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.store import fresh, materialise, text_or_empty, within, without

KEY = ["_sha", "_xx", "_len"]
#: Rounds after which the runs are written.
ROUNDS_A_WRITE = 4


def _entry(text_col: str) -> list:
    text = text_or_empty(text_col)
    return [F.unhex(F.sha2(text, 256)).alias("_sha"), F.xxhash64(text).alias("_xx"), F.octet_length(text).alias("_len")]


def digest_runs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a document: id, its run and row number, and the entry of its text."""
    return df.select(
        F.col(id_col).alias("_id"),
        F.spark_partition_id().alias("_run"),
        F.monotonically_increasing_id().alias("_row"),
        *_entry(text_col),
    )


def slice_of(sha: Column, slices: int) -> Column:
    """Which of so many slices of equal width a digest lies in, by its first 32 bits."""
    lead = F.conv(F.hex(F.substring(sha, 1, 4)), 16, 10).cast("bigint")
    return F.shiftright(lead * F.lit(slices), 32).cast("int")


def merged(placed: DataFrame, best, slots: int) -> DataFrame:
    """Entries (_slot, KEY, _best, _n) brought to their slots, in order there, and merged digest by digest.

    Best rows are structs, which Spark aggregates in a stream over sorted rows; the exchange is by the
    slot itself, so the aggregate needs no other.
    """
    ordered = placed.repartitionById(slots, F.col("_slot")).sortWithinPartitions("_slot", *KEY)
    return ordered.groupBy("_slot", *KEY).agg(best("_best").alias("_best"), F.sum("_n").alias("_n"))


def merge_rounds(runs: DataFrame, n_runs: int, keep: str, fan_in: int) -> DataFrame:
    """Merges runs of (_run, KEY, _best, _n) until one is left: (KEY, _best, _n), in sorted slices."""
    best = F.max if keep == "max" else F.min
    left, slices, turn = n_runs, 1, 0
    runs = runs.withColumnRenamed("_run", "_slot")
    while left > 1:
        own = F.expr(f"_slot div {slices * fan_in}").cast("int")
        left, slices, turn = -(-left // fan_in), slices * fan_in, turn + 1
        runs = merged(runs.withColumn("_slot", own * slices + slice_of(F.col("_sha"), slices)), best, left * slices)
        if turn % ROUNDS_A_WRITE == 0 and left > 1:
            runs = materialise(runs, "merged")
    return runs.drop("_slot")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fan_in: int = 2) -> DataFrame:
    """One row a document: id_col, keep_id, group_size, kept, text_sha256 (hex).

    keep: whether the smallest or the largest id of a group of equal texts stays.
    """
    if keep not in ("min", "max") or fan_in < 2:
        raise ValueError("keep is min or max, fan_in at least 2")
    leaf = materialise(digest_runs(df, id_col, text_col), "digests")
    n_runs = (leaf.agg(F.max("_run")).first()[0] or 0) + 1
    # A null id loses: nulls sort first, so for min a flag goes ahead of the id.
    ranked = F.struct(F.col("_id").isNull().alias("void") if keep == "min" else F.col("_id").isNotNull().alias("void"), "_id", "_row")
    rows = leaf.select(F.col("_run").alias("_slot"), *KEY, ranked.alias("_best"), F.lit(1).cast("bigint").alias("_n"))
    runs = materialise(merged(rows, F.max if keep == "max" else F.min, n_runs).withColumnRenamed("_slot", "_run"), "runs")
    root = merge_rounds(runs, n_runs, keep, fan_in)
    decided = runs.select("_run", *KEY).join(root, KEY)
    return leaf.join(decided, ["_run", *KEY]).select(
        F.col("_id").alias(id_col),
        F.col("_best._id").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_row") == F.col("_best._row")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fan_in: int = 2) -> DataFrame:
    """The rows of df that stay, with df's columns.

    The rows that go are listed by id and digest and taken out; but for those that go (and few others that
    share a bit with them) no text is shuffled. Rows that repeat both id and text are told apart only where
    some do: of those one is picked by an aggregate that combines before it shuffles.
    """
    kid, ksha, again, dsha = fresh(df, "kid", "ksha", "again", "dsha")
    groups = exact_groups(df, id_col, text_col, keep, fan_in)
    lost = groups.where(~F.col("kept")).select(F.col(id_col).alias(kid), F.unhex("text_sha256").alias(ksha), F.col(id_col).eqNullSafe(F.col("keep_id")).alias(again)).distinct()
    lost = materialise(lost, "lost")
    keyed = df.withColumn(dsha, F.unhex(F.sha2(text_or_empty(text_col), 256)))
    columns, on = [F.col(f"`{c}`") for c in df.columns], [(id_col, kid), (dsha, ksha)]
    once = without(keyed, lost, on).select(*columns)
    repeated = lost.where(F.col(again))
    if repeated.isEmpty():
        return once
    one = within(keyed, repeated, on).groupBy(id_col, dsha).agg(F.first(F.struct(*columns)).alias("r")).select("r.*")
    return once.unionByName(one)
