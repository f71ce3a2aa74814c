"""Shards of near equal size from sampled splitters.

Records are ordered by a key: the hash of their text, so that equal texts are neighbours, then the hash
of their id, then their row number. A sample weighted by size (bytes plus a share for the row itself,
so that tiny rows can't pile up) is drawn over all rows; its quantiles are the splitters that cut the
key space into ranges. Ranges that turn out overfull, in bytes or rows, are sampled anew and subdivided
until none is left that could be. A splitter never falls inside a light group of equal texts.

Groups are heavy if they have at least ``heavy`` of a shard's bytes or rows; there are at most
2 * shards / heavy of them, which the driver knows. They are placed first, whole, the largest first,
each on the shard that has least; one that would lift its shard more than ``slack`` above the mean is
left to be cut, as are those larger than a shard. The other records, in key order, fill every shard to
one common level: a light group goes by its middle, so it is never cut, and a group to be cut by each
record's own middle. Sizes before a range are added up on the list of ranges, so places are exact. The
law is ``bytes``, sizes near equal.

Only ids, hashes and sizes are shuffled, never texts. The driver sees the sample (some dozens of keys a
range), the ranges (one in 500,000 rows beyond the first 2048) and the heavy groups. A task orders one
range, so no group, however large, is met by one task alone.

Cases: a null text has no bytes (size 1) and its group is that of the empty text. Null ids, equal texts
and repeated rows are told apart by their row number. One record may exceed a shard's share; it lies in
one shard. An empty table gives an empty result; with fewer records than shards some shards stay empty.
Columns other than id and text are not read.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.store import materialise

KEY = ["h", "d", "r"]
LEAST = -(1 << 63)


def key_bytes(*columns: np.ndarray) -> np.ndarray:
    """Keys of three longs as byte strings that sort as they do."""
    flipped = np.stack([np.asarray(c, np.int64).view(np.uint64) ^ np.uint64(1 << 63) for c in columns], axis=1).astype(">u8")
    return flipped.view(f"V{8 * len(columns)}")[:, 0]


def range_of(splitters: np.ndarray) -> Column:
    """How many splitters aren't above a record's key. splitters: (n, 3) longs in order."""
    blob = sorted(bytes(k) for k in key_bytes(*splitters.T)) if len(splitters) else []

    @F.pandas_udf("int")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        heads = np.array([int.from_bytes(b[:8], "big") for b in blob], np.uint64)
        for h, d, r in batches:
            first = h.to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
            at, to = np.searchsorted(heads, first, "left"), np.searchsorted(heads, first, "right")
            ties = np.flatnonzero(at < to)
            if len(ties):
                keys = key_bytes(h.to_numpy()[ties], d.to_numpy()[ties], r.to_numpy()[ties])
                for i, k in zip(ties.tolist(), keys, strict=True):
                    at[i] = bisect.bisect_right(blob, bytes(k), int(at[i]), int(to[i]))
            yield pd.Series(at.astype(np.int32))

    return run("h", "d", "r")


def _quantiles(sample: list, parts: int) -> set[tuple[int, int, int]]:
    """Boundaries that cut a sample, whose members weigh the same, in equal parts."""
    sample = sorted(sample)
    return {sample[i * len(sample) // parts] for i in range(1, parts)} if sample else set()


def draw(rows: DataFrame, weight: Column, expected: float, salt: int) -> list[tuple[int, int, int]]:
    """A sample in which a record is found with a chance in proportion to its weight (a share of one)."""
    chance = F.least(weight * F.lit(float(expected)), F.lit(1.0))
    uniform = F.shiftrightunsigned(F.xxhash64(*KEY, F.lit(salt)), 11) / F.lit(float(1 << 53))
    return list(map(tuple, rows.where(uniform < chance).select(*KEY).toPandas().to_numpy(np.int64).tolist()))


def find_ranges(rows: DataFrame, n_ranges: int, total: int, count: int, heavy: frozenset[int] = frozenset(), oversample: int = 16) -> tuple[np.ndarray, list[int]]:
    """Splitters, and the numbers of the ranges that have rows. heavy: hashes of the groups that a splitter may cut."""
    weight = (F.col("size") / F.lit(float(total)) + F.lit(1.0 / count)) / 2
    snap = lambda keys: {k if k[0] in heavy else (k[0], LEAST, LEAST) for k in keys}
    rate, most = n_ranges * oversample, 3 / n_ranges
    found = snap(_quantiles(draw(rows, weight, rate, 0), n_ranges))
    for turn in itertools.count(1):
        splitters = sorted(found)
        ranged = rows.withColumn("range", range_of(np.array(splitters, np.int64).reshape(-1, 3)))
        stats = ranged.groupBy("range").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.max("size").alias("top"), F.min("h").alias("lo"), F.max("h").alias("hi")).collect()
        # A range's largest record can't be divided, nor can a light group that is alone in its range.
        over = {s["range"]: share for s in stats if (share := max((s["b"] - s["top"]) / total, (s["n"] - 1) / count)) > most and (s["lo"] != s["hi"] or s["lo"] in heavy)}
        if not over:
            return np.array(splitters, np.int64).reshape(-1, 3), sorted(s["range"] for s in stats)
        if turn > 60:
            raise RuntimeError(f"{len(over)} ranges stay overfull")
        inside: dict[int, list] = {}
        for k in draw(ranged.where(F.col("range").isin(*over)), weight, rate, turn):
            if (i := bisect.bisect_right(splitters, k)) in over:
                inside.setdefault(i, []).append(k)
        keys = {s for i, own in inside.items() for s in _quantiles(own, max(2, int(2 * over[i] * n_ranges)))}
        # A light group gets a range of its own where its neighbours overfill it.
        extra = snap(keys) | {(k[0] + 1, LEAST, LEAST) for k in keys if k[0] not in heavy and k[0] < -LEAST - 1}
        if extra <= found:
            rate *= 4  # in the end every row is drawn, so a range that can be divided is
        found |= extra
    raise AssertionError


def place_heavy(groups: list[tuple[int, int, int]], total: int, shards: int, slack: float) -> tuple[dict[int, int], list[int]]:
    """{hash: shard} of the (hash, bytes, rows) that stay whole, and how many bytes of them each shard has."""
    load, placed = [0] * shards, {}
    for h, size, n in sorted(groups, key=lambda g: (-g[1], g[0])):
        least = min(range(shards), key=load.__getitem__)
        if n == 1 or load[least] + size <= (1 + slack) * total / shards:
            placed[h] = least
            load[least] += size
    return placed, load


def cuts(load: list[int], rest: int) -> list[int]:
    """Where the rest's order is cut so that with it all shards reach one level: twice the places."""
    level, poured = Fraction(0), rest
    for n, (low, high) in enumerate(itertools.pairwise([*sorted(load), None]), 1):
        step = Fraction(poured, n)
        if high is None or low + step <= high:
            level = low + step
            break
        poured -= n * (high - low)
    room = [max(Fraction(0), level - x) for x in load]
    return [-(-(2 * c).numerator // (2 * c).denominator) for c in itertools.accumulate(room)][:-1]


def shard_by_bytes(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", slack: float = 0.05, heavy: float = 0.005) -> DataFrame:
    """One row a record: id_col, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.col(text_col)
    rows = df.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"),
        F.xxhash64(F.col(id_col)).alias("d"),
        F.monotonically_increasing_id().alias("r"),
    )
    rows = materialise(rows, "sizes")
    spark = df.sparkSession
    total, count = (x or 1 for x in rows.agg(F.sum("size"), F.count(F.lit(1))).first())
    groups = rows.groupBy("h").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).where((F.col("b") >= heavy * total / shards) | (F.col("n") >= heavy * count / shards))
    groups = [tuple(r) for r in groups.collect()]
    placed, load = place_heavy(groups, total, shards, slack)
    ends = cuts(load, total - sum(load) if groups or count > 1 else 0)

    n_ranges = max(1, min(2048, count // 250), count // 500_000)
    splitters, ranges = find_ranges(rows, n_ranges, total, count, frozenset(g[0] for g in groups))
    homes = spark.createDataFrame([(h, placed.get(h, -1)) for h, _, _ in groups], "h bigint, home int")
    ranged = rows.withColumn("range", range_of(splitters)).join(F.broadcast(homes), "h", "left")
    ranged = ranged.withColumn("poured", F.when(F.col("home") >= 0, F.lit(0)).otherwise(F.col("size")))
    before, base = 0, []
    sums = dict(map(tuple, ranged.groupBy("range").agg(F.sum("poured")).collect()))
    for i in ranges:
        base.append((i, before))
        before += sums[i]
    bases = spark.createDataFrame(base, "range int, bytes_before bigint")
    order, group = Window.partitionBy("range").orderBy(*KEY), Window.partitionBy("range", "h")
    spread = ranged.join(F.broadcast(bases), "range").withColumn("at", F.col("bytes_before") + F.sum("poured").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("poured"))
    spread = spread.select("*", F.sum("poured").over(group).alias("group_bytes"), F.min("at").over(group).alias("group_at"))
    # A light group's middle, or, of a group to be cut (home -1), the record's own: both twice.
    middle = F.when(F.col("home").isNull(), F.col("group_at") * 2 + F.col("group_bytes")).otherwise(F.col("at") * 2 + F.col("size"))
    poured_to = F.size(F.filter(F.array(*[F.lit(c).cast("bigint") for c in ends]) if ends else F.array().cast("array<bigint>"), lambda c: c <= middle))
    sharded = spread.withColumn("shard", F.when(F.col("home") >= 0, F.col("home")).otherwise(poured_to).cast("int"))
    sharded = sharded.select("id", "size", "text_crc32", "range", "shard", (F.row_number().over(Window.partitionBy("range", "shard").orderBy(*KEY)) - 1).alias("nth"))
    sharded = materialise(sharded, "sharded")
    first, firsts = [0] * shards, []
    for i, s, n in sorted(map(tuple, sharded.groupBy("range", "shard").agg(F.count(F.lit(1))).collect())):
        firsts.append((i, s, first[s]))
        first[s] += n
    result = sharded.join(F.broadcast(spark.createDataFrame(firsts, "range int, shard int, first bigint")), ["range", "shard"])
    return result.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
