"""SimHash near-duplicates by covering with anchor points.

Fingerprints of 64 bits link if at most three bits differ; then one of the two halves differs in
at most one bit. Each half is covered by a code: a Hamming code on 31 bits, whose covering radius is
one, and one free bit. Every fingerprint is at home at the anchor nearest to each half (distance at
most one), and is replicated to every anchor within covering radius plus threshold, which is two:
seventeen at most a half. Of two fingerprints that link, one is therefore found at the other's home.
Comparison happens per anchor. Nothing is sampled or capped.

A cell that has more than ``cell_limit`` fingerprints is subdivided exactly: the other half, which
then differs in at most three bits, is split into two quarters, one of which differs in at most one
bit, and covered in the same way by a Hamming code on 15 bits and a free bit.

Cells give spanning links, not all pairs: large groups of near copies yield one link a member.
Equal fingerprints are one vertex. Components come from alternating large-star and small-star
rounds, stored in the shared folder.

Cases: a null or empty text, or one of white space, has fingerprint zero, which links like any
other. Null ids take part; a component's id is the smallest id that isn't null, null if there is
none. Repeated rows give repeated rows. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.store import discard, exactly, fresh, give_back, materialise, suspects

BLOCK = 1 << 18


def ones(hashes: np.ndarray) -> np.ndarray:
    """In how many of the hashes each bit is set, high bit first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        total += np.unpackbits(hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return total


def print_of(hashes: np.ndarray) -> int:
    """The fingerprint of a text's shingle hashes, repeats included, as a long; zero without any."""
    return int.from_bytes(np.packbits(ones(hashes) * 2 > len(hashes)).tobytes(), "big", signed=True) if len(hashes) else 0


def fingerprint_bytes(text: str | None, shingle: int = 3, seed: int = 42) -> bytes:
    """The eight bytes, high bit first, of one text's fingerprint."""
    # bytes.lower() changes A-Z alone; bytes.split() splits at 0x20 and 0x09-0x0D alone.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8)
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(flat)]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        total += ones(np.array([digest(flat[a:b], seed) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK], strict=True)], np.uint64))
    return np.packbits(total * 2 > n).tobytes()


def fingerprint(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """The fingerprint as a long."""

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([int.from_bytes(fingerprint_bytes(t, shingle, seed), "big", signed=True) for t in texts.to_pylist()], pa.int64())

    return run(text)


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _anchors(value: Column, bits: int) -> Column:
    """All anchors within distance two of value (bits + 1 wide), as structs (anchor, home)."""
    r = (bits + 1).bit_length() - 1
    code, free = value.bitwiseAND(F.lit((1 << bits) - 1)), F.shiftrightunsigned(value, bits)
    syndrome = F.lit(0)
    for j in range(r):
        mask = sum(1 << (p - 1) for p in range(1, bits + 1) if p >> j & 1)
        syndrome = syndrome + F.bit_count(code.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)) * (1 << j)
    flip = lambda p: F.array(*[F.lit(0), *[F.lit(1 << i) for i in range(bits)]]).cast("array<bigint>")[p]
    entry = lambda word, bit, home: F.struct((word + F.shiftleft(bit, bits)).alias("anchor"), F.lit(home).alias("home"))
    home = code.bitwiseXOR(flip(syndrome))
    pairs = F.filter(F.sequence(F.lit(1), F.lit(bits)), lambda p: (p < p.bitwiseXOR(syndrome)) & (p != syndrome) & (syndrome != 0))
    near = F.transform(pairs, lambda p: entry(code.bitwiseXOR(flip(p)).bitwiseXOR(flip(p.bitwiseXOR(syndrome))), free, False))
    return F.concat(F.array(entry(home, free, True), entry(home, F.lit(1) - free, False)), near)


def _cells(fps: DataFrame, cell_limit: int) -> DataFrame:
    """Rows (cell, sub, fp, home), dealt by (cell, sub) and sorted by them.

    Members are counted first, combined before the shuffle. Only what lies in the few cells beyond the limit is
    replicated once more, by the other half's quarters, and so a cell that is hot is spread over tasks.
    """
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(F.col("fp"), 32)
    half = lambda v, n: F.transform(_anchors(v, 31), lambda a: F.struct((a["anchor"] + F.lit(n << 40)).alias("cell"), a["home"].alias("home")))
    rows = fps.select("fp", F.inline(F.concat(half(low, 0), half(high, 1))))
    heavy = materialise(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > cell_limit).select("cell"), "heavy")
    plain = F.lit(0).cast("bigint")
    if heavy.isEmpty():
        dealt = rows.select("cell", plain.alias("sub"), "fp", "home")
    else:
        other = F.when(F.col("cell") < (1 << 40), high).otherwise(low)
        quarter = lambda v, n: F.transform(_anchors(v, 15), lambda a: a["anchor"] + F.lit((n << 20) + 1))
        subs = F.when(F.col("hot").isNull(), F.array(plain)).otherwise(F.concat(quarter(other.bitwiseAND(F.lit(0xFFFF)), 0), quarter(F.shiftrightunsigned(other, 16), 1)))
        dealt = rows.join(heavy.withColumn("hot", F.lit(True)), "cell", "left").select("cell", F.explode(subs).alias("sub"), "fp", "home")
    return dealt.repartition("cell", "sub").sortWithinPartitions("cell", "sub", "fp")


def cell_links(fps: np.ndarray, home: np.ndarray, threshold: int, matrix: int = 2048) -> list[tuple[int, int]]:
    """Links that span the near groups among one cell's distinct fingerprints.

    Up to `matrix` members, homes are compared with all. Beyond that, groups are grown from one member
    each: what has joined leaves the rest, so dense cells take linear memory and few passes.
    """
    if len(fps) <= matrix:
        own = np.flatnonzero(home)
        a, b = np.nonzero(np.bitwise_count(fps[own][:, None] ^ fps[None, :]) <= threshold)
        a = own[a]
        parent = {}

        def find(x):
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = p
            return x

        out = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if x != y and (p := find(x)) != (q := find(y)):
                parent[p] = q
                out.append((x, y))
        return out
    out, rest = [], np.arange(len(fps))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(fps[rest] ^ fps[x]) <= threshold
            if near.any():
                joined = rest[near].tolist()
                rest = rest[~near]
                out += [(x, y) for y in joined]
                queue += joined
    return out


def _links(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def work(block: np.ndarray) -> Iterator[pa.RecordBatch]:
            """block: whole cells, columns cell, sub, fp, home."""
            cut = np.flatnonzero((np.diff(block[0]) != 0) | (np.diff(block[1]) != 0)) + 1
            begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [block.shape[1]]])
            fps, out = block[2].view(np.uint64), []
            for a, b in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist(), strict=True):
                cell, first = np.unique(fps[a:b], return_index=True)
                if len(cell) > 1:
                    home = np.zeros(len(cell), bool)
                    np.logical_or.at(home, np.searchsorted(cell, fps[a:b]), block[3][a:b] > 0)
                    if home.any() or block[1][a]:
                        whole = home if not block[1][a] else np.ones(len(cell), bool)
                        out += [(cell[x], cell[y]) for x, y in cell_links(cell, whole, threshold)]
            if out:
                pairs = np.array(out, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]))
            last = kept[-1]
            edge = np.flatnonzero((last[0] != last[0][-1]) | (last[1] != last[1][-1]))
            if len(edge):
                whole = np.concatenate([*kept[:-1], last[:, : edge[-1] + 1]], axis=1)
                kept = [last[:, edge[-1] + 1 :]]
                yield from work(whole)
        if kept:
            yield from work(np.concatenate(kept, axis=1))
        kept.clear()
        give_back()

    return run


def near_links(fps: DataFrame, threshold: int = 3, cell_limit: int = 100_000) -> DataFrame:
    """Links (a, b) between distinct fingerprints of the column fp that span every near group."""
    if threshold != 3:
        raise ValueError("the code covers a threshold of three bits")
    # Fingerprints are few bytes but are replicated thirty-four times: more tasks than the stored files have.
    spread = fps.repartition(max(1, fps.count() // 16_384), "fp")
    return _cells(spread, cell_limit).mapInArrow(_links(threshold), "a long, b long").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, label): the smallest vertex that each linked vertex reaches; the smallest itself isn't listed."""
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        done, edges = edges, materialise(small, "edges")
        discard(done)
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("u").alias("v"), F.col("v").alias("label"))


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, threshold: int = 3, cell_limit: int = 100_000) -> DataFrame:
    """One row a document: id_col, fingerprint (16 hex digits), component_id."""
    docs = df.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle, seed).alias("fp"), F.spark_partition_id().alias("run"))
    docs = materialise(docs, "fingerprints")
    reps = materialise(docs.groupBy("fp").agg(F.min("id").alias("rep")), "representatives")
    found = components(near_links(reps.select("fp"), threshold, cell_limit))
    labelled = reps.join(found.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    by_fp = labelled.join(smallest, "label").select("fp", "component_id")
    # A frequent fingerprint is looked up once a run, and its rows stay spread over their runs.
    looked_up = docs.select("run", "fp").distinct().join(by_fp, "fp")
    return docs.join(looked_up, ["run", "fp"]).select(F.col("id").alias(id_col), hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, **options) -> DataFrame:
    """df with one document of each near group: the one whose id is the component's. Rows without id stay.

    A row goes by its id and its fingerprint. Of rows that share an id each is judged by its own text; those of a
    group that share the smallest id all stay.
    """
    gone, gone_print, own = fresh(df, "gone", "gone_print", "own_print")
    groups = near_components(df.where(F.col(id_col).isNotNull()), id_col, text_col, shingle, seed, **options)
    left = materialise(groups.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(gone), F.col("fingerprint").alias(gone_print)).distinct(), "gone")
    marked, suspect = suspects(df, left, [(id_col, gone)])
    some = marked.where(F.col(suspect)).drop(suspect).withColumn(own, hex_fingerprint(fingerprint(F.col(text_col), shingle, seed)))
    return marked.where(~F.col(suspect)).drop(suspect).unionByName(exactly(some, left, [(id_col, gone), (own, gone_print)], "left_anti").drop(own))
