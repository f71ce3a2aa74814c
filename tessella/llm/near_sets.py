"""Near duplicates by SimHash and the Jaccard similarity of word shingles, exact at any threshold from a half up.

A text is the set of its shingles' hashes; two texts link if their sets' similarity is at least the
threshold. Operator 8's covering anchors come first: sets whose fingerprints (of the same shingles) differ in
at most three bits are compared with each other, along links that span each near group. Of 64 bits, pairs
at the threshold may differ in more; those are found as follows, exactly. Sets are put in one order, rare shingles first. Two sets that link share one of the first
n - ceil(threshold * n) + 1 shingles of each (prefix filtering), so all links lie between texts that
meet at a shingle there. The order decides about cost alone: shingles that a bounded sample shows to
be frequent come last, any others in the order of their hashes.

Shingles at which the same sets meet, as those of a shared passage do, are one meeting with their number.
Links are found in steps, so that a large group of near copies takes a few links a member, not all
pairs. What the fingerprints have linked isn't compared again. Those that meet are compared with the least of them. Where several
components still meet, each member is compared with the one of another component that its bit map is nearest to (in a large
meeting, the nearest of a block of members, dealt anew each round), a few rounds, as long as that links some. Then
only meetings of several components are left, and there all pairs across components are compared. A pair is
compared by lengths and a bit map of each set's parities (two bit maps never differ in more bits than
the sets in members), by the number of shingles where it meets, which bounds how many it can share, and
if all that allows the similarity by the sets themselves. Meetings of one least set lie together, so that a pair
comes once from there, however many it meets at. Nothing is sampled or capped in that. Components are joined by
their labels: a round costs what it has found, not what all before it have.

Cases: null and empty texts, and those of white space, have the same empty set and are near copies.
Texts of fewer words than a shingle have one. Sets are told apart by 64-bit digests. Rows without id stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.simhash import components, near_links, print_of
from tessella.llm.store import discard, exactly, fresh, give_back, materialise, suspects, within

BITS = 2048
#: Rows of pairs after which a batch is handed on.
OUT_ROWS = 50_000
#: Pairs of one set that are verified in one place.
RUN = 256
#: Members of a meeting among which the nearest is looked for, and in how many rounds at most.
CROWD, ROUNDS = 1024, 3
#: Rows of the meetings of one least set that lie in one place.
TOGETHER = 1 << 16


def hashes_of(text: str | None, size: int) -> np.ndarray:
    """The hashes of a text's word shingles, as they come."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: max(1, len(words) - size + 1)].tolist()
    stops = ends[size - 1 :].tolist() if len(words) >= size else [len(flat)]
    return np.array([digest(flat[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64)


def shingles(text: str | None, size: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order."""
    return np.unique(hashes_of(text, size))


def _digests(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64))


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))


def set_of(text: Column, size: int) -> Column:
    """struct(v: the set's digest, hashes)."""

    @F.arrow_udf("v long, hashes array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sets = [shingles(t, size) for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays([_digests(sets), _lists(sets)], ["v", "hashes"])
        give_back()

    return run(text)


def outline(text: Column, size: int, least: Fraction, frequent: np.ndarray, counts: np.ndarray) -> Column:
    """struct(v, fp: SimHash, n: members, bits: parities, prefix). frequent: hashes in order that come last, by counts."""

    def prefix(s: np.ndarray) -> np.ndarray:
        keep = len(s) - -(-len(s) * least.numerator // least.denominator) + 1 if len(s) else 0
        if not len(frequent):
            return s[:keep]
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        return s[np.lexsort((s, np.where(frequent[at] == s, counts[at], 0)))[:keep]]

    @F.arrow_udf("v long, fp long, n int, bits binary, prefix array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            prints, sets = [], []
            for t in texts.to_pylist():
                hashes = hashes_of(t, size)
                prints.append(print_of(hashes))
                sets.append(np.unique(hashes))
            odd = [np.bincount((s % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1 for s in sets]
            bits = pa.array([np.packbits(o.astype(np.uint8)).tobytes() for o in odd], pa.binary())
            yield pa.StructArray.from_arrays([_digests(sets), pa.array(prints, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), bits, _lists([prefix(s) for s in sets])], ["v", "fp", "n", "bits", "prefix"])
        give_back()

    return run(text)


def frequent_shingles(docs: DataFrame, id_col: str, text_col: str, size: int, sample: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, of at most `most` shingles that several of about `sample` texts have, and in how many."""
    share = min(1.0, sample / max(1, docs.select(id_col).count()))
    some = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("frequent")), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    counted = some.select(F.explode(set_of(F.col(text_col), size)["hashes"]).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 2")
    got = counted.orderBy(F.desc("c"), "s").limit(most).toPandas()
    hashes, counts = got["s"].to_numpy(np.int64).view(np.uint64), got["c"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _nearest(least: Fraction, turn: int):
    """As _pairs, but for each member only the pair with the nearest bit map in its block of the meeting."""
    return _meet(least, turn)


def _pairs(least: Fraction):
    """Rows (a, b, n_a, n_b, c: shingles) for pairs of different labels that meet and whose lengths and bit maps allow the similarity."""
    return _meet(least, None)


def _summed(held: list[np.ndarray]) -> np.ndarray:
    """Columns a, b, n_a, n_b, c with each pair once."""
    cols = np.concatenate([np.zeros((5, 0), np.int64), *held], axis=1)
    cols = cols[:, np.lexsort((cols[1], cols[0]))]
    first = np.flatnonzero(np.r_[True, (np.diff(cols[:2]) != 0).any(axis=0)][: cols.shape[1]])
    out = cols[:, first]
    if len(first):
        out[4] = np.add.reduceat(cols[4], first)
    return out


def _meet(least: Fraction, turn: int | None):
    """Rows come by meeting: (g, at, v, label, n, c, bits), those of one least set (at) together."""
    num, den = least.numerator, least.denominator

    def of(v: np.ndarray, label: np.ndarray, n: np.ndarray, c: np.ndarray, bits: np.ndarray) -> Iterator[np.ndarray]:
        order = np.argsort(n, kind="stable")
        v, label, n, c, bits = v[order], label[order], n[order], c[order], bits[order]
        ends = np.searchsorted(n, n * den // num, "right")
        other, far = np.full(len(v), -1), np.full(len(v), np.iinfo(np.int64).max)
        for i, end in enumerate(ends.tolist()):
            rest = np.flatnonzero(label[i + 1 : end] != label[i]) + i + 1
            differ = np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1, dtype=np.int64)
            allowed = differ * (num + den) <= (den - num) * (n[rest] + n[i])
            hit = rest[allowed]
            if not len(hit):
                continue
            if turn is None:
                yield pairs(v, n, c, np.full(len(hit), i), hit)
                continue
            differ = differ[allowed]
            closer = differ < far[hit]
            other[hit[closer]], far[hit[closer]] = i, differ[closer]
            if differ.min() < far[i]:
                other[i], far[i] = hit[differ.argmin()], differ.min()
        if len(some := np.flatnonzero(other >= 0)):
            both = np.unique(np.sort(np.stack([some, other[some]]), axis=0), axis=1)
            yield pairs(v, n, c, *both)

    def pairs(v: np.ndarray, n: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        swap = v[j] < v[i]
        return np.stack([np.where(swap, v[j], v[i]), np.where(swap, v[i], v[j]), np.where(swap, n[j], n[i]), np.where(swap, n[i], n[j]), c[i]])

    def blocks(v: np.ndarray) -> list[np.ndarray]:
        if turn is None or len(v) <= CROWD:
            return [np.arange(len(v))]
        dealt = np.argsort([xxhash.xxh64_intdigest(x.tobytes(), turn) for x in v])
        return np.array_split(dealt, -(-len(v) // CROWD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        held: list[np.ndarray] = []
        size = 0

        def work(cols: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            cut = np.flatnonzero(np.diff(cols[0]) | np.diff(cols[1])) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(cols[0])], strict=True):
                group = tuple(x[a:b] for x in cols[2:])
                for block in blocks(group[0]):
                    for found in of(*(x[block] for x in group)):
                        held.append(found)
                        size += found.shape[1]
                        if size >= 8 * OUT_ROWS:
                            held = [_summed(held)]
                            if (size := held[0].shape[1]) >= 4 * OUT_ROWS:
                                yield from out()

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            whole, held, size = _summed(held), [], 0
            for at in range(0, whole.shape[1], OUT_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + OUT_ROWS]) for x in whole], ["a", "b", "n_a", "n_b", "c"])

        join = lambda: tuple(np.concatenate(c) for c in zip(*kept, strict=True))
        for batch in batches:
            if not batch.num_rows:
                continue
            longs = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)]
            bits = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint64).reshape(-1, BITS // 64)
            kept.append((*longs, bits))
            edge = np.flatnonzero((longs[0] != longs[0][-1]) | (longs[1] != longs[1][-1]))
            if len(edge):
                last = kept.pop()
                kept.append(tuple(c[: edge[-1] + 1] for c in last))
                whole = join()
                kept = [tuple(c[edge[-1] + 1 :] for c in last)]
                yield from work(whole)
        if kept:
            yield from work(join())
        kept.clear()
        yield from out()
        give_back()

    return run


def _similar(least: Fraction):
    """The pairs (a, b) whose sets are similar enough, of rows (a, run, kind, b, hashes) in order: a's own set, then b's."""
    num, den = least.numerator, least.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(0, np.uint64)
        for batch in batches:
            lists = batch.column(4)
            flat, ends = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            kept = np.zeros(batch.num_rows, bool)
            for n, (kind, lo, hi) in enumerate(zip(batch.column(2).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                own = flat[lo:hi]
                if not kind:
                    mine = own.copy()
                elif len(mine) and len(own):
                    at = np.minimum(np.searchsorted(mine, own), len(mine) - 1)
                    kept[n] = int((mine[at] == own).sum()) * (num + den) >= (len(mine) + len(own)) * num
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], ["a", "b"]).filter(pa.array(kept))
        give_back()

    return run


def print_pairs(sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): pairs of the sets (v, fp, n) that span all groups of fingerprints at three bits or fewer."""
    prints = materialise(sets.groupBy("fp").agg(F.min(F.struct("v", "n")).alias("least")), "prints")
    links = near_links(prints.select("fp"))
    side = lambda c: prints.select(F.col("fp").alias(c), F.col("least").alias(f"least_{c}"))
    across = links.join(side("a"), "a").join(side("b"), "b").select(F.col("least_a").alias("p"), F.col("least_b").alias("q"))
    # Sets with one fingerprint are linked to the least of them.
    equal = sets.join(prints, "fp").where("v <> least.v").select(F.col("least").alias("p"), F.struct("v", "n").alias("q"))
    pairs = across.union(equal).select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    return pairs.select(F.col("p.v").alias("a"), F.col("q.v").alias("b"), F.col("p.n").alias("n_a"), F.col("q.n").alias("n_b"))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (v, label: the smallest of its component, which isn't listed itself) after more links (a, b)."""
    of = lambda c: labels.select(F.col("v").alias(c), F.col("label").alias(f"label_{c}"))
    tops = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    up = materialise(components(tops), "tops")
    raised = labels.join(up.select(F.col("v").alias("label"), F.col("label").alias("top")), "label", "left").select("v", F.coalesce("top", "label").alias("label"))
    return materialise(raised.unionByName(up), "components")


def near_groups(docs: DataFrame, id_col: str, text_col: str, size: int = 5, similarity: float = 0.8, sample: int = 16_384, most: int = 200_000) -> DataFrame:
    """(id, v, component_id): the smallest id that each row reaches by links; v is its set's digest, for an id may
    stand for several texts. Rows without id aren't allowed."""
    least = Fraction(str(similarity))
    frequent, counts = frequent_shingles(docs, id_col, text_col, size, sample, most)
    rows = docs.select(F.col(id_col).alias("id"), outline(F.col(text_col), size, least, frequent, counts).alias("o"))
    rows = materialise(rows.select("id", "o.*"), "outlines")
    sets = materialise(rows.groupBy("v").agg(F.min("id").alias("rep"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix")), "sets")
    at = Window.partitionBy("s")
    # g tells meetings of other sets apart; should two have one, they are compared as one, and no pair is lost.
    met = sets.select("v", "n", F.explode("prefix").alias("s")).select(
        "*", F.count(F.lit(1)).over(at).alias("members"), F.min(F.struct("v", "n")).over(at).alias("least"), F.bit_xor(F.xxhash64("v", F.lit("meeting"))).over(at).alias("g")
    )
    met = materialise(met.where("members > 1").groupBy("g", F.col("least.v").alias("at"), F.col("least.n").alias("n_at"), "v", "n").agg(F.count(F.lit(1)).alias("c")), "meetings")

    def similar_sizes(pairs: DataFrame) -> DataFrame:
        return pairs.where(F.least("n_a", "n_b") * least.denominator >= F.greatest("n_a", "n_b") * least.numerator)

    def linked(meetings: DataFrame, label: str, known: DataFrame | None = None) -> DataFrame:
        """Those of the pairs in meetings (a, b, n_a, n_b, c: at so many shingles) whose sets are similar enough.

        Shingles up to the end of the prefix that ends first are shared in both prefixes or not at all; of
        those after it at most ceil(threshold * n) - 1 are shared. Pairs for which that is too few are left out,
        as are those of one component in known.
        """
        behind = lambda n: F.floor((F.col(n) * least.numerator + least.denominator - 1) / least.denominator)
        most_shared = F.col("c") + F.greatest(behind("n_a"), behind("n_b")) - 1
        counted = similar_sizes(meetings.groupBy("a", "b", "n_a", "n_b").agg(F.sum("c").alias("c")))
        pairs = counted.where(most_shared * (least.numerator + least.denominator) >= (F.col("n_a") + F.col("n_b")) * least.numerator)
        if known is not None:
            of = lambda c: known.select(F.col("v").alias(c), F.col("label").alias(f"label_{c}"))
            pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b"))
        return verified(pairs, label)

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        """Those of distinct pairs (a, b) whose sets are similar enough."""
        pairs = materialise(pairs.select("a", "b"), f"{label}-pairs")
        wanted = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct().join(sets.select("v", "rep"), "v").select(F.col("rep").alias("_rep")).distinct()
        wanted = materialise(wanted, f"{label}-wanted")
        texts = within(docs.select(id_col, text_col), wanted, [(id_col, "_rep")]).select(set_of(F.col(text_col), size).alias("t"))
        full = materialise(texts.select("t.v", "t.hashes").dropDuplicates(["v"]), f"{label}-sets")
        # The set of a goes once to each run of its pairs, however many they are, and b's once to each of its pairs.
        runs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / RUN).alias("runs"))
        dealt = pairs.join(runs, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("runs")).alias("run"))
        dealt = materialise(dealt, f"{label}-runs")
        heads = dealt.select("a", "run").distinct().join(full.withColumnRenamed("v", "a"), "a").select("a", "run", F.lit(0).alias("kind"), F.col("a").alias("b"), "hashes")
        others = dealt.join(full.withColumnRenamed("v", "b"), "b").select("a", "run", F.lit(1).alias("kind"), "b", "hashes")
        together = heads.unionByName(others).repartition("a", "run").sortWithinPartitions("a", "run", "kind")
        return materialise(together.mapInArrow(_similar(least), "a long, b long"), f"{label}-links")

    prints = materialise(components(verified(similar_sizes(print_pairs(sets)), "prints")), "print-components")
    stars = met.where("v <> at").select(F.col("at").alias("a"), F.col("v").alias("b"), F.col("n_at").alias("n_a"), F.col("n").alias("n_b"), "c")
    found = merged(prints, linked(stars, "first", prints))

    def mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """Those rows of meetings in which several components meet, with their labels."""
        each = Window.partitionBy("g", "at")
        tagged = rows.select("g", "at", "v", "n", "c").join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
        seen = tagged.select("*", (F.min("label").over(each) != F.max("label").over(each)).alias("mixed"), (F.count(F.lit(1)).over(each) > CROWD).alias("large"))
        return materialise(seen.where("mixed").drop("mixed"), "mixed")

    def across(rows: DataFrame, compare) -> DataFrame:
        """What compare makes of whole meetings. A least set's meetings lie together, in several places if they are many."""
        many = rows.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("places")).where("places > 1")
        dealt = rows.join(many, "at", "left").withColumn("place", F.pmod("g", F.coalesce("places", F.lit(1))))
        dealt = dealt.join(sets.select("v", "bits"), "v").select("g", "at", "v", "label", F.col("n").cast("long").alias("n"), "c", "bits", "place")
        return dealt.repartition("at", "place").sortWithinPartitions("at", "g").drop("place").mapInArrow(compare, "a long, b long, n_a long, n_b long, c long")

    left = mixed(met, found)
    for turn in range(ROUNDS):
        near = materialise(across(left, _nearest(least, turn)), "nearest")
        # A set that could be compared with none of all members of its meetings never can be: components only grow.
        alive = near.select(F.col("a").alias("v")).union(near.select("b")).distinct().withColumn("alive", F.lit(True))
        rest = left.join(alive, "v", "left").where("large or alive is not null")
        more = linked(near, f"round-{turn}")
        linked_some = not more.isEmpty()
        found = merged(found, more)
        was, left = left, mixed(rest, found)
        discard(was)
        if not linked_some:
            break
    found = merged(found, linked(across(left, _pairs(least)), "second"))

    labelled = sets.select("v", "rep").join(found, "v", "left").select("v", "rep", F.coalesce("label", "v").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    return rows.select("id", "v").join(labelled.join(smallest, "label").select("v", "component_id"), "v").select("id", "v", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, **options) -> DataFrame:
    """df with one document of each near group: the one whose id is the component's. Rows without id stay.

    A row goes by its id and its set. Of rows that share an id each is judged by its own text; those of a group
    that share the smallest id all stay.
    """
    gone, gone_set, own = fresh(df, "gone", "gone_set", "own_set")
    groups = near_groups(df.where(F.col(id_col).isNotNull()), id_col, text_col, size, **options)
    left = groups.where(F.col("id") != F.col("component_id")).select(F.col("id").alias(gone), F.col("v").alias(gone_set)).distinct()
    left = materialise(left, "gone")
    marked, suspect = suspects(df, left, [(id_col, gone)])
    some = marked.where(F.col(suspect)).drop(suspect).withColumn(own, set_of(F.col(text_col), size)["v"])
    return marked.where(~F.col(suspect)).drop(suspect).unionByName(exactly(some, left, [(id_col, gone), (own, gone_set)], "left_anti").drop(own))
