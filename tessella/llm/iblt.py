"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame expressions only.

A document's paragraphs (lines) are cut into pieces: of twelve words, then up to the end of a sentence, of
32 words at most; the text's first word is a piece of its own, and a word counts as several if it has
over 64 characters. So pieces are bounded, where they end depends on the text before them within a line
alone, and texts that share a beginning, a line or a long passage share pieces. The distinct pieces are
hashed to 64-bit digests. A sketch has cells of (count, key, check): every digest is added to one cell
of each of three sub-tables, keys and checks by exclusive or. Two sketches subtract cell by cell; pieces
that both have cancel. Peeling then looks for cells that hold a single digest (a count of one and a
check that fits), takes those digests out of their other cells, and goes on until nothing is left: what
was taken out are exactly the differing pieces.

The fingerprint is a sketch of 24 cells. If peeling the difference of two fingerprints fails, larger
sketches are tried, which are made from the two texts' digests (the fingerprints alone don't suffice
then): digests are dealt by their leading bits to as many small sketches as the pieces need, each
retried with more cells and other bits as long as it fails. All of it is one projection: no shuffle, no
groups, nothing on the driver.

likeness = shared / all distinct pieces (1 for two texts without any).

Cases: null counts as empty text, whose sketch is all zero. Equal texts have equal fingerprints.
Repeated pieces count once. Very long texts cost time in proportion to n ** 1.5 pieces at most. Ids are
integers (others are an error); rows that repeat an id, or have none, follow each other by their texts'
hashes and lie in one range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.store import text_or_empty

#: log2 of cells in a sub-table, and which bit of a digest its first cell number begins at.
BASE = (3, 30)
RETRIES = [(2, 0), (3, 6), (5, 15)]
CELL = "array<struct<n:int,key:bigint,chk:bigint>>"
LOAD = 4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


_SPACE = " \t\n\x0b\f\r"
_WORD = r"\S{1,64}+"
_GAP = r"[^\S\n]{0,64}+(?!\n)"
#: White space, or a piece: the first word; or eleven words, then such as end no sentence, then one.
PIECE = rf"\s{{1,64}}+|(\A{_WORD}\s{{0,64}}+|(?:{_WORD}{_GAP}){{0,11}}+(?:{_WORD}(?<![.!?…。！？]){_GAP}){{0,20}}+(?:{_WORD}\s{{0,64}}+)?+)"


def digests(text: Column) -> Column:
    """The distinct pieces' digests; white space behind a piece doesn't count."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(1))
    return F.array_distinct(F.transform(F.filter(pieces, lambda p: p != ""), lambda p: F.xxhash64(F.rtrim(p, F.lit(_SPACE)))))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(1)).bitwiseAND(F.lit(0xFFFFFFFF))


def _hits(key: Column, cell: Column, shape: tuple[int, int]) -> Column:
    """Whether a digest belongs to a cell; cells are numbered through the three sub-tables."""
    bits = shape[0]
    return _slot(key, F.shiftright(cell, bits), shape) == cell.bitwiseAND(F.lit((1 << bits) - 1))


def _slot(key: Column, table: Column, shape: tuple[int, int]) -> Column:
    bits, first = shape
    part = lambda j: F.shiftrightunsigned(key, first + j * bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    return F.when(table == 0, part(0)).when(table == 1, part(1)).otherwise(part(2))


def sketch(keys: Column, shape: tuple[int, int] = BASE) -> Column:
    """The cells of an array of distinct digests."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(F.lit(0).alias("n"), zero.alias("key"), zero.alias("chk"))
    add = lambda c, x: F.struct((c["n"] + 1).alias("n"), c["key"].bitwiseXOR(x["key"]).alias("key"), c["chk"].bitwiseXOR(x["chk"]).alias("chk"))
    slotted = F.transform(keys, lambda k: F.struct(k.alias("key"), _check(k).alias("chk"), *[_slot(k, F.lit(t), shape).alias(f"s{t}") for t in range(3)]))
    table = lambda xs, t: F.transform(F.sequence(F.lit(0), F.lit((1 << shape[0]) - 1)), lambda i: F.aggregate(F.filter(xs, lambda x: x[f"s{t}"] == i), start, add))
    return let(slotted, lambda xs: F.concat(*[table(xs, t) for t in range(3)]))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["chk"].bitwiseXOR(y["chk"]).alias("chk")))


def peel(cells: Column, shape: tuple[int, int]) -> Column:
    """The differing digests as structs (key, sign: 1 for those of the first sketch); null if some can't be recovered."""
    pure = lambda cs: F.array_distinct(F.transform(F.filter(cs, lambda c: (F.abs(c["n"]) == 1) & (c["chk"] == _check(c["key"]))), lambda c: F.struct(c["key"].alias("key"), c["n"].alias("sign"))))

    def take(cs: Column, found: Column) -> Column:
        without = lambda c, f: F.struct((c["n"] - f["sign"]).alias("n"), c["key"].bitwiseXOR(f["key"]).alias("key"), c["chk"].bitwiseXOR(_check(f["key"])).alias("chk"))
        return F.transform(cs, lambda c, i: F.aggregate(found, c, lambda acc, f: F.when(_hits(f["key"], i, shape), without(acc, f)).otherwise(acc)))

    def turn(state: Column, _: Column) -> Column:
        """Once a turn finds nothing, no later one would: they pass the state on as it is."""
        same = F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(True).alias("done"))
        step = lambda found: F.when(F.size(found) == 0, same).otherwise(F.struct(take(state["cells"], found).alias("cells"), F.concat(state["found"], found).alias("found"), F.lit(False).alias("done")))
        return F.when(state["done"] | state["cells"].isNull(), state).otherwise(let(pure(state["cells"]), step))

    turns = 6 + 2 * shape[0]
    begin = F.struct(cells.alias("cells"), F.array().cast("array<struct<key:bigint,sign:int>>").alias("found"), F.lit(False).alias("done"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(turns)), begin, turn)
    clean = lambda s: F.when(~F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["chk"] != 0)), s["found"])
    return let(end, clean)


def _exact(a: Column, b: Column) -> Column:
    signed = lambda xs, sign: F.transform(xs, lambda k: F.struct(k.alias("key"), F.lit(sign).alias("sign")))
    return F.concat(signed(F.array_except(a, b), 1), signed(F.array_except(b, a), -1))


def _small(a: Column, b: Column) -> Column:
    """Differing digests of a few: ever larger sketches; should all fail, the sets are compared."""
    tries = [peel(subtract(sketch(a, s), sketch(b, s)), s) for s in RETRIES]
    return F.coalesce(*tries, _exact(a, b))


def difference(a: Column, b: Column, of_a: Column, of_b: Column) -> Column:
    """How many pieces differ. a, b: all digests of each; of_a, of_b: their fingerprints' cells."""
    count = F.size(a) + F.size(b)
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(count, F.lit(1)) / F.lit(float(LOAD)))).cast("int"))

    def dealt(z: Column) -> Column:
        """By the first half of the leading bits, then by the rest, so that no pass reads all digests once a sketch."""
        up = F.shiftright(z["bits"], 1)
        down = z["bits"] - up
        lead = lambda k, n, skip: F.when(n == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftrightunsigned", F.call_function("shiftleft", k, skip), F.lit(64) - n))
        group = lambda ks, g, n, skip: F.filter(ks, lambda k: lead(k, n, skip) == g)
        all_of = lambda n: F.sequence(F.lit(0).cast("bigint"), F.call_function("shiftleft", F.lit(1).cast("bigint"), n) - 1)
        total = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)
        inner = lambda h: lambda g: let(
            F.struct(group(h["a"], g, down, up).alias("a"), group(h["b"], g, down, up).alias("b")),
            lambda s: F.when((F.size(s["a"]) == 0) & (F.size(s["b"]) == 0), F.lit(0)).otherwise(F.size(_small(s["a"], s["b"]))),
        )
        outer = lambda g: let(
            F.struct(group(z["a"], g, up, F.lit(0)).alias("a"), group(z["b"], g, up, F.lit(0)).alias("b")),
            lambda h: F.when(F.size(h["a"]) + F.size(h["b"]) == 0, F.lit(0)).otherwise(total(F.transform(all_of(down), inner(h)))),
        )
        return total(F.transform(all_of(up), outer))

    direct = let(peel(subtract(of_a, of_b), BASE), lambda found: F.when(found.isNotNull(), F.size(found)))
    return F.coalesce(direct, let(F.struct(a.alias("a"), b.alias("b"), bits.alias("bits")), dealt))


def likeness(a: Column, b: Column, of_a: Column, of_b: Column) -> Column:
    count = F.size(a) + F.size(b)
    return let(difference(a, b, of_a, of_b), lambda d: F.when(count == 0, F.lit(1.0)).otherwise((count - d) / (count + d)))


def render(cells: Column) -> Column:
    """A sketch as a string: 32 hex digits a cell."""
    pad = lambda c, n: F.lpad(F.lower(F.hex(c)), n, "0")
    return F.array_join(F.transform(cells, lambda c: F.concat(pad(c["n"], 8), pad(c["key"], 16), pad(c["chk"], 8))), "")


def _range_of(value: Column, splitters: list[int]) -> Column:
    """How many splitters aren't above value, by two passes over about the root of their number."""
    if not splitters:
        return F.lit(0)
    width = max(1, int(len(splitters) ** 0.5))
    chunks = [splitters[i : i + width] for i in range(0, len(splitters), width)]
    array = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")  # noqa: E731 (folded to one constant)
    below = lambda xs: F.size(F.filter(xs, lambda s: s <= value))
    heads = below(array([c[0] for c in chunks]))
    inside = let(heads, lambda h: F.when(h == 0, F.lit(0)).otherwise((h - 1) * width + below(F.element_at(F.array(*map(array, chunks)), h))))
    return F.coalesce(inside, F.lit(0))


def with_next(df: DataFrame, id_col: str, text_col: str, rows_a_range: int = 1000, many_rows: int = 50_000, max_ranges: int = 1 << 16) -> DataFrame:
    """(id, text, next_text): each row with the text that follows in descending order of id, after the
    last the first; rows of equal id by descending hash of their texts, null ids last.

    Ids are cut into ranges at quantiles: of rows_a_range rows up to 1024 ranges, beyond that of many_rows, and
    of more than that only where it would take over max_ranges. Texts are shuffled once, by range; the row
    that follows a range's last is sent along with it.
    """
    if not isinstance(df.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col} must be of an integer type")
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    n = docs.select("id").count()
    ranges = max(1, min(1024, n // rows_a_range), min(max_ranges, n // many_rows))
    splitters: list[int] = []
    if ranges > 1:
        at = docs.agg(F.percentile_approx("id", F.split(F.lit(",".join(str(i / ranges) for i in range(1, ranges))), ",").cast("array<double>"), 10 * ranges)).first()[0] or []
        splitters = sorted(set(at))
    ranged = docs.withColumn("range", _range_of(F.col("id"), splitters))
    tops = sorted((r["range"], r["top"]) for r in ranged.groupBy("range").agg(F.max("id").alias("top")).collect())
    # The first row of each range follows the last of the range above it; the first of all follows the last of all.
    follows = [(top, above) for (_, top), (above, _) in zip(tops, tops[1:] + tops[:1], strict=True)]
    spark = df.sparkSession
    ghosts = spark.createDataFrame(follows, "top bigint, range int")
    heads = docs.join(F.broadcast(ghosts), docs["id"].eqNullSafe(ghosts["top"])).groupBy("range").agg(F.max(F.struct("id", F.xxhash64("text").alias("h"), "text")).alias("g"))
    both = ranged.select("id", "text", "range", F.lit(False).alias("ghost")).unionByName(heads.select("g.id", "g.text", "range", F.lit(True).alias("ghost")))
    order = Window.partitionBy("range").orderBy("ghost", F.desc_nulls_last("id"), F.desc(F.xxhash64("text")))
    return both.withColumn("next_text", F.lead("text").over(order)).where(~F.col("ghost")).select("id", "text", "next_text")


def edited(text: Column, following: Column) -> Column:
    """The last third of text replaced by the first as many code points (or all) of the following."""
    third = F.floor(F.length(text) / 3).cast("int")
    return let(third, lambda k: F.concat(F.substring(text, F.lit(1), F.length(text) - k), F.substring(following, F.lit(1), k)))


def fingerprints(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the column fingerprint."""
    return df.withColumn("fingerprint", render(sketch(digests(text_or_empty(text_col)))))


def versions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = with_next(df, id_col, text_col)
    rows = rows.withColumn("edit", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"), digests(F.col("text")).alias("a"), digests(F.col("edit")).alias("e"), digests(F.col("next_text")).alias("n"))
    rows = rows.select("*", sketch(F.col("a")).alias("sa"), sketch(F.col("e")).alias("se"), sketch(F.col("n")).alias("sn"))
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        render(F.col("sa")).alias("fingerprint"),
        render(F.col("se")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("e"), F.col("sa"), F.col("se")).alias("near_edited"),
        likeness(F.col("a"), F.col("n"), F.col("sa"), F.col("sn")).alias("near_next"),
    )
