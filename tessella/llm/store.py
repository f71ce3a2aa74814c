"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.scratch import discard, materialise, release, scratch_root

__all__ = ["discard", "exactly", "fresh", "give_back", "materialise", "release", "scratch_root", "suspects", "text_or_empty", "within", "without"]

#: Bits of a bitmap that is broadcast: eight megabytes at most.
MOST_BITS = 1 << 26
PAGE_BITS = 8 * 4096


def give_back() -> None:
    """Hands memory that a Python worker has freed back to the system: workers outlive their tasks, and would keep what the largest took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_or_empty(name: str):
    """Null texts count as empty ones."""
    return F.coalesce(F.col(name), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that none of df's columns has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def suspects(df: DataFrame, listed: DataFrame, on: list[tuple[str, str]]) -> tuple[DataFrame, str]:
    """df with a column that is false only where a row's key surely isn't listed, and that column's name.

    The listed keys' hashes are bits of a bitmap, sixteen for a key as long as it is within its bound; it is
    broadcast in pages of 4096 bytes.
    """
    page, bits, suspect, place = fresh(df, "page", "bits", "suspect", "place")
    size = min(MOST_BITS, max(PAGE_BITS, 1 << (16 * max(1, listed.count()) - 1).bit_length()))
    at = lambda names: F.pmod(F.xxhash64(*names), F.lit(size))
    keys = listed.select((at([b for _, b in on]) + 1).alias(place))
    pages = keys.groupBy(F.bitmap_bucket_number(place).alias(page)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias(bits))
    placed = df.withColumn(place, at([a for a, _ in on]))
    met = placed.join(F.broadcast(pages), F.expr(f"`{place}` div {PAGE_BITS} + 1") == F.col(page), "left")
    byte = F.conv(F.hex(F.expr(f"substring(`{bits}`, cast(`{place}` % {PAGE_BITS} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.expr(f"cast(`{place}` % 8 as int)")
    return met.withColumn(suspect, F.coalesce(F.call_function("shiftright", byte, hit).bitwiseAND(F.lit(1)) == 1, F.lit(False))).drop(place, page, bits), suspect


def exactly(df: DataFrame, listed: DataFrame, on: list[tuple[str, str]], how: str) -> DataFrame:
    """A join of that kind on equal keys, nulls being equal."""
    same = F.lit(True)
    for a, b in on:
        same = same & df[a].eqNullSafe(listed[b])
    return df.join(listed, same, how)


def without(df: DataFrame, listed: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """The rows of df whose key isn't among those of a stored list; on: pairs of column names, df's and the list's.

    Rows that a bitmap rules out stay where they are; only the others, mostly those that go, are shuffled to an
    exact anti-join. With a list far beyond the bitmap's bound all are, and the result is the same.
    """
    marked, suspect = suspects(df, listed, on)
    sure = marked.where(~F.col(suspect)).drop(suspect)
    return sure.unionByName(exactly(marked.where(F.col(suspect)).drop(suspect), listed, on, "left_anti"))


def within(df: DataFrame, listed: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """The rows of df whose key is among those of a stored list; rows that a bitmap rules out aren't shuffled."""
    marked, suspect = suspects(df, listed, on)
    return exactly(marked.where(F.col(suspect)).drop(suspect), listed, on, "left_semi")
