"""Small building blocks on columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_any(text: Column, marks: Iterable[str]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | text.contains(m)
    return out


def ladder(rules: Iterable[tuple[Column, object]], other: object) -> Column:
    """The value of the first condition that holds."""
    rules = list(rules)
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for condition, value in rules[1:]:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(other))


def lookup(key: Column, table: dict[str, object], other: object = None) -> Column:
    """A value by key from a small fixed table."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(other)) if other is not None else F.try_element_at(pairs, key)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def py_round(x: Column, digits: int) -> Column:
    """Rounds a double below 1000 as exact binary arithmetic does; decimal rounding differs in about one of six scores."""
    return F.format_number(x, digits).cast("double")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(name: Column) -> Column:
    """The lower-cased last extension of a file name with its dot; empty for none, and for a leading dot alone."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]+$", "")


def parent(path: Column) -> Column:
    """The folder of a path; empty at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """Every prefix of a path that ends at a part, the path itself included, shortest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def normal_path(path: Column) -> Column:
    """Resolves '.' and '..' parts by folding over the parts."""
    empty = F.array().cast("array<string>")
    fold = lambda acc, p: F.when(p.isin(".", ""), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), empty, fold), "/")


def glob_regex(glob: str) -> str:
    """A pattern for a whole name from a shell glob."""
    out = ""
    for piece in re.findall(r"\[[^\]]+\]|.", glob, re.S):
        out += ".*" if piece == "*" else "." if piece == "?" else piece.replace("[!", "[^") if len(piece) > 1 else re.escape(piece)
    return f"(?s)^{out}$"


def slug(text: Column) -> Column:
    """Letters, digits, CJK, '_' and '-'; anything else becomes one '-'; 'topic' if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(text), r"[^0-9A-Za-z一-鿿_-]+", "-"), "-+", "-"), "^[-_]+|[-_]+$", "")
    return F.when(kept == "", "topic").otherwise(kept)


def safe_id(text: Column) -> Column:
    kept = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")
    return F.when(kept == "", "page").otherwise(kept)


def flat_id(text: Column) -> Column:
    """':', '/', '\\' and '.' become '_'."""
    return F.translate(text, ":/\\.", "____")


def module_slug(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "/\\", "__"), "^_+|_+$", "")


def title_words(name: Column) -> Column:
    """A readable title from the last part of a name. Unlike Python's title(), letters after digits or apostrophes stay lower."""
    last = base_name(F.regexp_replace(name, r"[/\\]+$", ""))
    return F.initcap(F.translate(last, "-_", "  "))
