"""Measures of Markdown and source text (scalar columns, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import rules as R
from tessella.functions.columns import let

#: How diagrams, links to sources, their opening block, links and marks of open work are written.
DIAGRAM = r"(?s)```mermaid\s*\n(.*?)```"
SOURCE_LINK = r"file:///[^)\s#]+(?:#L\d+(?:-L?\d+)?)?"
RANGED_LINK = r"file:///[^)\s#]+#L\d+(?:-L?\d+)?"
TOP_SOURCE = r"\A\s*#\s+[^\n]+\n+(?:[ \t]*\n)*<details\s+open[^>]*>\s*(?:\n\s*)?<summary>\s*(?:Relevant source files|相关源文件)\s*</summary>"
ANY_TOP_SOURCE = r"\A\s*#\s+[^\n]+\n+(?:[ \t]*\n)*<details\b[^>]*>\s*(?:\n\s*)?<summary>\s*(?:Relevant source files|相关源文件)\s*</summary>"
LINK = r"(?<!!)\[([^\]]+)\]\(([^)]+)\)"
TODO = r"(?:TODO|FIXME|HACK|NOTE|WARN|XXX)\s*[:\(]"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def lines_split(text: Column) -> Column:
    return F.split(text, "\n")


def line_count(text: Column) -> Column:
    """Lines as read by a line reader: a final line end opens no further one."""
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n"))).cast("bigint")


def loc(text: Column) -> Column:
    """Lines that aren't empty and don't begin as a comment does."""
    return F.size(F.filter(lines_split(text), lambda x: ~F.trim(x).rlike(r"^(#|//|/\*|\*)") & ~x.rlike(r"^\s*\z"))).cast("bigint")


def todo_lines(text: Column) -> Column:
    """Numbers, from 0, of lines with a mark of open work."""
    rows = lines_split(text)
    return F.filter(F.transform(rows, lambda x, i: F.when(x.rlike(TODO), i)), lambda i: i.isNotNull())


def complexity(control: Column, definitions: Column, lines: Column) -> Column:
    return F.least(F.floor((control * 2 + definitions) * 100 / F.greatest(lines, F.lit(1))), F.lit(100)).cast("bigint")


def has_preface(text: Column) -> Column:
    """Whether every diagram has a block of text before it that speaks of it."""
    before = F.transform(F.slice(F.split(text, r"(?s)```mermaid\s*\n.*?```"), 1, F.greatest(F.regexp_count(text, F.lit(DIAGRAM)), F.lit(1))), lambda x, i: x)
    whole = F.transform(before, lambda x, i: F.array_join(F.slice(before, 1, i + 1), "```\n```"))

    def ok(x: Column) -> Column:
        block = F.trim(F.element_at(F.split(F.rtrim(F.regexp_replace(x, r"\s+\z", "")), "\n\n"), -1))
        block = F.regexp_replace(block, r"^\s+|\s+\z", "")
        return (block != "") & ~block.startswith("#") & ~block.startswith("```") & block.rlike(r"(?i)diagram|图|流程|关系|展示|shows?|illustrates?")

    return F.when(F.regexp_count(text, F.lit(DIAGRAM)) == 0, F.lit(True)).otherwise(F.forall(whole, ok))


def documented_names(text: Column) -> Column:
    """Names in inline code, without words that are no interfaces, each once."""
    names = found(text, r"`([A-Za-z_][A-Za-z0-9_]*)[\(\.<]?", 1)
    return F.array_distinct(F.filter(names, lambda n: ~F.lower(n).isin(*R.NOT_INTERFACES)))


def title_of(text: Column, name: Column) -> Column:
    """The first H1, else a title made of the file's name."""
    h1 = F.trim(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1))
    return F.when(h1 != "", h1).otherwise(F.initcap(F.translate(name, "-_", "  ")))


def excerpt(text: Column, chars: int = R.EXCERPT_CHARS) -> Column:
    """struct(text, start_line, end_line) of a text's beginning."""
    return let(F.substring(text, 1, chars), lambda t: F.struct(t.alias("text"), F.lit(1).cast("bigint").alias("start_line"), (F.length(t) - F.length(F.translate(t, "\n", "")) + 1).cast("bigint").alias("end_line")))


def snippet(text: Column, start: Column, end: Column, context: int = R.SNIPPET_CONTEXT, most: int = R.SNIPPET_CHARS) -> Column:
    """Lines start..end (from 1) with context, their line ends kept; too long ones are cut and marked."""
    rows = found(text, r"(?s)[^\n]*\n|[^\n]+\z")
    first, last = F.greatest(start - 1 - context, F.lit(0)).cast("int"), F.least(F.size(rows), end + context).cast("int")
    body = F.when((F.size(rows) == 0) | (first >= F.size(rows)), "").otherwise(F.array_join(F.slice(rows, first + 1, F.greatest(last - first, F.lit(0))), ""))
    return let(body, lambda b: F.when(F.length(b) > most, F.concat(F.substring(b, 1, most), F.lit("\n// ... (truncated)"))).otherwise(b))


def numbered_lines(text: Column, start: Column, end: Column) -> Column:
    """array of struct(number, text, highlight) of a text's lines."""
    return F.transform(lines_split(text), lambda x, i: F.struct((i + 1).alias("number"), x.alias("text"), ((i + 1 >= start) & (i + 1 <= end)).alias("highlight")))


def headings(html: Column) -> Column:
    """array of struct(level, text) of a page's h2 and h3."""
    all_ = found(html, r"(?is)<h([23])[^>]*>.*?</h\1>")
    return F.transform(all_, lambda h: F.struct(F.regexp_extract(h, r"(?i)^<h([23])", 1).cast("int").alias("level"), F.trim(F.regexp_replace(h, "<[^>]+>", "")).alias("text")))


def parse_reference(href: Column) -> Column:
    """struct(path, start, end) of a link to a source: file address, query or plain path with a line range."""
    clean = F.regexp_replace(href, "^file://", "")
    path = F.url_decode(F.regexp_replace(clean, r"[#?].*$", ""))
    start = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(href, r"#L(\d+)", 1), F.lit("")), F.lit("9999999999")), F.try_to_number(F.nullif(F.regexp_extract(href, r"[?&]start=(\d+)", 1), F.lit("")), F.lit("9999999999"))).cast("bigint")
    end = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(href, r"#L\d+-L?(\d+)", 1), F.lit("")), F.lit("9999999999")), F.try_to_number(F.nullif(F.regexp_extract(href, r"[?&]end=(\d+)", 1), F.lit("")), F.lit("9999999999"))).cast("bigint")
    return F.struct(path.alias("path"), start.alias("start"), F.coalesce(end, start).alias("end"))


def render(template: Column, values: dict[str, Column]) -> Column:
    """Fills '{{ NAME }}' marks; unknown ones stay."""
    for name, value in values.items():
        template = F.regexp_replace(template, F.lit(r"\{\{\s*" + name + r"\s*\}\}"), F.regexp_replace(value, r"([\\$])", r"\\$1"))
    return template
