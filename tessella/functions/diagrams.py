"""Repair of diagram blocks in Markdown, by kind of diagram, in one Arrow-batched UDF.

Every line is read once, from left to right, into tokens, and each token is decided on by itself:

- flow charts: a *node* is an id with a label in brackets (``[]``, ``()``, ``{}``, ``[()]``), an *edge label* stands
  between bars. A label that is no plain name is put in quotes; quotes within a quoted label become single
  ones (thorough); a node that is defined again with another label gets an id of its own, which the
  mentions after it follow (thorough).
- sequences: the shown name of a participant, and (thorough) the text of a message.
- class diagrams: names with ``~`` parameters are shown with ``<>`` under a plain id, by which relations and labels then
  call them; ``~`` types within members likewise; class names, member names and relations' labels that are no plain
  names are quoted (members, relations and plain class names: thorough).
- entity diagrams (thorough): entity names become plain ids.

Other kinds, state diagrams among them, stay as they are. Each token that changes counts as one repair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = re.compile(r"```mermaid\s*\n([\s\S]*?)```")
#: What a plain name is, the kinds of diagrams, the brackets of nodes, the arrows of messages and relations.
PLAIN = re.compile(r"[A-Za-z_][\w-]*")
KIND = re.compile(r"(classDiagram|sequenceDiagram|stateDiagram(?:-v2)?|erDiagram|flowchart|graph)")
CLOSING = {"[(": ")]", "[": "]", "(": ")", "{": "}"}
INNER = {"(": ")", "[": "]", "{": "}", "/": "/\\", "\\": "/\\"}
MESSAGE = "->> -->> --|> <<-- <<->> --".split()
RELATION = "<|-- --|> *-- --* o-- --o <|.. ..|> <-- --> <.. ..> -- .. __".split()
VISIBILITY = "+-~#"

NODE = re.compile(rf"(?<![\w-])({PLAIN.pattern})(\[\(|[\[({{])")
EDGE = re.compile(r"\|([^|\n]+)\|")
TYPE = re.compile(r"\w+~(?:[\w, ~]*?~+(?!\w)|[\w,]+)")


def plain(name: str) -> bool:
    return not name or PLAIN.fullmatch(name) is not None


def either(words: list[str]) -> str:
    return "|".join(map(re.escape, sorted(words, key=len, reverse=True)))


ARROW = re.compile(rf"\s(?:{either(RELATION)})\s")


@dataclass
class Token:
    """A piece of a line: plain text, an edge label, or a node with its id, opening bracket and label."""

    kind: str
    text: str
    id: str = ""
    opening: str = ""

    def written(self) -> str:
        if self.kind == "node":
            return f"{self.id}{self.opening}{self.text}{CLOSING[self.opening]}"
        return f"|{self.text}|" if self.kind == "edge" else self.text


@dataclass
class Repairs:
    """How many tokens were changed."""

    thorough: bool
    count: int = 0
    aliases: dict[str, str] = field(default_factory=dict)

    def quoted(self, label: str) -> str:
        """A label in quotes, if it needs them."""
        if plain(label) or label[0] in "\"'":
            return label
        self.count += 1
        return f'"{label}"'


def label_stop(line: str, at: int, closing: str) -> int:
    """Where a label that begins at a place ends; -1 if its bracket isn't closed on the line."""
    if line.startswith('"', at):
        # The closing quote is the first that the bracket follows and after which the label can't go on.
        ends = [m.start() + 1 for m in re.finditer(re.escape('"' + closing), line[at + 1 :])]
        for end in ends:
            after = line[at + 1 + end + len(closing) :][:1]
            if not after or after.isspace() or after in "-=.<>|&;:~":
                return at + end + 1
    if len(closing) > 1:
        return line.find(closing, at)
    opening, depth = next(o for o, c in CLOSING.items() if c == closing), 1
    for i in range(at, len(line)):
        depth += (line[i] == opening) - (line[i] == closing)
        if not depth:
            return i
    return -1


def flow_tokens(line: str) -> Iterator[Token]:
    at = 0
    while at < len(line):
        node, edge = NODE.search(line, at), EDGE.search(line, at)
        if edge and (not node or edge.start() < node.start()):
            yield Token("text", line[at : edge.start()])
            yield Token("edge", edge[1])
            at = edge.end()
        elif node and (stop := label_stop(line, node.end(), CLOSING[node[2]])) >= 0:
            yield Token("text", line[at : node.start()])
            yield Token("node", line[node.end() : stop], node[1], node[2])
            at = stop + len(CLOSING[node[2]])
        else:
            stop = node.end() if node else len(line)
            yield Token("text", line[at:stop])
            at = stop


def node_label(label: str, r: Repairs) -> str:
    if len(label) > 2 and label[0] in INNER and label[-1] in INNER[label[0]]:  # a shape of several brackets
        return label[0] + node_label(label[1:-1], r) + label[-1]
    if len(label) > 1 and label[0] == label[-1] == '"':
        if r.thorough and '"' in label[1:-1]:
            r.count += 1
            return '"' + label[1:-1].replace('"', "'") + '"'
        return label
    new = r.quoted(label)
    return '"' + new[1:-1].replace('"', "'") + '"' if r.thorough and new != label else new


def flowchart(lines: list[str], r: Repairs) -> list[str]:
    labels: dict[str, str] = {}
    now: dict[str, str] = {}  # ids that a later definition has taken over, and what they go by since
    out = []
    for line in lines:
        tokens = list(flow_tokens(line))
        for t in tokens:
            if t.kind == "edge":
                t.text = r.quoted(t.text)
            elif t.kind == "node":
                t.text = node_label(t.text, r)
                if r.thorough and labels.setdefault(t.id, t.text) != t.text:
                    n = 2
                    while labels.get(f"{t.id}_{n}", t.text) != t.text:
                        n += 1
                    now[t.id] = f"{t.id}_{n}"
                    labels[now[t.id]] = t.text
                    t.id = now[t.id]
                    r.count += 1
            elif now:
                t.text = re.sub(rf"(?<![\w-])({either(list(now))})(?![\w-])", lambda m: now[m[1]], t.text)
        out.append("".join(t.written() for t in tokens))
    return out


def sequence(lines: list[str], r: Repairs) -> list[str]:
    shown = re.compile(r"(\s*(?:participant|actor)\s+\S+\s+as\s+)(.+)")
    message = re.compile(rf"(\s*[\w-]+\s*(?:{either(MESSAGE)})\s*[\w-]+\s*:\s*)(.+)")
    out = []
    for line in lines:
        if m := shown.fullmatch(line) or (message.fullmatch(line) if r.thorough else None):
            line = m[1] + r.quoted(m[2])
        out.append(line)
    return out


def parametrised(raw: str) -> tuple[str, str]:
    """A name with ``~`` parameters as it is shown, and its plain id."""
    name, *parameters = [x.strip() for x in re.findall(r"[^~,]+", raw) if x.strip()] or [raw]
    return f"{name}<{', '.join(parameters)}>" if parameters else name, name if plain(name) else re.sub(r"\W", "_", name)


def member(body: str, r: Repairs) -> str:
    """A member without its visibility: ``~`` types, then a name of several words ahead of its parameters or type."""

    def typed(m: re.Match) -> str:
        r.count += 1
        return parametrised(m[0])[0]

    body = TYPE.sub(typed, body)
    name, mark = body, ""
    for i, c in enumerate(body):
        if c in "(:":
            name, mark = body[:i], body[i:]
            break
    words = name.split()
    if mark and len(words) > 1 and all(re.fullmatch(r"\w+", w) for w in words):
        r.count += 1
        return f'"{" ".join(words)}"{mark}'
    return body


def called(name: str, r: Repairs) -> str:
    """The id by which a relation or a label calls a class."""
    own = r.aliases.get(name.strip('"'))
    if own is None or own == name:
        return name
    r.count += 1
    return own


def class_line(line: str, r: Repairs) -> str:
    indent, rest = re.fullmatch(r"(\s*)(.*)", line, re.S).groups()
    if m := re.fullmatch(r'class\s+"([^"]+)"\s*(\{?)\s*', rest):
        shown, own = parametrised(m[1])
        if "~" not in m[1]:
            return line
        r.count += 1
        return f'{indent}class "{shown}" as {own} {m[2]}'.rstrip()
    if not r.thorough:
        return line
    if m := re.fullmatch(r"class\s+([^\s\"]+)\s*\{(.*)", rest):
        return f"{indent}class {r.quoted(m[1])} {{{m[2]}" if not plain(m[1]) else line
    if rest[:1] and rest[0] in VISIBILITY and not ARROW.search(f" {rest}"):
        return indent + rest[0] + member(rest[1:], r)
    if arrow := ARROW.search(rest):
        left, (right, colon, label) = rest[: arrow.start()], rest[arrow.end() :].partition(" : ")
        label = f"{colon}{r.quoted(label.strip())}" if label.strip() else colon
        return f"{indent}{called(left.strip(), r)}{arrow[0]}{called(right.strip(), r)}{label}"
    if m := re.fullmatch(r'(\S+)(\s*:\s*"[^"]+"\s*)', rest):
        return indent + called(m[1], r) + m[2]
    return line


def classes(lines: list[str], r: Repairs) -> list[str]:
    for line in lines:
        if m := re.match(r'\s*class\s+"([^"]+)"(?:\s+as\s+(\w+))?', line):
            shown, own = parametrised(m[1])
            if m[2] or "~" in m[1]:
                r.aliases |= {m[1]: m[2] or own, shown: m[2] or own}
    return [class_line(line, r) for line in lines]


def entities(lines: list[str], r: Repairs) -> list[str]:
    out = []
    for line in lines:
        m = re.match(r"(\s*)([^\s{}|]\S*)", line)
        own = re.sub(r"\W+|_+", "_", m[2]).strip("_") if m else ""
        if own and not plain(m[2]):
            line = m[1] + own + line[m.end() :]
            r.count += 1
        out.append(line)
    return out


def fix(text: str, thorough: bool = True) -> tuple[str, int]:
    """A diagram's text repaired, and the number of repairs. thorough: the archived rules on top of the current ones."""
    first, r = (text.strip().splitlines() or [""])[0].strip(), Repairs(thorough)
    steps = {"flowchart": flowchart, "graph": flowchart, "sequenceDiagram": sequence, "classDiagram": classes}
    if thorough:
        steps["erDiagram"] = entities
    step = next((s for k, s in steps.items() if first.startswith(k)), None)
    return ("\n".join(step(text.split("\n"), r)), r.count) if step else (text, 0)


def fix_document(text: str, thorough: bool = True) -> tuple[str, int, int, int]:
    """A document with its diagrams repaired, how many it has, how many were changed, and the number of repairs."""
    n = {"blocks": 0, "changed": 0, "fixes": 0}

    def one(m: re.Match) -> str:
        new, fixes = fix(m[1], thorough)
        n["blocks"] += 1
        n["changed"] += new != m[1]
        n["fixes"] += fixes
        return f"```mermaid\n{new}```" if fixes else m[0]

    return FENCE.sub(one, text), n["blocks"], n["changed"], n["fixes"]


def repair(text: Column, thorough: bool = True) -> Column:
    """struct(text, blocks, changed, fixes)."""

    @F.pandas_udf("text string, blocks long, changed long, fixes long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([fix_document(t or "", thorough) for t in texts], columns=["text", "blocks", "changed", "fixes"])

    return run(text)


def blocks(text: Column, stem: Column) -> Column:
    """array of struct(block_id, text, diagram_type) of a document's diagrams, without Python."""
    all_ = F.regexp_extract_all(text, F.lit(r"(?s)```mermaid\s*\n(.*?)```"), F.lit(1))
    kind = lambda b: F.coalesce(F.nullif(F.regexp_extract(b, rf"\A\s*{KIND.pattern}", 1), F.lit("")), F.lit("unknown"))
    return F.transform(all_, lambda b, i: F.struct(F.concat(stem, F.lit(":"), i.cast("string")).alias("block_id"), b.alias("text"), kind(b).alias("diagram_type")))


def error_lines(message: Column) -> Column:
    """Line numbers that a validator's message names."""
    return F.transform(F.regexp_extract_all(message, F.lit(r"(?i)line\s*:?\s*(\d+)"), F.lit(1)), lambda x: x.cast("int"))


def numbered(diagram: Column) -> Column:
    """A diagram with its lines' numbers, as it is shown to whoever is to repair it."""
    return F.array_join(F.transform(F.split(diagram, "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x)), "\n")


def with_fix(document: Column, index: Column, diagram: Column) -> Column:
    """A document with its n-th diagram replaced by another (whose fence, if it has one, is taken off), without Python."""
    fence = FENCE.pattern.replace("([", "[").replace("?)", "?")
    bare = F.regexp_replace(F.regexp_replace(diagram, r"\A\s+|\s+\z", ""), r"\A```(?:mermaid)?\s*\n|\n?```\s*\z", "")
    new = F.concat(F.lit("```mermaid\n"), bare, F.lit("\n```"))
    pieces, old = F.split(document, fence, -1), F.regexp_extract_all(document, F.lit(f"({fence})"), F.lit(1))
    # Text and diagrams by turns; after the last text there is none.
    return F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.when(i == index, F.when(i < F.size(old), new)).otherwise(F.get(old, i)), F.lit("")))), "")
