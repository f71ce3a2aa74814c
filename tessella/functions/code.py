"""Parsing of source files: definitions, calls, imports, doc comments, complexity.

Python is parsed by its own grammar, the languages with braces by tokens (``braces``). A file with a syntax
error has no definitions, calls or imports; its measures fall back to lines. ``parsed`` gives it all as one Arrow
column; ``parsed_once`` keeps the results in a stored table by content, so that equal sources, and later
queries over the same ones, are parsed once.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tessella.functions.braces import READERS, TAGGED
from tessella.functions.rules import LANGUAGE_OF, MAX_CALLS, NOT_CALLS
from tessella.scratch import materialise

SCHEMA = "language string, definitions array<struct<name:string,kind:string,line:int,end_line:int,parent:string>>, calls array<struct<qname:string,line:int,calls:array<string>>>, imports array<string>, docs array<struct<name:string,type:string,description:string,params:array<struct<name:string,type:string,description:string>>,returns:string,examples:array<string>,line:int>>, complexity int, important_lines int"

OPEN_WORK = re.compile(r"(?:TODO|FIXME|HACK|NOTE|WARN|XXX)\s*[:\(]")


def qualified(name: str, parent: str) -> str:
    return f"{parent}.{name}" if parent else name


def tidy_calls(names: list[str], own: str) -> list[str]:
    """Distinct calls in order without keywords, one-letter names and the function itself, the first few; plain ones first."""
    plain = [n for n in names if "." not in n and len(n) > 1 and n not in NOT_CALLS]
    dotted = [f"{o}.{a}" for o, _, a in (n.removeprefix("this.").removeprefix("self.").rpartition(".") for n in names if "." in n) if o and a not in NOT_CALLS and o not in NOT_CALLS]
    return [n for n in dict.fromkeys(plain + dotted) if n != own][:MAX_CALLS]


def parse_python(text: str) -> dict:
    tree = ast.parse(text)
    definitions, calls, imports, docs, control, marked = [], [], [], [], 0, set()

    def dotted(node: ast.AST) -> str:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute):
            inner = dotted(node.value)
            return f"{inner}.{node.attr}" if inner else ""
        return ""

    def walk(node: ast.AST, parent: str, top: bool = False) -> None:
        """parent: the outermost class around."""
        nonlocal control
        for child in ast.iter_child_nodes(node):
            inside = parent
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if parent else "function"
                d = {"name": child.name, "kind": kind, "line": child.lineno, "end_line": child.end_lineno, "parent": "" if kind == "class" else parent}
                definitions.append(d)
                marked.add(child.lineno)
                marked.update(x.lineno for x in child.decorator_list)
                if top and (doc := ast.get_docstring(child)):
                    docs.append({"name": child.name, "type": kind, "line": child.lineno, **python_doc(doc)})
                if kind == "class":
                    inside = parent or child.name
                else:
                    found = [dotted(c.func) for s in child.body for c in ast.walk(s) if isinstance(c, ast.Call)]
                    own = qualified(child.name, parent)
                    calls.append({"qname": own, "line": child.lineno, "calls": tidy_calls([f for f in found if f], own)})
            elif isinstance(child, ast.Import):
                imports.extend(a.name for a in child.names)
                marked.add(child.lineno)
            elif isinstance(child, ast.ImportFrom):
                imports.append("." * child.level + (child.module or ""))
                marked.add(child.lineno)
            elif isinstance(child, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match, ast.ExceptHandler)):
                control += 1
            walk(child, inside)

    walk(tree, "", True)
    if doc := ast.get_docstring(tree):
        docs.insert(0, {"name": "module", "type": "module", "line": 1, **python_doc(doc)})
    definitions.sort(key=lambda d: (d["line"], d["name"]))
    return {"definitions": definitions, "calls": calls, "imports": list(dict.fromkeys(imports)), "docs": docs, "_control": control, "_counted": len(definitions), "_marked": marked}


#: Headings of a docstring's sections.
SECTIONS = {"params": ["Args:", "Arguments:", "Parameters:", "参数:", "参数："], "returns": ["Returns:", "Return:", "返回:", "返回值：", "返回值:"], "examples": ["Example:", "Examples:", "示例:", "示例："]}
SECTION_OF = {head: part for part, heads in SECTIONS.items() for head in heads}


def _doc(description: list[str], params: list[dict] = (), returns: str | None = None, examples: list[str] = ()) -> dict:
    return {"description": " ".join(description).strip(), "params": list(params), "returns": returns, "examples": list(examples)}


def _param(name: str, kind: str, description: str) -> dict:
    return {"name": name, "type": kind, "description": description}


def python_doc(doc: str) -> dict:
    """A docstring with sections of arguments, returns and examples; any other heading ends a section."""
    parts: dict[str, list[str]] = {"description": [], "params": [], "returns": [], "examples": [], "other": []}
    section = "description"
    for line in map(str.strip, doc.split("\n")):
        if line in SECTION_OF or line.endswith(":") and ":" not in line[:-1]:
            section = SECTION_OF.get(line, "other")
        else:
            parts[section].append(line)
    found = [m for line in parts["params"] if (m := re.match(r"(\w+)\s*(?:\(([^)]+)\))?\s*:\s*(.*)", line))]
    return _doc(parts["description"], [_param(m[1], m[2] or "Any", m[3]) for m in found], " ".join(filter(None, parts["returns"])) or None, parts["examples"])


def tagged_doc(raw: str, java: bool) -> dict:
    """A block comment with @param, @returns and @example tags. Java's parameters have no types, and it has no examples."""
    description, params, returns, examples = [], [], None, []
    for line in raw.strip().removeprefix("/**").removesuffix("*/").split("\n"):
        line = line.strip().removeprefix("*").strip()
        if line.startswith("@param"):
            m = re.match(r"@param\s+(\w+)\s+-?\s*(.*)" if java else r"@param\s+(?:\{([^}]+)\}\s+)?\[?(\w+)[^\s]*\s*-?\s*(.*)", line)
            if m:
                params.append(_param(m[1], "any", m[2]) if java else _param(m[2], m[1] or "", m[3]))
        elif line.startswith("@return"):
            m = re.match(r"@returns?\s+(.*)" if java else r"@returns?\s+(?:\{([^}]+)\}\s*)?(.*)", line)
            if m:
                returns = m[1] if java or not m[1] else f"{m[1]}: {m[2]}"
                returns = returns if java or m[1] else m[2]
        elif line.startswith("@example") and not java:
            examples.append(line.removeprefix("@example").strip())
        elif not line.startswith("@"):
            if examples:
                examples[-1] += "\n" + line if examples[-1] else line
            else:
                description.append(line)
    return _doc(description, params, returns, [e.strip() for e in examples])


def go_doc(lines: list[str]) -> dict:
    lines = [x.lstrip("/").strip() for x in lines]
    return _doc([f"[Deprecated] {x.removeprefix('Deprecated:').strip()}" if x.startswith("Deprecated:") else x for x in lines])


#: Sections of Rust's doc comments; those of None stay in the description as marks.
RUST_SECTIONS = {"examples": "examples", "example": "examples", "arguments": "params", "parameters": "params", "args": "params", "returns": "returns", "return": "returns", "panics": None, "errors": None, "safety": None}


def rust_doc(lines: list[str]) -> dict:
    parts: dict[str, list[str]] = {"description": [], "params": [], "returns": [], "examples": []}
    section = "description"
    for line in (x.removeprefix("///").removeprefix(" ") for x in lines):
        if line.startswith("# "):
            section = RUST_SECTIONS.get(line[2:].strip().lower(), "description") or "description"
            if RUST_SECTIONS.get(line[2:].strip().lower(), "") is None:
                parts["description"].append(f"[{line[2:].strip()}]")
        else:
            parts[section].append(line)
    found = [m for x in parts["params"] if (m := re.match(r"[*-]?\s*`?(\w+)`?\s*[-:]\s*(.*)", x.strip()))]
    return _doc(list(filter(None, parts["description"])), [_param(m[1], "any", m[2]) for m in found], " ".join(x.strip() for x in parts["returns"] if x.strip()) or None, parts["examples"])


#: What a doc entry's type is called, where it isn't the definition's kind.
ENTRY_TYPE = {"go": {"struct": "type", "interface": "type"}, "rust": {"struct": "type", "trait": "interface", "method": "function"}, "java": {"record": "type", "method": "function"}, "kotlin": {"method": "function"}}


def doc_of(comments: list[tuple[str, int, int]], lang: str) -> tuple[int, dict] | None:
    """(line, doc) of the comments (text, first line, last line) before a definition."""
    if lang in ("go", "rust"):
        mark, kept = "//" if lang == "go" else "///", []
        for c in reversed(comments):
            if not c[0].startswith(mark) or kept and c[2] < kept[-1][1] - 1:
                break
            kept.append(c)
        lines = [c[0].rstrip() for c in reversed(kept)]
        return (kept[-1][1], go_doc(lines) if lang == "go" else rust_doc(lines)) if kept else None
    for text, line, _ in reversed(comments):
        if text.startswith("/**") and text.endswith("*/"):
            return line, tagged_doc(text, lang in ("java", "kotlin"))
        if text.startswith("/*") and lang in ("java", "kotlin"):
            return None
    return None


def parse_braces(text: str, lang: str, ext: str) -> dict:
    reader = READERS[lang](text, ext in TAGGED)
    found, line = reader.read(), reader.t.line
    definitions = [{"name": d.name, "kind": d.kind, "line": line[d.first], "end_line": line[d.last], "parent": d.parent} for d in found["definitions"]]
    calls = []
    for d, names in found["calls"]:
        own = qualified(d.name, d.parent)
        calls.append({"qname": own, "line": line[d.first], "calls": tidy_calls(names, own)})
    docs = []
    for d, comments in found["docs"]:
        if doc := doc_of(comments, lang):
            docs.append({"name": d.name, "type": ENTRY_TYPE.get(lang, {}).get(d.kind, d.kind), "line": doc[0], **doc[1]})
    order = lambda d: (d["line"], d["name"])
    return {"definitions": sorted(definitions, key=order), "calls": calls, "imports": found["imports"], "docs": docs, "_control": found["control"], "_counted": found["counted"], "_marked": found["marked"]}


def parse(text: str | None, ext: str | None) -> dict:
    """Everything that one source file tells; unknown languages have their filled lines as important ones."""
    text, lang = text or "", LANGUAGE_OF.get(ext or "")
    nothing = {"language": lang, "definitions": [], "calls": [], "imports": [], "docs": [], "complexity": 0, "important_lines": 0}
    if not text.strip():
        return nothing
    filled = [x for x in text.split("\n") if x.strip()]
    if lang is None:
        return nothing | {"important_lines": len(filled)}
    try:
        found = parse_python(text) if lang == "python" else parse_braces(text, lang, ext)
    except (SyntaxError, ValueError, RecursionError):
        return nothing | {"important_lines": len(filled)}
    loc = sum(1 for x in filled if not x.strip().startswith(("#", "//", "/*", "*")))
    marked = found.pop("_marked") | {i + 1 for i, x in enumerate(text.split("\n")) if OPEN_WORK.search(x)}
    control, counted = found.pop("_control"), found.pop("_counted")
    return nothing | found | {"complexity": min((control * 2 + counted) * 100 // max(loc, 1), 100), "important_lines": len(marked)}


FIELDS = ["language", "definitions", "calls", "imports", "docs", "complexity", "important_lines"]


def parsed(text: Column, ext: Column) -> Column:
    """The struct of SCHEMA for a column of source text and its extension."""
    types = to_arrow_schema(_parse_datatype_string(SCHEMA))

    @F.arrow_udf(SCHEMA)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, exts in batches:
            rows = [parse(t, e) for t, e in zip(texts.to_pylist(), exts.to_pylist(), strict=True)]
            yield pa.StructArray.from_arrays([pa.array([r[name] for r in rows], types.field(name).type) for name in FIELDS], FIELDS)

    return run(text, ext)


def parsed_once(sources: DataFrame, text: str, ext: str, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sources with the columns of SCHEMA in place of text, the table of results by content).

    Of equal contents one is parsed, and none that `stored`, such a table of an earlier call, has. The
    table's key is the digest of extension and text; what isn't new is neither parsed nor written again.
    """
    key = F.sha2(F.concat_ws("\0", F.coalesce(ext, F.lit("")), F.coalesce(text, F.lit(""))), 256)
    keyed = sources.withColumn("content", key)
    new = keyed if stored is None else keyed.join(stored.select("content"), "content", "left_anti")
    found = new.groupBy("content").agg(F.first(F.struct(F.col(text).alias("text"), F.col(ext).alias("ext"))).alias("s"))
    made = materialise(found.select("content", parsed(F.col("s.text"), F.col("s.ext")).alias("p")).select("content", "p.*"), "parsed")
    table = made if stored is None else stored if made.isEmpty() else stored.unionByName(made)
    return keyed.drop(text).join(table, "content").drop("content"), table


#: The suffixes that an import from a file of a suffix may stand for, and files that stand for their folder.
STANDS_FOR = {".py": [".py", ".pyi"], ".ts": [".ts", ".tsx"], ".tsx": [".tsx", ".ts"], ".js": [".js", ".jsx", ".mjs", ".cjs"], ".go": [".go"], ".rs": [".rs"], ".java": [".java", ".kt"], ".kt": [".kt", ".java"]}
FOLDER_FILES = ["index.ts", "index.tsx", "index.js", "index.jsx", "__init__.py", "mod.rs", "lib.go"]
USUAL_DIRS = ["src", "lib", "pkg", "app", "internal", "cmd"]


def source_dirs(modules: DataFrame) -> list[str]:
    """The top folders of modules (path), in order; the usual ones if there are none."""
    found = modules.select(F.split("path", "/")[0].alias("d")).where("d <> ''").distinct().collect()
    return sorted(r["d"] for r in found) or USUAL_DIRS


def resolve_imports(imports: DataFrame, files: DataFrame, dirs: list[str]) -> DataFrame:
    """(source, target, file): the project's files (file) that imports (source, target, ext) stand for.

    A bare name stands for a file and for a folder of that name in each source folder, a name that begins with a
    dot for a file beside the source, one with slashes for a file below the root; of the possible suffixes and
    folder files the first that exists counts. Imports that stand for no file give no row.
    """
    exts = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in STANDS_FOR.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("ext")), F.array("ext"))
    target, folder = F.col("target"), F.regexp_replace("source", r"/?[^/]*$", "")
    with_ext = lambda base, place: F.transform(exts, lambda e, i: F.struct(place.alias("place"), i.alias("tier"), F.concat(base, e).alias("file")))
    bare = []
    for n, d in enumerate(dirs):
        own = F.concat(F.lit(f"{d}/"), target)
        bare += [with_ext(own, F.lit(2 * n)), F.array(*[F.struct(F.lit(2 * n + 1).alias("place"), F.lit(i).alias("tier"), F.concat(own, F.lit(f"/{f}")).alias("file")) for i, f in enumerate(FOLDER_FILES)])]
    beside = F.regexp_replace(F.concat(folder, F.lit("/"), F.regexp_replace(F.translate(target, ".", "/"), "^/+", "")), "^/+|/+$", "")
    relative = F.array(F.struct(F.lit(0).alias("place"), F.lit(0).alias("tier"), F.concat(beside, F.col("ext")).alias("file")))
    rooted = with_ext(F.regexp_replace("target", r"(?<=[^/])\.[^./]+$", ""), F.lit(0))
    none = F.slice(relative, 1, 0)
    tries = F.when(target.startswith("."), relative).when(target.contains("/"), F.when(target.rlike(r"[*?\[]"), none).otherwise(rooted)).when(target.contains("."), none).otherwise(F.concat(*bare) if bare else none)
    met = imports.select("source", "target", F.inline(tries)).join(files.select("file").distinct(), "file")
    return met.groupBy("source", "target", "place").agg(F.min_by("file", "tier").alias("file")).select("source", "target", "file").distinct()


def first_of_file(definitions: DataFrame, file: str) -> DataFrame:
    """Of definitions of one name in a file the first; columns name and line among others."""
    rest = [c for c in definitions.columns if c not in (file, "name")]
    return definitions.groupBy(file, "name").agg(F.min_by(F.struct(*rest), "line").alias("r")).select(file, "name", "r.*")


def call_graph(calls: DataFrame) -> DataFrame:
    """(qname, calls, file, line) of calls (file, qname, line, calls): of equal names the last file's first one."""
    return calls.groupBy("qname").agg(F.max_by(F.struct("calls", "file", "line"), F.struct("file", -F.col("line"))).alias("r")).select("qname", "r.*")


def markdown_of(docs: Column, zh: bool = False) -> Column:
    """Doc entries of one file as Markdown, without Python."""
    label = {"params": "参数", "returns": "返回值", "examples": "示例"} if zh else {"params": "Parameters", "returns": "Returns", "examples": "Examples"}
    kind = lambda p: F.when(p["type"] != "", F.concat(F.lit(" ("), p["type"], F.lit(")"))).otherwise("")

    def entry(e: Column) -> Column:
        params = F.array_join(F.transform(e["params"], lambda p: F.concat(F.lit("- `"), p["name"], F.lit("`"), kind(p), F.lit(": "), p["description"])), "\n")
        return F.concat(
            F.lit("### `"), e["name"], F.lit("` ("), e["type"], F.lit(")\n\n"), F.coalesce(e["description"], F.lit("")), F.lit("\n"),
            F.when(F.size(e["params"]) > 0, F.concat(F.lit(f"\n**{label['params']}**\n\n"), params, F.lit("\n"))).otherwise(""),
            F.when(F.coalesce(e["returns"], F.lit("")) != "", F.concat(F.lit(f"\n**{label['returns']}**: "), e["returns"], F.lit("\n"))).otherwise(""),
            F.array_join(F.transform(e["examples"], lambda x: F.concat(F.lit(f"\n**{label['examples']}**\n\n```\n"), x, F.lit("\n```\n"))), ""),
        )

    return F.array_join(F.transform(docs, entry), "\n")
