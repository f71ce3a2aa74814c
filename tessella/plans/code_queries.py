"""Queries over source code. Every document becomes a source file in one of eight languages: its whole text as
comment lines, then a unit of known structure. The document's number decides the order of the unit's fragments,
how deep a call is nested in them and which literal they hold (with brackets, quotes and marks of comments),
and goes into names. What must come out is written down by fragment, and placed by the SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import code
from tessella.operators import graph
from tessella.plans import bind
from tessella.plans.oracle import TURNS, VFILES
from tessella.scratch import exists
from tessella.session import ship

#: By extension: what opens a comment line, what opens and closes a nesting, and four literals.
MARKS = {".py": "# "} | dict.fromkeys([".ts", ".tsx", ".js", ".go", ".rs", ".java", ".kt"], "// ")
NESTING = {".py": ("if lid: ", "")} | dict.fromkeys([".ts", ".tsx", ".js", ".java", ".kt"], ("if (lid) { ", " }")) | dict.fromkeys([".go", ".rs"], ("if lid > 0 { ", " }"))
SCRIPT = ["'}{'", "/[{}\"'`/]+/g", '`a ${f({ k: "}" })} {`', '"// no"']
LITERALS = {
    ".py": ['"}{"', "'# no'", '"""a "b" {"""', "r'\\d{2}'"],
    ".ts": SCRIPT, ".tsx": SCRIPT, ".js": SCRIPT,
    ".go": ['"}{"', '`raw " {`', "'}'", '"// no"'],
    ".rs": ['"}{"', "'{'", 'r#"a "b" {"#', 'b"//"'],
    ".java": ['"}{"', "'{'", '"// no"', '"\\"{"'],
    ".kt": ['"}{"', "'{'", '"a ${f("{")} }"', '"""a "b" {"""'],
}

#: By extension: a head, and three fragments whose order changes. @N@ is the document's number, @K@ its remainder by
#: seven, @L@ the literal, @O@ and @C@ the nesting.
BOX_TS = """/**
 * A box.
 * @param {number} size - how big
 * @returns {string} the lid
 */
export class Box@N@<T extends Map<string, T>> extends Base<T> {
  async open(lid: { a: T }, x = @L@): Promise<{ z: T }> {
    @O@helper@N@(lid);@C@
    return this.dao.find(lid);
  }
  get size() { return { at(k) { return deep@K@(k); } }; }
}

"""
BOX_JS = BOX_TS.replace("<T extends Map<string, T>> extends Base<T>", " extends Base").replace(": Promise<{ z: T }>", "").replace(": { a: T }", "")
HEAD_TS = """import { thing } from './mod@K@';
export * from "./all@K@";

"""
HELPER_TS = """/** Helps. */
export function helper@N@(a: string, re = /}"'/) {
  for (const i of a) { show(i); }
  return make@K@(a);
}

"""
UNITS = {
    ".py": [
        """import os
from .mod@K@ import thing

""",
        """class Box@N@:
    \"\"\"A box.

    Args:
        size (int): how big
    \"\"\"
    class In:
        def open(self, lid=@L@):
            @O@helper@N@(lid)
            return dao.find(lid)

""",
        """def helper@N@(a, b=None):
    \"\"\"Helps.

    Returns:
        the lid
    \"\"\"
    for i in a:
        def inner(): show(i)
    return make@K@(b)

""",
        """def twin(a):
    return first(a)

def twin(b):
    return second@K@(b)

""",
    ],
    ".ts": [
        HEAD_TS,
        BOX_TS,
        HELPER_TS,
        """const late@N@ = async <T,>(q: T): Promise<void> => { @O@log2(q, @L@);@C@ };
type U@N@ = { a: string } | (() => void);

""",
    ],
    ".tsx": [
        HEAD_TS,
        BOX_TS,
        HELPER_TS,
        """export const View@N@ = ({ a }: Props) => (
  <div onClick={() => pick@K@(a)} title='{'>it's {a} <b.C x={a}/> {fmt(a, @L@)}</div>
);

""",
    ],
    ".js": [
        HEAD_TS,
        BOX_JS,
        HELPER_TS.replace(": string", ""),
        """const late@N@ = async (q) => { @O@log2(q, @L@);@C@ };
const two@N@ = q => both@K@(q)

""",
    ],
    ".go": [
        """package main

import (
\t"fmt"
\tp@K@ "pkg/mod@K@"
)

""",
        """// Box@N@ is a box.
type Box@N@[T any] struct {
\tsize func() struct{}
}

// Deprecated: use Close.
func (b *Box@N@[T]) Open(lid int, x any) (map[string]struct{}, error) {
\t@O@helper@N@(lid, @L@)@C@
\treturn fmt.Sprint(lid), nil
}

""",
        """func helper@N@(a string, c interface{}) interface{ Do() } {
\tfor range a { show(a) }
\treturn make@K@(a)
}

""",
        """type (
\tA@N@ struct{ x int }
\tB@N@ interface { Do(x int) error }
)

""",
    ],
    ".rs": [
        """use crate::mod@K@::thing;
use std::{fmt, io};

""",
        """/// A box.
///
/// # Examples
/// open()
#[derive(Debug)]
pub struct Box@N@<'a, T: Into<Vec<T>>> where T: Fn(&'a str) -> u8 { size: &'a T }

impl<'a, T> fmt::Display for Box@N@<'a, T> {
    /* a /* nested { */ one */
    pub fn open(&self, lid: u32) -> Result<(), E> {
        @O@helper@N@(lid, @L@);@C@
        write!(f, "{}", hidden(1))?;
        self.close(); lid.find()
    }
}

""",
        """/// Helps.
/// # Arguments
/// * `a` - the number
/// # Returns
/// twice that
fn helper@N@<F>(a: u32, f: F) -> impl Iterator<Item = u32> where F: for<'x> Fn(&'x u8) {
    for i in 0..a { show(i); }
    make@K@(a)
}

""",
        """macro_rules! mk@N@ { ($n:ident) => { fn $n() { fn inner() { lost(1) } } }; }
pub trait Tr@N@ { fn sig(&self); fn dflt(&self) { plain(1) } }
enum En@N@ { A { x: u8 }, B }

""",
    ],
    ".java": [
        """package p;
import a.mod@K@.Thing;
import static x.y.Z.*;

""",
        """/** A box.
 * @param size how big
 * @return the lid
 */
@Ann(x = "}", y = {1, 2})
public class Box@N@<K extends Comparable<K>> extends Base<Map<K, List<K>>> {
  private Object o = new Object() { public String text() { return show("{"); } };
  @Override
  public <V> Map<K, List<V>> open(int lid, final List<? super V> b, Object x) throws E {
    @O@helper@N@(lid, @L@);@C@
    return dao.find(b, new Foo(lid));
  }
  abstract int[] none();
}

""",
        """interface In@N@ { int size(); default int two() { return make@K@(2); } }
record R@N@(int a, List<String> b) { int sum() { return add(a); } }

""",
        """enum Color@N@ { RED(1) { int v() { return one(1); } }, BLUE(2); final int n; Color@N@(int n) { this.n = n; } int get() { return n; } }

""",
    ],
    ".kt": [
        """package p
import a.mod@K@.Thing
import x.y.*

""",
        """/** A box. */
data class Box@N@<T : Comparable<T>>(val x: Int = 1, private var y: String) : Base<T>(x), I by z where T : Any {
    val s = "a ${if (x > 1) "n${g("{")}" else "}"} {"
    companion object { fun make() = Box@N@(1, "") }
    override fun <V> List<V>.open(lid: (Int) -> Unit, x: Any): Result<V>? {
        @O@helper@N@(lid, @L@)@C@
        return dao.find(lid)
    }
}

""",
        """/* a /* nested { */ one */
fun helper@N@(a: Int) = a
    .plus(1)
    .also { show(it) }

""",
        """object Single@N@ { fun one() { cut('}') } }
interface In@N@ { fun sig(); fun dflt() { plain(1) } }

""",
    ],
}
LANGUAGES = list(UNITS)


def sources(spark, sf) -> DataFrame:
    """(doc_id, path, ext, source): a file for each document with an id, in the language of its number."""
    n = F.col("doc_id")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    files = bind.vfiles(spark, sf).withColumn("ext", pick(LANGUAGES, n % len(LANGUAGES)))
    of = lambda table: F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("ext"))
    lines = F.array_join(F.transform(F.split(F.translate("text", "\r", " "), "\n"), lambda x: F.concat(of({k: [v] for k, v in MARKS.items()})[0], x)), "\n")
    parts = [of(UNITS)[0], *(F.element_at(of(UNITS), ((n + p) % 3 + 2).cast("int")) for p in range(3))]
    depth = F.expr("cast(doc_id div 4 % 3 as int)")
    depth = F.when(F.col("ext") == ".py", F.least(depth, F.lit(1))).otherwise(depth)
    values = {"@N@": n.cast("string"), "@K@": (n % 7).cast("string"), "@L@": F.element_at(of(LITERALS), (n % 4 + 1).cast("int")), "@O@": F.repeat(of(NESTING)[0], depth), "@C@": F.repeat(of(NESTING)[1], depth)}
    unit = F.concat(*parts)
    for mark, value in values.items():
        unit = F.replace(unit, F.lit(mark), value)
    path = F.concat(F.regexp_replace("path", r"\.[^./]+$", ""), F.col("ext"))
    return files.select("doc_id", path.alias("path"), "ext", F.concat(lines, F.lit("\n"), unit).alias("source"))


#: Stored results of parsing by application and folder: the queries below share them.
_stored: dict[tuple[str, str], DataFrame] = {}


def _parsed(spark, sf) -> DataFrame:
    key = spark.sparkContext.applicationId, sf
    known = _stored.get(key)
    rows, _stored[key] = code.parsed_once(sources(ship(spark), sf), "source", "ext", known if known is not None and exists(known) else None)
    return rows


def code_definitions(spark, sf):
    """Definitions with their places and classes; text before them moves the lines. Documents without id are left out."""
    return _parsed(spark, sf).select("doc_id", F.inline("definitions"))


def first_definitions(spark, sf):
    """Of definitions of one name in a file the first."""
    return code.first_of_file(_parsed(spark, sf).select("doc_id", F.inline("definitions")), "doc_id").select("doc_id", "name", "line")


def code_calls(spark, sf):
    """What each function calls, in order."""
    return _parsed(spark, sf).select("doc_id", F.inline("calls")).select("doc_id", "qname", "line", F.posexplode("calls").alias("pos", "callee"))


def call_graph(spark, sf):
    """The project's call graph; of equal names the last file's wins."""
    g = code.call_graph(_parsed(spark, sf).select(F.col("path").alias("file"), F.inline("calls")))
    return g.select("qname", F.array_join("calls", ",").alias("calls"), "file", "line")


def module_call_graph(spark, sf):
    """The rows of a call graph whose name is among a module's files: turns of conversations with even numbers."""
    calls = bind.calls(spark, sf).select(F.col("src").alias("qname"), "pos", "dst")
    files = bind.turns(spark, sf).where("conv_id % 2 = 0").select(bind.node().alias("file"))
    return graph.call_graph_of(calls, files)


def code_imports(spark, sf):
    """What each file imports, in order."""
    return _parsed(spark, sf).select("doc_id", F.posexplode("imports").alias("pos", "target"))


def doc_comments(spark, sf):
    """Doc comments of every kind with parameters, returns and examples."""
    params = F.array_join(F.transform("params", lambda p: F.concat_ws(":", p["name"], p["type"], p["description"])), ";")
    return _parsed(spark, sf).select("doc_id", F.inline("docs")).select("doc_id", "name", "type", "line", "description", params.alias("params"), F.coalesce("returns", F.lit("")).alias("returns"), F.array_join("examples", ";").alias("examples"))


def doc_markdown(spark, sf):
    """Each file's doc comments as Markdown, in both languages."""
    return _parsed(spark, sf).select("doc_id", code.markdown_of(F.col("docs")).alias("en"), code.markdown_of(F.col("docs"), zh=True).alias("zh"))


def code_metrics(spark, sf):
    """Complexity and important lines of every source file."""
    return _parsed(spark, sf).select("doc_id", "language", "complexity", "important_lines")


def import_resolution(spark, sf):
    """Imports beside a file, below the root and by bare names, resolved to files that exist."""
    rows = sources(spark, sf).select("doc_id", "path", "ext")
    n, whole = F.col("doc_id"), F.regexp_replace("path", r"\.[^./]+$", "")
    name = F.concat(F.lit("bare"), n.cast("string"))
    target = F.when(n % 4 == 0, F.concat(F.lit("./"), F.element_at(F.split(whole, "/"), -1))).when(n % 4 == 1, F.lit(".missing")).when(n % 4 == 2, whole).otherwise(name)
    inner = rows.where("doc_id % 4 = 3").select(F.inline(F.array_compact(F.array(
        F.when(n % 3 == 0, F.struct(F.concat(F.lit("src/"), name, "ext").alias("file"))),
        F.when(n % 5 == 0, F.struct(F.concat(F.lit("lib/"), name, F.lit("/__init__.py")).alias("file"))),
        F.when(n % 5 == 0, F.struct(F.concat(F.lit("lib/"), name, F.lit("/index.ts")).alias("file"))),
    ))))
    dirs = code.source_dirs(spark.createDataFrame([("src/a",), ("lib/b/c",), ("src",)], "path string"))
    return code.resolve_imports(rows.select(F.col("path").alias("source"), target.alias("target"), "ext"), rows.select(F.col("path").alias("file")).unionByName(inner), dirs)


QUERIES = {f.__name__: f for f in (code_definitions, first_definitions, code_calls, call_graph, module_call_graph, code_imports, doc_comments, doc_markdown, code_metrics, import_resolution)}

#: What must come out of a fragment, with lines counted from its first: extension, fragment, name, kind, first line, last line, parent.
BOX_OF_SCRIPT = [(1, "Box@N@", "class", 6, 12, ""), (1, "open", "method", 7, 10, "Box@N@"), (1, "size", "method", 11, 11, "Box@N@"), (1, "at", "method", 11, 11, "Box@N@"), (2, "helper@N@", "function", 2, 5, "")]
SCRIPTS = [".ts", ".tsx", ".js"]
DEFINED = [(e, *r) for e in SCRIPTS for r in BOX_OF_SCRIPT] + [
    (".py", 1, "Box@N@", "class", 1, 10, ""), (".py", 1, "In", "class", 7, 10, ""), (".py", 1, "open", "method", 8, 10, "Box@N@"), (".py", 2, "helper@N@", "function", 1, 9, ""), (".py", 2, "inner", "function", 8, 8, ""), (".py", 3, "twin", "function", 1, 2, ""), (".py", 3, "twin", "function", 4, 5, ""),
    (".ts", 3, "late@N@", "function", 1, 1, ""), (".ts", 3, "U@N@", "type", 2, 2, ""), (".tsx", 3, "View@N@", "function", 1, 3, ""), (".js", 3, "late@N@", "function", 1, 1, ""), (".js", 3, "two@N@", "function", 2, 2, ""),
    (".go", 1, "Box@N@", "struct", 2, 4, ""), (".go", 1, "Open", "method", 7, 10, "Box@N@"), (".go", 2, "helper@N@", "function", 1, 4, ""), (".go", 3, "A@N@", "struct", 2, 2, ""), (".go", 3, "B@N@", "interface", 3, 3, ""),
    (".rs", 1, "Box@N@", "struct", 6, 6, ""), (".rs", 1, "open", "method", 10, 14, "Box@N@"), (".rs", 2, "helper@N@", "function", 6, 9, ""), (".rs", 3, "Tr@N@", "trait", 2, 2, ""), (".rs", 3, "dflt", "function", 2, 2, ""), (".rs", 3, "En@N@", "enum", 3, 3, ""),
    (".java", 1, "Box@N@", "class", 5, 14, ""), (".java", 1, "text", "method", 7, 7, "Box@N@"), (".java", 1, "open", "method", 8, 12, "Box@N@"), (".java", 1, "none", "method", 13, 13, "Box@N@"),
    (".java", 2, "In@N@", "interface", 1, 1, ""), (".java", 2, "size", "function", 1, 1, ""), (".java", 2, "two", "function", 1, 1, ""), (".java", 2, "R@N@", "record", 2, 2, ""), (".java", 2, "sum", "function", 2, 2, ""), (".java", 3, "Color@N@", "enum", 1, 1, ""), (".java", 3, "v", "function", 1, 1, ""), (".java", 3, "get", "function", 1, 1, ""),
    (".kt", 1, "Box@N@", "class", 2, 9, ""), (".kt", 1, "make", "method", 4, 4, "Box@N@"), (".kt", 1, "open", "method", 5, 8, "Box@N@"), (".kt", 2, "helper@N@", "function", 2, 4, ""),
    (".kt", 3, "Single@N@", "object", 1, 1, ""), (".kt", 3, "one", "function", 1, 1, ""), (".kt", 3, "In@N@", "interface", 2, 2, ""), (".kt", 3, "sig", "method", 2, 2, "In@N@"), (".kt", 3, "dflt", "method", 2, 2, "In@N@"),
]
#: Extension, fragment, qualified name, line, calls.
CALLED_IN_SCRIPT = [(1, "Box@N@.open", 7, "helper@N@,dao.find"), (1, "Box@N@.size", 11, "deep@K@"), (1, "Box@N@.at", 11, "deep@K@"), (2, "helper@N@", 2, "show,make@K@")]
CALLED = [(e, *r) for e in SCRIPTS for r in CALLED_IN_SCRIPT] + [
    (".py", 1, "Box@N@.open", 8, "helper@N@,dao.find"), (".py", 2, "helper@N@", 1, "show,make@K@"), (".py", 2, "inner", 8, "show"), (".py", 3, "twin", 1, "first"), (".py", 3, "twin", 4, "second@K@"),
    (".ts", 3, "late@N@", 1, "log2"), (".tsx", 3, "View@N@", 1, "pick@K@,fmt"), (".js", 3, "late@N@", 1, "log2"), (".js", 3, "two@N@", 2, "both@K@"),
    (".go", 1, "Box@N@.Open", 7, "helper@N@,fmt.Sprint"), (".go", 2, "helper@N@", 1, "show,make@K@"),
    (".rs", 1, "Box@N@.open", 10, "helper@N@,lid.find"), (".rs", 2, "helper@N@", 6, "show,make@K@"), (".rs", 3, "dflt", 2, "plain"),
    (".java", 1, "Box@N@.text", 7, "show"), (".java", 1, "Box@N@.open", 8, "helper@N@,find,dao.find"), (".java", 1, "Box@N@.none", 13, ""), (".java", 2, "size", 1, ""), (".java", 2, "two", 1, "make@K@"), (".java", 2, "sum", 2, "add"), (".java", 3, "v", 1, "one"), (".java", 3, "get", 1, ""),
    (".kt", 1, "Box@N@.make", 4, "Box@N@"), (".kt", 1, "Box@N@.open", 5, "helper@N@,dao.find"), (".kt", 2, "helper@N@", 2, "show,a.plus"), (".kt", 3, "one", 1, "cut"), (".kt", 3, "In@N@.sig", 2, ""), (".kt", 3, "In@N@.dflt", 2, "plain"),
]
IMPORTED = [(".py", 0, "os"), (".py", 1, ".mod@K@"), *((e, p, t) for e in SCRIPTS for p, t in enumerate(("./mod@K@", "./all@K@"))), (".go", 0, "fmt"), (".go", 1, "pkg/mod@K@"), (".rs", 0, "mod@K@::thing"), (".rs", 1, "std"), (".java", 0, "a.mod@K@.Thing"), (".java", 1, "x.y.Z"), (".kt", 0, "a.mod@K@.Thing"), (".kt", 1, "x.y")]
#: Extension, fragment, name, type, line, description, parameters, returns, examples.
DOCUMENTED = [
    *((e, 1, "Box@N@", "class", 1, "A box.", "size:number:how big", "string: the lid", "") for e in SCRIPTS), *((e, 2, "helper@N@", "function", 1, "Helps.", "", "", "") for e in SCRIPTS),
    (".py", 1, "Box@N@", "class", 1, "A box.", "size:int:how big", "", ""), (".py", 2, "helper@N@", "function", 1, "Helps.", "", "the lid", ""),
    (".go", 1, "Box@N@", "type", 1, "Box@N@ is a box.", "", "", ""), (".go", 1, "Open", "method", 6, "[Deprecated] use Close.", "", "", ""),
    (".rs", 1, "Box@N@", "type", 1, "A box.", "", "", "open()"), (".rs", 2, "helper@N@", "function", 1, "Helps.", "a:any:the number", "twice that", ""),
    (".java", 1, "Box@N@", "class", 1, "A box.", "size:any:how big", "the lid", ""), (".kt", 1, "Box@N@", "class", 1, "A box.", "", "", ""),
]
#: Extension, language, lines of code, control flow without the nesting, definitions that count, lines of note.
MEASURED = [(".py", "python", 23, 1, 7, 9), (".ts", "typescript", 15, 1, 2, 6), (".tsx", "typescript", 16, 1, 2, 5), (".js", "javascript", 15, 1, 2, 6), (".go", "go", 20, 1, 2, 5), (".rs", "rust", 17, 1, 7, 9), (".java", "java", 16, 0, 10, 9), (".kt", "kotlin", 16, 1, 8, 9)]
#: How many nestings of a unit there are for each level of depth.
NESTED = {".py": 1, ".ts": 2, ".tsx": 1, ".js": 2, ".go": 1, ".rs": 1, ".java": 1, ".kt": 1}


def values(rows: list[tuple]) -> str:
    """Rows of SQL literals."""
    one = lambda x: str(x) if isinstance(x, int) else "E'" + x.replace("'", "''").replace("\n", "\\n") + "'"
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def filled(column: str) -> str:
    return f"replace(replace({column}, '@N@', doc_id::VARCHAR), '@K@', (doc_id % 7)::VARCHAR)"


def lines_of(text: str) -> int:
    return text.count("\n")


#: s: the source files, and how many lines stand before the unit; f: their fragments, and how many lines stand before each.
SOURCED = f"""{VFILES},
n AS (SELECT *, list_extract([{", ".join(f"'{e}'" for e in LANGUAGES)}], CAST(doc_id % {len(LANGUAGES)} AS INT) + 1) AS ext FROM vfiles),
s AS (SELECT doc_id, regexp_replace(path, '\\.[^./]+$', '') || ext AS path, ext AS extension, length(text) - length(replace(text, E'\\n', '')) + 1 AS above, text FROM n)"""
PLACED = f"""{SOURCED},
l AS (SELECT * FROM (VALUES {values([(e, k, lines_of(u)) for e, unit in UNITS.items() for k, u in enumerate(unit)])}) v(extension, frag, lines)),
p AS (SELECT s.doc_id, s.path, s.extension, s.above, range AS p, CASE WHEN range = 0 THEN 0 ELSE (s.doc_id + range - 1) % 3 + 1 END AS frag FROM s CROSS JOIN range(4)),
f AS (SELECT doc_id, path, extension, p, frag, above + sum(lines) OVER (PARTITION BY doc_id ORDER BY p) - lines AS before FROM p JOIN l USING (extension, frag))"""
CALLS = f"""{PLACED}, c AS (SELECT doc_id, path, {filled("q")} AS qname, (l + before)::INT AS line, {filled("callees")} AS callees FROM f JOIN (VALUES {values(CALLED)}) v(extension, frag, q, l, callees) USING (extension, frag))"""
DOCS = f"""{PLACED}, d AS (SELECT doc_id, p, {filled("n")} AS name, type, (a + before)::INT AS line, {filled("d")} AS description, params, returns, examples
        FROM f JOIN (VALUES {values(DOCUMENTED)}) v(extension, frag, n, type, a, d, params, returns, examples) USING (extension, frag))"""

ORACLE_SQL = {
    "code_definitions": f"""WITH {PLACED} SELECT doc_id, {filled("n")} AS name, kind, (a + before)::INT AS line, (b + before)::INT AS end_line, {filled("p_")} AS parent
        FROM f JOIN (VALUES {values(DEFINED)}) v(extension, frag, n, kind, a, b, p_) USING (extension, frag)""",
    "first_definitions": f"""WITH {PLACED} SELECT doc_id, {filled("n")} AS name, min(a + before)::INT AS line FROM f JOIN (VALUES {values(DEFINED)}) v(extension, frag, n, kind, a, b, p_) USING (extension, frag) GROUP BY ALL""",
    "code_calls": f"WITH {CALLS}, x AS (SELECT doc_id, qname, line, string_split(callees, ',') AS cs FROM c WHERE callees <> '') SELECT doc_id, qname, line, unnest(range(len(cs)))::INT AS pos, unnest(cs) AS callee FROM x",
    "call_graph": f"""WITH {CALLS} SELECT qname, callees AS calls, path AS file, line FROM c QUALIFY row_number() OVER (PARTITION BY qname ORDER BY path DESC, line) = 1""",
    "module_call_graph": f"""WITH {TURNS}, d AS (SELECT a.node AS qname, (b.k - a.k - 1)::INT AS pos, b.node AS dst FROM noded a JOIN noded b ON a.conv_id = b.conv_id AND b.k - a.k BETWEEN 1 AND 2 WHERE a.conv_id % 2 = 0) SELECT * FROM d""",
    "code_imports": f"WITH {SOURCED} SELECT doc_id, pos::INT AS pos, {filled('t')} AS target FROM s JOIN (VALUES {values(IMPORTED)}) v(extension, pos, t) USING (extension)",
    "doc_comments": f"WITH {DOCS} SELECT doc_id, name, type, line, description, params, returns, examples FROM d",
    "doc_markdown": f"""WITH {DOCS}, e AS (
          SELECT doc_id, line, '### `' || name || '` (' || type || E')\\n\\n' || description || E'\\n'
            || CASE WHEN params <> '' THEN E'\\n**Parameters**\\n\\n- `' || split_part(params, ':', 1) || '` (' || split_part(params, ':', 2) || '): ' || split_part(params, ':', 3) || E'\\n' ELSE '' END
            || CASE WHEN returns <> '' THEN E'\\n**Returns**: ' || returns || E'\\n' ELSE '' END
            || CASE WHEN examples <> '' THEN E'\\n**Examples**\\n\\n```\\n' || examples || E'\\n```\\n' ELSE '' END AS t FROM d),
        m AS (SELECT doc_id, string_agg(t, E'\\n' ORDER BY line) AS en FROM e GROUP BY doc_id)
        SELECT doc_id, en, replace(replace(replace(en, '**Parameters**', '**参数**'), '**Returns**', '**返回值**'), '**Examples**', '**示例**') AS zh FROM m""",
    "code_metrics": f"""WITH {SOURCED} SELECT doc_id, language, least((2 * (flow + least(doc_id // 4 % 3, CASE extension WHEN '.py' THEN 1 ELSE 2 END) * nested) + counted) * 100 // loc, 100)::INT AS complexity,
          (lines + len(list_filter(string_split(text, E'\\n'), lambda x: regexp_matches(x, '(?:TODO|FIXME|HACK|NOTE|WARN|XXX)\\s*[:\\(]'))))::INT AS important_lines
        FROM s JOIN (VALUES {values([(*m, NESTED[m[0]]) for m in MEASURED])}) v(extension, language, loc, flow, counted, lines, nested) USING (extension)""",
    "import_resolution": f"""WITH {SOURCED}, i AS (SELECT doc_id, extension, path AS source, regexp_replace(path, '\\.[^./]+$', '') AS whole FROM s)
        SELECT source, './' || regexp_extract(whole, '[^/]+$') AS target, source AS file FROM i WHERE doc_id % 4 = 0
        UNION ALL SELECT source, whole, source FROM i WHERE doc_id % 4 = 2
        UNION ALL SELECT source, 'bare' || doc_id, 'src/bare' || doc_id || extension FROM i WHERE doc_id % 4 = 3 AND doc_id % 3 = 0
        UNION ALL SELECT source, 'bare' || doc_id, 'lib/bare' || doc_id || '/index.ts' FROM i WHERE doc_id % 4 = 3 AND doc_id % 5 = 0""",
}
