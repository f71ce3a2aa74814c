"""Languages with braces. Values that a user expects of documentation comments are written down by hand."""

import random

import pytest

from tessella.functions import braces, code


def names(text, ext):
    return [(d["name"], d["kind"], d["line"], d["end_line"], d["parent"]) for d in code.parse(text, ext)["definitions"]]


def calls(text, ext):
    return {c["qname"]: c["calls"] for c in code.parse(text, ext)["calls"]}


def doc(text, ext):
    (found,) = code.parse(text, ext)["docs"]
    return found


def test_calls_of_methods():
    text = "class UserService {\n  async createUser(dto) {\n    const hash = await bcrypt.hash(dto.password, 10);\n    return this.userDao.insert(dto);\n  }\n}\n"
    assert calls(text, ".ts") == {"UserService.createUser": ["bcrypt.hash", "userDao.insert"]}
    assert calls("def create_user(dto):\n    hashed = bcrypt.hashpw(dto.password, bcrypt.gensalt())\n    return user_dao.insert(dto)\n", ".py") == {"create_user": ["bcrypt.hashpw", "bcrypt.gensalt", "user_dao.insert"]}
    assert code.parse("", ".ts")["calls"] == []


def test_doc_comments_of_scripts():
    d = doc("/**\n * Adds two numbers.\n */\nfunction add(a, b) { return a + b; }", ".js")
    assert (d["name"], d["type"], d["description"], d["line"]) == ("add", "function", "Adds two numbers.", 1)
    d = doc("/**\n * Greets.\n * @param {string} name - The person's name\n */\nfunction greet(name) {}", ".js")
    assert d["params"] == [{"name": "name", "type": "string", "description": "The person's name"}]
    assert doc("/**\n * Squares.\n * @returns {number} the square of x\n */\nconst square = (x) => x * x;", ".js")["returns"] == "number: the square of x"
    assert doc("/** A user. */\nclass User {}", ".js")["type"] == "class"
    assert doc("/** Can be stored. */\ninterface Serializable { s(): string }", ".ts")["type"] == "interface"
    d = doc("/** Fetches.\n * @param {string} url - where\n */\nexport async function fetchData(url: string) {}", ".ts")
    assert (d["name"], d["type"], d["params"][0]["name"]) == ("fetchData", "function", "url")
    assert code.parse("// no\nfunction f() {}\n/* nor */\nfunction g() {}", ".js")["docs"] == []


def test_doc_comments_of_go_java_rust():
    assert (doc("package m\n// Sum returns the sum.\nfunc Sum(a int) int { return a }", ".go")["type"], doc("package m\n\n// Config holds it.\ntype Config struct { A int }", ".go")["type"]) == ("function", "type")
    assert doc("package m\n// Deprecated: use NewFunc instead.\nfunc OldFunc() {}", ".go")["description"] == "[Deprecated] use NewFunc instead."
    for word, name in (("class", "Account"), ("interface", "Repository"), ("enum", "Color")):
        d = doc(f"/**\n * A thing.\n */\npublic {word} {name} {{ }}", ".java")
        assert (d["name"], d["type"], d["description"]) == (name, word, "A thing.")
    d = doc("/**\n * Makes.\n * @param name the username\n * @param age the age\n * @return it\n */\npublic class User { }", ".java")
    assert d["params"] == [{"name": "name", "type": "any", "description": "the username"}, {"name": "age", "type": "any", "description": "the age"}] and d["returns"] == "it"
    d = doc("/// Greets.\n///\n/// # Arguments\n///\n/// * `name` - The person to greet\n/// * `times` - How often\n///\n/// # Returns\n///\n/// The number of greetings\n/// # Panics\n/// Never.\npub fn greet(name: &str, times: u32) -> u32 { times }", ".rs")
    assert [p["name"] for p in d["params"]] == ["name", "times"] and d["returns"] == "The number of greetings" and d["description"] == "Greets. [Panics] Never."
    assert doc("/// A point.\n#[derive(Debug)]\npub struct Point { x: f64 }", ".rs")["type"] == "type"
    assert any("assert_eq" in e for e in doc("/// Roots.\n/// # Examples\n/// assert_eq!(r, 5.0);\nfn root() {}", ".rs")["examples"])


def test_strings_templates_and_regular_expressions_hold_no_code():
    text = "const re = /[{(\"'`]/g; let q = a / b / c;\nfunction f() { return `x ${g(`${ h({ k: '}' }) }`)} {`; }\nif (a) /}/.test(b);\nconst s = 'it\\'s {';\nfunction z() {}\n"
    assert names(text, ".js") == [("f", "function", 2, 2, ""), ("z", "function", 5, 5, "")]
    assert names('package m\nfunc f() { a := `{ " ` + "}" + string(\'{\') }\nfunc g() {}\n', ".go") == [("f", "function", 2, 2, ""), ("g", "function", 3, 3, "")]
    assert names("fn f<'a>(x: &'a str) { let c = '{'; let s = r##\"}\"# {\"##; /* /* { */ */ }\nfn g() {}\n", ".rs") == [("f", "function", 1, 1, ""), ("g", "function", 2, 2, "")]
    assert names('class A { String s = """\n  { "x" \\""" {\n  """; char c = \'{\'; void m() { } }', ".java") == [("A", "class", 1, 3, ""), ("m", "method", 3, 3, "A")]
    assert names('fun f() = "a ${ if (x) "{" else g("}") } $b {"\nval r = """ { " ${h()} """\nfun g() {}\n', ".kt") == [("f", "function", 1, 1, ""), ("g", "function", 3, 3, "")]


def test_markup():
    text = "export default function App({ items }: Props) {\n  const n = items.length < 3 && two > one(1);\n  return <ul title=\"{\" {...rest}>don't {items.map((i) => <Item key={i} name='}'/>)} <>a } b</> </ul>;\n}\nconst g = <T,>(x: T) => { h2(x); };\n"
    text = text.replace("a } b", "a b")
    assert names(text, ".tsx") == [("App", "function", 1, 4, ""), ("g", "function", 5, 5, "")]
    assert calls(text, ".tsx") == {"App": ["one", "items.map"], "g": ["h2"]}
    # In a file without markup '<' compares or opens types.
    assert names("const f = (a) => a <b> (c)\nfunction g() {}", ".ts") == [("f", "function", 1, 1, ""), ("g", "function", 2, 2, "")]


def test_nested_generics_and_types():
    text = "export class A<K extends Map<string, Array<K>>> extends B<C<K>> {\n  a(x: { b: () => void }): Promise<{ c: { d: K } }> { go(); }\n  b?(y: string): void;\n  static async *c<T>(z = { k: [1] }): AsyncGenerator<T> {}\n  private f = (e) => { no(); };\n}\n"
    assert names(text, ".ts") == [("A", "class", 1, 6, ""), ("a", "method", 2, 2, "A"), ("c", "method", 4, 4, "A")]
    assert names("class A { <T extends Comparable<? super T>> Map<T, List<int[]>> m(List<T> a) throws E { } A() { } int x = f(1); abstract void n(); }", ".java") == [("A", "class", 1, 1, ""), ("m", "method", 1, 1, "A"), ("n", "method", 1, 1, "A")]
    assert names("impl<T: Into<Vec<T>>> a::Tr<T> for b::Own<T> where T: Fn() -> u8 { fn m(&self) -> Box<dyn Fn(u8) -> u8> { x1() } }", ".rs") == [("m", "method", 1, 1, "Own")]
    assert names("func (s *Set[K]) Add(k K, f func() struct{}) (map[K]struct{}, interface{ M() }) {\n}\nfunc asm(x int) int\nfunc z() {\n}", ".go") == [("Add", "method", 1, 2, "Set"), ("asm", "function", 3, 3, ""), ("z", "function", 4, 5, "")]
    assert names("class A<T : Map<K, List<V>>>(val x: () -> Unit = { f() }) : B<T>(x), I by y {\n  inline fun <reified V> T.m(b: (V) -> Unit = {}): List<V>\n    where V : Any { }\n  fun e() =\n    when (x) { else -> 1 }\n}", ".kt") == [("A", "class", 1, 6, ""), ("m", "method", 2, 3, "A"), ("e", "method", 4, 5, "A")]


def test_macros_hold_no_definitions_or_calls():
    text = "macro_rules! m { ($a:ident) => { fn $a() { fn inner() {} } }; }\nfn f() { println!(\"{}\", g(1)); vec![h(2)]; if !(k(3)) { run(4) } }"
    assert names(text, ".rs") == [("f", "function", 2, 2, "")]
    assert calls(text, ".rs") == {"f": ["run"]}


@pytest.mark.parametrize(("ext", "text"), [(".ts", "function f() { return (1; }"), (".go", "package m\nfunc f() {"), (".rs", "fn f() { /* /* */ }"), (".java", 'class A { String s = "x; }'), (".kt", 'fun f() = "${a"'), (".py", "def f(:")])
def test_texts_with_errors_have_no_definitions(ext, text):
    got = code.parse(text, ext)
    assert got["definitions"] == [] and got["calls"] == [] and got["imports"] == []


def test_any_text_is_read_to_its_end():
    r = random.Random(11)
    parts = list("{}()[]<>'\"`/\\#$!@;:,.=-+*&|? \n\t") + ["//", "/*", "*/", "${", "=>", "fn ", "func ", "class A ", "fun f", "function g", "r#\"", '"""', "impl ", "type T ", "enum E", "import ", "é", "\x00", "x", "1.5", "</", "<b"]
    for _ in range(3000):
        text = "".join(r.choices(parts, k=r.randrange(60)))
        for ext in (".ts", ".tsx", ".go", ".rs", ".java", ".kt"):
            lang = code.LANGUAGE_OF[ext]
            t = braces.READERS[lang](text, ext in braces.TAGGED)
            t.read()
            assert all(t.t.source.startswith(w, a) for w, a in zip(t.t.text, t.t.start, strict=True) if w not in ("/>", "{"))
            code.parse(text, ext)


def test_time_grows_with_the_text():
    """Nothing is read twice: unclosed brackets and quotes by the thousand."""
    import time

    for text in ("{" * 20_000, "<a>" * 20_000, "`${" * 10_000, "a<" * 20_000, "x = (" * 10_000, "/*" * 20_000):
        for ext in (".tsx", ".rs", ".kt", ".java", ".go"):
            began = time.time()
            code.parse(text, ext)
            assert time.time() - began < 10, (text[:4], ext)


def test_equal_sources_are_parsed_once(spark, monkeypatch):
    rows = [(1, ".go", "package m\nfunc a() {}"), (2, ".go", "package m\nfunc a() {}"), (3, ".rs", "fn b() {}"), (4, ".go", None)]
    df = spark.createDataFrame(rows, "id int, ext string, source string")
    got, table = code.parsed_once(df, "source", "ext")
    assert table.count() == 3 and sorted((r["id"], [d["name"] for d in r["definitions"]]) for r in got.collect()) == [(1, ["a"]), (2, ["a"]), (3, ["b"]), (4, [])]
    more = df.union(spark.createDataFrame([(5, ".rs", "fn c() {}")], df.schema))
    got, after = code.parsed_once(more, "source", "ext", table)
    assert after.count() == 4 and sorted(r["id"] for r in got.collect()) == [1, 2, 3, 4, 5]
    again, same = code.parsed_once(more, "source", "ext", after)
    assert same is after and again.count() == 5
