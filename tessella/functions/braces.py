"""Languages with braces, read by tokens: JavaScript, TypeScript (and the tags in either), Go, Rust, Java, Kotlin.

``scan`` is a pushdown tokenizer: what is open (brackets, template strings, tags and the code inside of both)
lies on a stack, which says how the next character is read. It gives code tokens, comments, each
bracket's partner and the bracket around each token. ``read`` passes once over the tokens and asks the language's
rules whether a definition begins at each; what encloses it follows from the brackets. A text whose brackets
or strings don't close has an error, as far as these rules can see, and gives no definitions or calls.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

NAME, NUMBER, TEXT, SIGN = "name", "number", "text", "sign"

#: What the languages' grammars say about literals and names.
QUOTED = r'"(?:\\[\s\S]|[^"\\\n])*"'
RUNE = r"'(?:\\[^\n]{1,9}?|[^'\\\n])'"
LITERALS = {
    "javascript": rf"{QUOTED}|'(?:\\[\s\S]|[^'\\\n])*'",
    "go": rf"`[^`]*`|{QUOTED}|{RUNE}",
    "rust": r'(?:br|cr|r)(?P<fence>#*)"[\s\S]*?"(?P=fence)|[bc]?"(?:\\[\s\S]|[^"\\])*"|b?' + RUNE + r"|'[^\W\d]\w*",
    "java": rf'"""(?:\\[\s\S]|[^\\])*?"""|{QUOTED}|{RUNE}',
    "kotlin": RUNE,
}
NAMES = {"javascript": r"#?(?:[^\W\d]|\$)[\w$]*", "rust": r"(?:r#)?[^\W\d]\w*", "kotlin": r"`[^`\n]+`|[^\W\d]\w*"}
SIGNS = r"=>|->|::|\?\.(?!\d)|\.\.\.|===|!==|==|!=|<=|>=|&&|\|\||\?\?|[^\s]"
NESTED_COMMENTS = ("rust", "kotlin")
#: What is inside a string with code in it, up to its end or a hole.
INSIDE = {"`": re.compile(r"(?:\\[\s\S]|[^`\\$]|\$(?!\{))*"), '"': re.compile(r'(?:\\.|[^"\\$\n]|\$(?!\{))*'), '"""': re.compile(r'(?:[^"$]|\$(?!\{)|"(?!""))*')}
IN_TAG, IN_MARKUP = re.compile(r"""(?:[^"'{<>/=]|=>?|/(?!>)|"[^"]*"|'[^']*')*"""), re.compile(r"[^<{]*")
TAG = re.compile(r"<(?:>|[A-Za-z_$][\w$.:-]*(?=[\s/>])(?!\s*(?:,|extends\b)))")
REGULAR = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
#: Words after which an expression begins, and after whose brackets a statement does.
BEFORE_VALUE = set("return typeof case in of delete void throw new do else await yield instanceof default".split())
BEFORE_STATEMENT = {"if", "while", "for", "with"}
CLOSES = {")": "(", "]": "[", "}": "{"}
TAGGED = (".tsx", ".jsx", ".js")

MASTER = {
    lang: re.compile(rf"(?P<space>\s+)|(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<text>{lit})|(?P<name>{NAMES.get(lang, r'[^\W\d]\w*')})|(?P<number>\d\w*(?:\.\d\w*)?)|(?P<sign>{SIGNS})")
    for lang, lit in LITERALS.items()
}


@dataclass
class Tokens:
    """Parallel lists, one entry a token. pair: the partner of a bracket, or -1; around: the bracket around, or -1."""

    source: str
    kind: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    line: list[int] = field(default_factory=list)
    pair: list[int] = field(default_factory=list)
    around: list[int] = field(default_factory=list)
    #: (text, first line, last line, the token that follows)
    comments: list[tuple[str, int, int, int]] = field(default_factory=list)
    broken: bool = False

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.text) and self.kind[i] == NAME

    def end(self, i: int) -> int:
        return self.start[i] + len(self.text[i])


def _value_may_follow(t: Tokens) -> bool:
    """Whether an expression may begin after the last token: a slash then opens a regular expression, '<' a tag."""
    if not t.text:
        return True
    last, kind = t.text[-1], t.kind[-1]
    if kind == NAME:
        return last in BEFORE_VALUE
    if kind in (NUMBER, TEXT) or last == "]":
        return False
    if last == ")":
        return t.at(t.pair[-1] - 1) in BEFORE_STATEMENT
    if last == "}":
        return not t.source[t.source.rfind("\n", 0, t.start[-1]) + 1 : t.start[-1]].strip()
    return not (last in "+-" and t.text[-2:-1] == [last] and t.start[-2] + 1 == t.start[-1])


def scan(source: str, lang: str, tagged: bool = False) -> Tokens:
    """lang: one of LITERALS. tagged: '<' may open markup in JavaScript."""
    t, rx, js, kotlin = Tokens(source), MASTER[lang], lang == "javascript", lang == "kotlin"
    #: What is open, innermost last: a bracket, a kind of string, 'tag' or 'markup'; and its token.
    open_: list[tuple[str, int]] = []
    #: The brackets among it.
    brackets: list[int] = [-1]
    at, line, size = 0, 1, len(source)

    def add(kind: str, text: str) -> None:
        t.kind.append(kind), t.text.append(text), t.start.append(at), t.line.append(line), t.pair.append(-1)
        t.around.append(brackets[-1])

    def push(what: str, text: str, kind: str = SIGN) -> None:
        add(kind, text)
        open_.append((what, len(t.text) - 1))
        if what in ("(", "[", "{"):
            brackets.append(len(t.text) - 1)

    while at < size:
        mode = open_[-1][0] if open_ else ""
        if mode in INSIDE or mode in ("tag", "markup"):
            m = (INSIDE.get(mode) or (IN_TAG if mode == "tag" else IN_MARKUP)).match(source, at)
            line, at = line + m[0].count("\n"), m.end()
            if mode in INSIDE:
                if source.startswith(mode, at):
                    open_.pop()
                    add(TEXT, mode)
                    at += len(mode)
                    while mode == '"""' and source.startswith('"', at):
                        at += 1
                elif source.startswith("${", at):
                    at += 1
                    push("{", "{")
                    at += 1
                else:
                    t.broken = True
                    open_.pop()
            elif source.startswith("{", at):
                push("{", "{")
                at += 1
            elif mode == "tag" and source.startswith("/>", at) or mode == "markup" and source.startswith("</", at):
                end = at + 1 if mode == "tag" else source.find(">", at)
                open_.pop()
                line += source.count("\n", at, end)
                at = end + 1 if end >= 0 else size
                add(TEXT, "/>")
                t.broken |= end < 0
            elif mode == "tag" and source.startswith(">", at):
                open_[-1] = ("markup", open_[-1][1])
                at += 1
            elif m2 := TAG.match(source, at):
                push("markup" if m2[0] == "<>" else "tag", m2[0], TEXT)
                at = m2.end()
            else:
                t.broken = True
                at += 1
            continue
        m = rx.match(source, at)
        kind, word = m.lastgroup if m.lastgroup != "fence" else TEXT, m[0]
        if kind == "space":
            pass
        elif kind == "line":
            t.comments.append((word, line, line, len(t.text)))
        elif kind == "block":
            end = source.find("*/", at + 2)
            if lang in NESTED_COMMENTS:
                depth, end = 0, -1
                for x in re.compile(r"/\*|\*/").finditer(source, at):
                    depth += 1 if x[0] == "/*" else -1
                    if not depth:
                        end = x.start()
                        break
            t.broken |= end < 0
            word = source[at : end + 2] if end >= 0 else source[at:]
            t.comments.append((word, line, line + word.count("\n"), len(t.text)))
        elif js and word == "/" and _value_may_follow(t) and (r := REGULAR.match(source, at)):
            word = r[0]
            add(TEXT, word)
        elif js and word == "<" and tagged and _value_may_follow(t) and (r := TAG.match(source, at)):
            word = r[0]
            push("markup" if word == "<>" else "tag", word, TEXT)
        elif js and word == "`" or kotlin and word == '"':
            word = '"""' if kotlin and source.startswith('"""', at) else word
            push(word, word, TEXT)
        elif kind == SIGN and word in "([{":
            push(word, word)
        elif kind == SIGN and word in CLOSES:
            if open_ and open_[-1][0] == CLOSES[word]:
                other = open_.pop()[1]
                brackets.pop()
                add(SIGN, word)
                t.pair[-1], t.pair[other] = other, len(t.text) - 1
            else:
                t.broken = True
                add(SIGN, word)
        else:
            # A quote that opens no string that closes on its line.
            t.broken |= kind == SIGN and word in "\"'"
            add(kind, word)
        line, at = line + word.count("\n"), at + len(word)
    t.broken |= bool(open_)
    return t


#: Words of the languages that look like calls, or open control flow, or stand before a declaration.
WORDS = {
    "javascript": "if for while switch catch function return typeof await yield of in new super import delete void do else case throw with instanceof",
    "go": "if for switch select func return range go defer case map chan interface struct type var const make new",
    "rust": "if for while loop match fn return in let mut as where impl dyn move unsafe ref else",
    "java": "if for while switch catch try synchronized return new throw super this assert else case do instanceof",
    "kotlin": "if for while when catch return throw fun in is as else do try super this constructor init typealias val var",
}
WORDS = {k: set(v.split()) for k, v in WORDS.items()}
WORDS["go"] -= {"make", "new"}
CONTROL = {"javascript": {"if", "for", "while", "switch", "try", "catch"}, "go": {"if", "for", "switch", "select"}, "rust": {"if", "for", "while", "loop", "match"}, "java": {"if", "for", "while", "switch", "try", "catch"}, "kotlin": {"if", "for", "while", "when", "try", "catch"}}
BEFORE = {
    "javascript": set("export default async abstract declare static get set public private protected readonly override accessor".split()),
    "rust": set("pub async unsafe const extern default".split()),
    "java": set("public protected private static final abstract synchronized native default strictfp transient volatile sealed non".split()),
    "kotlin": set("public protected private internal open abstract final override inline suspend operator infix tailrec external data sealed enum inner annotation value companion lateinit const expect actual fun".split()),
}
#: Signs and words after which a line goes on.
GOES_ON = set("= ( [ { , => ? : && || ?? + - * / % & | ^ ! < . ?. -> :: === == != !== <= >= ...".split()) | {"return", "new", "typeof", "extends", "in", "of", "implements", "case", "await", "else", "as", "is", "by", "where"}
#: Signs and words with which a line goes on.
GOES_ON_WITH = set(". ?. ? : && || ?? * / % | ^ = => , ) ] } -> :: === == != !== <= >= ?:".split()) | {"else", "as", "in", "instanceof", "is", "catch", "finally"}


@dataclass
class Definition:
    """first: its first token (of modifiers, too); body: the range of tokens that its calls lie in; inner: its body's bracket."""

    name: str
    kind: str
    word: int
    first: int
    last: int
    body: tuple[int, int] = (0, 0)
    inner: int = -1
    parent: str = ""
    hidden: bool = False


class Reader:
    """Definitions, calls, imports and measures of one text. Subclasses have a language's rules."""

    lang = ""
    #: Kinds of definitions whose names stand before those inside.
    qualifies: tuple[str, ...] = ("class",)

    def __init__(self, source: str, tagged: bool = False):
        self.t = scan(source, self.lang, tagged)
        self.n = len(self.t.text)
        #: The body's bracket of a type, to the type.
        self.types: dict[int, Definition] = {}
        #: Tokens that are no code of this language (the insides of macros).
        self.passed = bytearray(self.n)
        self.names: set[int] = set()
        self.closed = self.paired_angles()

    # Steps over tokens.

    def over(self, i: int) -> int:
        """The token after i, or after the bracket that i opens."""
        return self.t.pair[i] + 1 if self.t.text[i] in ("(", "[", "{") and self.t.kind[i] == SIGN and self.t.pair[i] > i else i + 1

    def angles(self, i: int) -> int:
        """The token after the type parameters that open at i; i if there are none."""
        return self.closed.get(i, i)

    def paired_angles(self) -> dict[int, int]:
        """For each '<' with a '>' at its level, the token after that; what no type holds ends a level's hopes."""
        out, levels = {}, [[]]
        for i, word in enumerate(self.t.text):
            if self.t.kind[i] != SIGN:
                continue
            if word == "<":
                levels[-1].append(i)
            elif word == ">" and levels[-1]:
                out[levels[-1].pop()] = i + 1
            elif word in ("(", "[", "{"):
                levels.append([])
            elif word in CLOSES:
                levels.pop()
                levels = levels or [[]]
            elif word in (";", "&&", "||"):
                levels[-1].clear()
        return out

    def new_line(self, i: int) -> bool:
        """Whether i begins a line on which nothing goes on."""
        return 0 < i < self.n and self.t.line[i] > self.t.line[i - 1] + self.t.text[i - 1].count("\n") and self.t.text[i - 1] not in GOES_ON and self.t.text[i] not in GOES_ON_WITH

    def starts(self, i: int) -> bool:
        """Whether a statement may begin at i."""
        return i == 0 or self.t.text[i - 1] in (";", "{", "}", ")", "]") or self.t.line[i] > self.t.line[i - 1] and self.t.text[i - 1] not in GOES_ON

    def from_modifiers(self, i: int) -> int:
        """The first of the modifiers, with their brackets, and annotations before i."""
        t, before = self.t, BEFORE.get(self.lang, ())
        while i > 0:
            p = t.pair[i - 1] if t.text[i - 1] == ")" else i
            if t.text[i - 1] in before:
                i -= 1
            elif t.at(i - 2) == "@" and t.is_name(i - 1) or self.lang == "rust" and t.kind[i - 1] == TEXT and t.at(i - 2) == "extern":
                i -= 2
            elif 0 <= p < i and self.lang in ("java", "kotlin") and t.is_name(p - 1) and (q := self.back_chain(p - 1)) and t.at(q - 1) == "@":
                i = q - 1
            elif 0 <= p < i and t.at(p - 1) == "pub":
                i = p - 1
            else:
                break
        return i

    def back_chain(self, i: int) -> int:
        """The first name of the chain of names and dots that ends at i."""
        while self.t.at(i - 1) in (".", "?.") and self.t.is_name(i - 2):
            i -= 2
        return i

    def expression_end(self, i: int) -> int:
        """The last token of the expression that begins at i."""
        at = i
        while at < self.n and self.t.text[at] not in (";", ",", ")", "]", "}") and (at == i or not self.new_line(at)):
            at = self.over(at)
        return max(i, at - 1)

    # What the languages say.

    def define(self, i: int) -> Definition | None:
        raise NotImplementedError

    def imports(self) -> list[str]:
        raise NotImplementedError

    def marks(self, i: int) -> bool:
        """Whether what begins at i makes its line one to read, definitions apart."""
        return False

    def noted(self, d: Definition) -> bool:
        """Whether a definition's line is one to read."""
        return True

    def counts(self, d: Definition) -> bool:
        """Whether a definition counts for complexity."""
        return True

    def callee(self, i: int) -> list[str]:
        """What is called by the name at i, which brackets follow: of a chain of two names both."""
        first = self.back_chain(i)
        if self.t.at(first - 1) in (".", "?."):
            return []
        return [self.t.text[i]] if first == i else [f"{self.t.text[first]}.{self.t.text[i]}"] if first == i - 2 else []

    def called_at(self, i: int) -> bool:
        return self.t.at(i + 1) == "("

    # The pass.

    def block(self, name: str, kind: str, word: int, at: int, stop: tuple[str, ...] = (";",), **more) -> Definition | None:
        """A definition whose body's bracket comes at or after `at`, if one comes before what ends it."""
        while at < self.n and self.t.text[at] != "{":
            if self.t.text[at] in stop:
                return None
            skipped = self.angles(at)
            at = skipped if skipped > at else self.over(at)
        if at >= self.n or self.t.pair[at] < 0:
            return None
        return Definition(name, kind, word, self.from_modifiers(word), self.t.pair[at], (at + 1, self.t.pair[at]), at, **more)

    def read(self) -> dict:
        t, found, scopes = self.t, [], []
        marked, control = set(), 0
        for i in range(self.n):
            while scopes and i > scopes[-1].last:
                scopes.pop()
            if self.passed[i]:
                continue
            if t.kind[i] == NAME and t.text[i] in CONTROL[self.lang] and self.controls(i):
                control += 1
            d = self.define(i) if i not in self.names else None
            if d:
                outer = next((s.name for s in scopes if s.kind in self.qualifies), "")
                d.parent = d.parent or ("" if d.kind in ("class", "interface", "enum", "struct", "type", "record", "object", "trait") and self.lang != "go" else outer)
                if d.kind == "function" and d.parent:
                    d.kind = "method"
                found.append(d)
                self.names.add(i)
                if d.inner >= 0:
                    scopes.append(d)
                    scopes.sort(key=lambda s: -s.last)
            elif self.marks(i):
                marked.add(t.line[i])
        if t.broken:
            return {"definitions": [], "calls": [], "imports": [], "docs": [], "control": control, "counted": 0, "marked": marked}
        marked.update(t.line[d.first] for d in found if self.noted(d))
        shown = [d for d in found if not d.hidden]
        return {"definitions": shown, "calls": self.calls(shown), "imports": list(dict.fromkeys(self.imports())), "docs": self.doc_blocks(shown), "control": control, "counted": sum(map(self.counts, found)), "marked": marked}

    def controls(self, i: int) -> bool:
        return self.t.at(i - 1) not in (".", "?.", "::") and self.t.at(i + 1) not in (":", "=", ",")

    def calls(self, definitions: list[Definition]) -> list[tuple[Definition, list[str]]]:
        spots = [i for i in range(self.n - 1) if self.t.kind[i] == NAME and self.called_at(i) and i not in self.names and not self.passed[i] and self.t.text[i] not in WORDS[self.lang]]
        names = [self.callee(i) for i in spots]
        out = []
        for d in definitions:
            if d.kind in ("function", "method"):
                a, b = bisect_left(spots, d.body[0]), bisect_left(spots, d.body[1])
                out.append((d, [x for own in names[a:b] for x in own]))
        return out

    def doc_blocks(self, definitions: list[Definition]) -> list[tuple[Definition, list[tuple[str, int, int]]]]:
        """The comments right before each definition that nothing encloses."""
        before: dict[int, list[tuple[str, int, int]]] = {}
        for text, a, b, follows in self.t.comments:
            before.setdefault(follows, []).append((text, a, b))
        return [(d, before[first]) for d in definitions if self.t.around[d.word] < 0 and (first := self.doc_start(d)) in before]

    def doc_start(self, d: Definition) -> int:
        return d.first


class JavaScript(Reader):
    """And TypeScript, which plain JavaScript differs from in what makes a line one to read."""

    lang = "javascript"
    typed_script = False

    def after_type(self, i: int) -> int:
        """The token after a type that ':' opens at i; i if there is none."""
        if self.t.at(i) != ":":
            return i
        at, last = i + 1, ":"
        while at < self.n:
            word = self.t.text[at]
            if word == "{" and last not in (":", "|", "&", "=>", "<", ",", "is", "extends", "?"):
                break
            if word in (";", ",", ")", "]", "}", "=") or self.new_line(at) and word != "{":
                break
            skipped = self.angles(at)
            at = skipped if skipped > at else self.over(at)
            last = self.t.text[at - 1]
        return at

    def callable(self, name: str, kind: str, word: int, at: int, first: int | None = None) -> Definition | None:
        """A definition whose parameters (or what stands before them) come at `at`, if a body follows."""
        at = self.angles(at)
        if self.t.at(at) != "(" or self.t.pair[at] < 0:
            return None
        body = self.after_type(self.t.pair[at] + 1)
        if self.t.at(body) != "{" or self.t.pair[body] < 0:
            return None
        return Definition(name, kind, word, self.from_modifiers(word) if first is None else first, self.t.pair[body], (body + 1, self.t.pair[body]))

    def define(self, i: int) -> Definition | None:
        t = self.t
        word, kind, before = t.text[i], t.kind[i], t.at(i - 1)
        if before in (".", "?."):
            return None
        if kind == NAME and t.is_name(i + 1) or word == "function":
            first = self.from_modifiers(i)
            if word == "class" and self.starts(first) and t.text[i + 1] not in ("extends", "implements"):
                d = self.block(t.text[i + 1], "class", i, i + 2)
                return self.typed(d)
            if word == "function" and self.starts(first):
                at = i + 2 if t.at(i + 1) == "*" else i + 1
                if t.is_name(at):
                    self.names.add(at)
                    return self.callable(t.text[at], "function", i, at + 1)
            if word in ("const", "let", "var") and self.starts(first):
                return self.assigned(i)
            if word == "enum" and before == "const":
                first = self.from_modifiers(i - 1)
            if word in ("interface", "enum") and self.starts(first):
                d = self.typed(self.block(t.text[i + 1], word, i, i + 2))
                if d:
                    d.first = first
                return d
            if word == "type" and self.starts(first) and t.at(self.angles(i + 2)) == "=":
                return Definition(t.text[i + 1], "type", i, first, self.expression_end(self.angles(i + 2) + 1))
        owner = t.around[i]
        if owner < 0 or t.text[owner] != "{" or not (kind in (NAME, TEXT) or word == "["):
            return None
        name, at = (t.source[t.start[i] : t.end(t.pair[i])], t.pair[i] + 1) if word == "[" and t.pair[i] > i else (word.strip("\"'") if kind == TEXT else word, i + 1)
        at += t.at(at) == "?"
        if t.at(self.angles(at)) != "(" or word in WORDS["javascript"]:
            return None
        first = i
        while t.at(first - 1) in ("static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "declare", "accessor", "*"):
            first -= 1
        mine = owner in self.types and self.types[owner].kind == "class"
        fits = (self.starts(first) or t.line[first] > t.line[first - 1]) and t.at(first - 1) not in ("=", "=>", "+", "(", ",", "?", ":") if mine else t.at(first - 1) in ("{", ",")
        return self.callable(name, "method" if mine else "function", i, at, first) if fits else None

    def typed(self, d: Definition | None) -> Definition | None:
        if d:
            self.types[d.inner] = d
        return d

    def assigned(self, i: int) -> Definition | None:
        """A function that a name is declared to be."""
        t, name = self.t, i + 1
        at = self.after_type(name + 1)
        if t.at(at) != "=":
            return None
        at += 1
        at += t.at(at) == "async"
        if t.at(at) == "function":
            at += 1 + (t.at(at + 1) == "*")
            return self.callable(t.text[name], "function", i, at + t.is_name(at))
        at = self.angles(at)
        arrow = at + 1 if t.is_name(at) else t.pair[at] + 1 if t.at(at) == "(" and t.pair[at] > 0 else -1
        if arrow > 0 and t.at(arrow) == ":":
            while arrow < self.n and t.text[arrow] not in ("=>", ";", "=") and not self.new_line(arrow):
                skipped = self.angles(arrow)
                arrow = skipped if skipped > arrow else self.over(arrow)
        if arrow < 0 or t.at(arrow) != "=>" or arrow + 1 >= self.n:
            return None
        body = arrow + 1
        last = t.pair[body] if t.text[body] == "{" else self.expression_end(body)
        return Definition(t.text[name], "function", i, self.from_modifiers(i), last, (body, last + 1))

    def callee(self, i: int) -> list[str]:
        t, first = self.t, self.back_chain(i)
        if t.at(first - 1) in (".", "?.", "new"):
            return []
        parts = [t.text[k] for k in range(first, i + 1, 2)]
        parts = parts[1:] if parts[0] == "this" else parts
        return [".".join(parts)] if len(parts) > 1 or first == i else []

    def called_at(self, i: int) -> bool:
        at = i + 1 + (self.t.at(i + 1) == "?.")
        return self.t.at(at) == "(" or self.t.at(i + 1) == "<" and self.angles(i + 1) > i + 1 and self.t.at(self.angles(i + 1)) == "("

    def imports(self) -> list[str]:
        t, out = self.t, []
        for i in range(self.n):
            word = t.text[i]
            if word in ("require", "import") and t.at(i + 1) == "(" and t.at(i - 1) != "." and i + 2 < self.n and t.kind[i + 2] == TEXT:
                out.append(t.text[i + 2])
            elif word in ("import", "export") and t.kind[i] == NAME and self.starts(i) and t.at(i + 1) not in ("(", "."):
                at = i + 1
                while at < self.n and t.text[at] not in (";", "=", "function", "class", "const", "let", "var") and t.kind[at] != TEXT and not (at > i + 1 and self.new_line(at)):
                    at = self.over(at)
                if at < self.n and t.kind[at] == TEXT and (t.at(at - 1) == "from" or word == "import" and at == i + 1):
                    out.append(t.text[at])
        return [x.strip("\"'`") for x in out if x.strip("\"'`")]

    def marks(self, i: int) -> bool:
        t, word = self.t, self.t.text[i]
        if word in ("import", "export"):
            return self.starts(i) and t.at(i + 1) not in ("(", ".")
        if word in ("const", "let"):
            return t.is_name(i) and (self.starts(i) or t.at(i - 1) == "export") or t.at(i - 1) == "(" and t.at(i - 2) == "for" and ";" in t.text[i : t.pair[i - 1]]
        # In plain JavaScript, statements that assign.
        if self.typed_script or not t.is_name(i) or not self.starts(i) or t.at(i - 1) == ")" or t.around[i] in self.types or t.around[i] >= 0 and t.text[t.around[i]] != "{":
            return False
        while t.at(i + 1) in (".", "[") and (t.is_name(i + 2) or t.text[i + 1] == "["):
            i = i + 2 if t.text[i + 1] == "." else t.pair[i + 1]
        return t.at(i + 1) == "="

    def noted(self, d: Definition) -> bool:
        return self.t.text[d.word] in ("class", "function", "const", "let", "interface", "type", "enum")

    def counts(self, d: Definition) -> bool:
        return d.kind == "class" or self.t.text[d.word] == "function"

    def controls(self, i: int) -> bool:
        t = self.t
        after_do = t.text[i] == "while" and t.at(i - 1) == "}" and t.at(t.pair[i - 1] - 1) == "do"
        return super().controls(i) and not after_do and t.around[i] not in self.types


class TypeScript(JavaScript):
    typed_script = True


class Go(Reader):
    lang = "go"

    def signature_end(self, at: int) -> int:
        """The body's bracket after parameters that open at `at`, or -1."""
        t = self.t
        while at < self.n:
            if t.text[at] == "{" and t.text[at - 1] not in ("interface", "struct"):
                return at
            if t.line[at] > t.line[at - 1] and t.text[at - 1] not in (",", "("):
                return -1
            at = self.over(at)
        return -1

    def define(self, i: int) -> Definition | None:
        t, word = self.t, self.t.text[i]
        if word == "func" and t.around[i] < 0:
            name, parent = i + 1, ""
            if t.at(name) == "(" and t.pair[name] > 0:
                inside = t.text[name + 1 : t.pair[name]]
                inside = inside[: inside.index("[")] if "[" in inside else inside
                parent = next((x for x in reversed(inside) if x not in ("*", "(", ")", ",")), "")
                name = t.pair[name] + 1
            if not t.is_name(name):
                return None
            self.names.add(name)
            body = self.signature_end(name + 1)
            last = t.pair[body] if body >= 0 else self.line_end(name)
            return Definition(t.text[name], "method" if parent else "function", i, i, last, (body + 1, last) if body >= 0 else (0, 0), parent=parent)
        spec = i + 1 if word == "type" and self.starts(i) and t.is_name(i + 1) else -1
        group = t.around[i]
        if group > 0 and t.text[group] == "(" and t.text[group - 1] == "type" and t.is_name(i) and (t.line[i] > t.line[i - 1] or t.text[i - 1] in ("(", ";")) and self.starts(group - 1):
            spec = i
        if spec < 0:
            return None
        at = t.pair[spec + 1] + 1 if t.at(spec + 1) == "[" and t.pair[spec + 1] > 0 else spec + 1
        at += t.at(at) == "="
        kind = t.at(at) if t.at(at) in ("struct", "interface") else "type"
        last = t.pair[at + 1] if kind != "type" and t.at(at + 1) == "{" else self.line_end(spec)
        return Definition(t.text[spec], kind, i, i, last)

    def line_end(self, i: int) -> int:
        at = i + 1
        while at < self.n and self.t.line[at] == self.t.line[at - 1] and self.t.text[at] not in (";", ")"):
            at = self.over(at)
        return at - 1

    def imports(self) -> list[str]:
        t, out = self.t, []
        for i in range(self.n):
            if t.text[i] == "import" and t.around[i] < 0:
                to = t.pair[i + 1] if t.at(i + 1) == "(" else self.line_end(i) + 1
                out += [t.text[k].strip('"`') for k in range(i + 1, min(to, self.n)) if t.kind[k] == TEXT]
        return out

    def marks(self, i: int) -> bool:
        return self.t.text[i] in ("import", "var", "const", "type") and self.starts(i) and self.t.kind[i] == NAME

    def noted(self, d: Definition) -> bool:
        return self.t.text[d.first] in ("func", "type")

    def counts(self, d: Definition) -> bool:
        return d.kind in ("function", "method")


class Rust(Reader):
    lang, qualifies = "rust", ("impl",)

    def define(self, i: int) -> Definition | None:
        t, word = self.t, self.t.text[i]
        if word == "!" and t.is_name(i - 1) and t.start[i] == t.end(i - 1) and t.text[i - 1] not in WORDS["rust"]:
            at = i + 1 + (t.text[i - 1] == "macro_rules")
            if t.at(at) in ("(", "[", "{") and t.pair[at] > 0:
                self.passed[at + 1 : t.pair[at]] = b"\1" * (t.pair[at] - at - 1)
            return None
        if t.kind[i] != NAME or not t.is_name(i + 1) and word != "impl":
            return None
        if word == "fn":
            self.names.add(i + 1)
            return self.block(t.text[i + 1].removeprefix("r#"), "function", i, i + 2)
        if word in ("struct", "enum", "trait"):
            d = self.block(t.text[i + 1], word, i, i + 2)
            if d is None:
                end = next((k for k in range(i, self.n) if t.text[k] == ";"), self.n - 1)
                d = Definition(t.text[i + 1], word, i, self.from_modifiers(i), end)
            return d
        if word == "type" and self.starts(self.from_modifiers(i)):
            return Definition(t.text[i + 1], "type", i, self.from_modifiers(i), self.expression_end(i))
        if word == "impl" and t.at(i - 1) not in ("->", ":", "&", "(", ",", "<", "=", "+", "dyn", "|"):
            at = self.angles(i + 1)
            d = self.block("", "impl", i, at, hidden=True)
            if d:
                # Here 'for' opens no loop.
                self.names.update(k for k in range(at, d.inner) if t.text[k] == "for")
                head = self.level(at, d.inner)
                head = head[: head.index("where")] if "where" in head else head
                head = head[len(head) - head[::-1].index("for") :] if "for" in head else head
                named = [x for x in head if re.match(r"[^\W\d]", x) and x not in ("dyn", "mut")]
                d.name = named[-1] if named else ""
            return d
        return None

    def level(self, at: int, to: int) -> list[str]:
        """The words from `at` on that no bracket of any kind holds."""
        out = []
        while at < to:
            skipped = self.angles(at)
            if skipped > at:
                at = skipped
                continue
            out.append(self.t.text[at])
            at = self.over(at)
        return out

    def callee(self, i: int) -> list[str]:
        return [] if self.t.at(i - 1) == "::" else [x for x in super().callee(i) if not x.startswith("self.")]

    def controls(self, i: int) -> bool:
        return super().controls(i) and i not in self.names and not (self.t.text[i] == "for" and self.t.at(i + 1) == "<")

    def imports(self) -> list[str]:
        t, out = self.t, []
        for i in range(self.n):
            if t.text[i] == "use" and self.starts(self.from_modifiers(i)) and t.kind[i] == NAME:
                path, at = "", i + 1
                while at < self.n and t.text[at] not in (";", "{", "as", "*"):
                    path, at = path + t.text[at], at + 1
                path = re.sub(r"\b(?:self|super|crate)::", "", path).removesuffix("::").removeprefix("::")
                out += [path] if path else []
        return out

    def marks(self, i: int) -> bool:
        t, word = self.t, self.t.text[i]
        return word in ("use", "const", "type") and self.starts(self.from_modifiers(i)) or word == "#" and t.at(i + 1) == "["

    def counts(self, d: Definition) -> bool:
        return d.kind != "type"

    def doc_start(self, d: Definition) -> int:
        """Attributes may stand between the comment and the definition."""
        i = d.first
        while self.t.at(i - 1) == "]" and self.t.at(self.t.pair[i - 1] - 1) == "#":
            i = self.t.pair[i - 1] - 1
        return i


class Java(Reader):
    lang = "java"

    def define(self, i: int) -> Definition | None:
        t, word = self.t, self.t.text[i]
        if t.kind[i] != NAME or t.at(i - 1) == ".":
            return None
        if word in ("class", "interface", "enum", "record") and t.is_name(i + 1) and (word != "record" or t.at(self.angles(i + 2)) == "("):
            d = self.block(t.text[i + 1], word, i, i + 2)
            if d:
                self.names.add(i + 1)
                d.first -= t.at(d.first - 1) == "@"
                self.types[d.inner] = d
            return d
        owner = t.around[i]
        if not self.holds_members(owner) or t.at(i + 1) != "(" or t.pair[i + 1] < 0 or not (t.is_name(i - 1) and t.text[i - 1] not in BEFORE["java"] | {"new", "return", "throw"} or t.at(i - 1) in (">", "]")):
            return None
        first = self.member_start(i)
        if t.at(first - 1) == "@" or "=" in t.text[first:i] and not any(t.text[k] == "@" for k in range(first, i)) or self.in_constants(i, owner):
            return None
        at = t.pair[i + 1] + 1
        while at < self.n and t.text[at] not in ("{", ";"):
            at = self.over(at)
        if at >= self.n:
            return None
        last = t.pair[at] if t.text[at] == "{" else at
        return Definition(word, "function", i, first, last, (at + 1, last) if t.text[at] == "{" else (0, 0))

    def holds_members(self, owner: int) -> bool:
        """Whether a bracket is a type's, an anonymous class's or an enumeration constant's."""
        t = self.t
        if owner in self.types:
            return True
        if t.at(owner) != "{":
            return False
        before = t.pair[owner - 1] if t.at(owner - 1) == ")" else owner
        before -= 1
        if t.at(before) == ">":
            while before > 0 and t.text[before] not in ("<", ";", "{", "}"):
                before -= 1
            before -= 1
        if not t.is_name(before):
            return False
        return t.at(self.back_chain(before) - 1) == "new" or t.around[owner] in self.types and self.in_constants(owner, t.around[owner])

    def in_constants(self, i: int, owner: int) -> bool:
        """Whether i lies among an enumeration's constants."""
        if owner not in self.types or self.types[owner].kind != "enum":
            return False
        at = owner + 1
        while at < i and self.t.text[at] != ";":
            at = self.over(at)
        return at >= i

    def member_start(self, i: int) -> int:
        """The first token of the member that i lies in."""
        t, end = self.t, i
        while i > 0:
            p = i - 1
            if t.text[p] in (")", "]") and t.pair[p] >= 0 or t.text[p] == "}" and i == end and t.text[end] == ";" and t.pair[p] >= 0:
                i = t.pair[p]
            elif t.text[p] in (";", "{", "}"):
                break
            else:
                i = p
        return i

    def callee(self, i: int) -> list[str]:
        if self.t.at(self.back_chain(i) - 1) == "new":
            return []
        both = super().callee(i)
        return [self.t.text[i], *(x for x in both if "." in x and not x.startswith(("this.", "super.")))]

    def imports(self) -> list[str]:
        t, out = self.t, []
        for i in range(self.n):
            if t.text[i] == "import" and t.around[i] < 0:
                at = i + 1 + (t.at(i + 1) == "static")
                end = next((k for k in range(at, self.n) if t.text[k] in (";", "*")), self.n)
                out.append("".join(t.text[at:end]).rstrip("."))
        return out

    def marks(self, i: int) -> bool:
        t, word = self.t, self.t.text[i]
        if word == "import":
            return t.around[i] < 0
        if word == "@":
            return t.is_name(i + 1) and t.at(self.dotted_end(i + 1)) == "(" and t.at(i + 1) != "interface"
        if t.around[i] in self.types and (i - 1 == t.around[i] or t.text[i - 1] in (";", "}")) and t.kind[i] == NAME:
            at = i
            while at < self.n and t.text[at] not in (";", "=", "(", "{", "}"):
                skipped = self.angles(at)
                at = skipped if skipped > at else self.over(at) if t.text[at] == "[" else at + 1
            return t.at(at) in (";", "=") and at - i > 1 and not self.in_constants(i, t.around[i])
        return False

    def dotted_end(self, i: int) -> int:
        while self.t.at(i + 1) == "." and self.t.is_name(i + 2):
            i += 2
        return i + 1

    def noted(self, d: Definition) -> bool:
        return d.kind != "record"

    def counts(self, d: Definition) -> bool:
        return d.kind in ("function", "method", "class", "interface")


class Kotlin(Reader):
    lang, qualifies = "kotlin", ("class", "interface")

    def define(self, i: int) -> Definition | None:
        t, word = self.t, self.t.text[i]
        if t.kind[i] != NAME or t.at(i - 1) in (".", "::", "?."):
            return None
        if word == "fun" and t.at(i + 1) not in ("(", "interface"):
            at = self.angles(i + 1)
            name = -1
            while t.is_name(at) or t.at(at) in (".", "?", "?."):
                name = at if t.is_name(at) else name
                at = self.angles(at + 1)
            if name < 0 or t.at(at) != "(" or t.pair[at] < 0:
                return None
            self.names.add(name)
            return self.bodied(t.text[name].strip("`"), i, t.pair[at] + 1)
        if word in ("class", "interface", "object") and t.is_name(i + 1) and (word != "object" or t.at(i - 1) not in (":", "=", "(", ",", "return")):
            return self.headed(t.text[i + 1], word, i, i + 2)
        return None

    def bodied(self, name: str, word: int, at: int) -> Definition | None:
        """A function whose result type or body comes at `at`; without a body it ends before the line does."""
        t, begin = self.t, at
        while at < self.n and t.text[at] not in ("{", "=", ";", "}", ")") and (t.line[at] == t.line[at - 1] or t.text[at] in (":", "where", ",") or t.text[at - 1] in GOES_ON):
            skipped = self.angles(at)
            at = skipped if skipped > at else self.over(at)
        first = self.from_modifiers(word)
        if t.at(at) == "{" and t.pair[at] > 0:
            return Definition(name, "function", word, first, t.pair[at], (at + 1, t.pair[at]))
        if t.at(at) == "=":
            last = self.expression_end(at + 1)
            return Definition(name, "function", word, first, last, (at + 1, last + 1))
        return Definition(name, "function", word, first, max(begin, at) - 1)

    def headed(self, name: str, kind: str, word: int, at: int) -> Definition:
        t = self.t
        while at < self.n and t.text[at] not in ("{", ";", "}", ")"):
            if t.line[at] > t.line[at - 1] and t.text[at] not in (":", ",", "where", "by", "(", "<") and t.text[at - 1] not in GOES_ON:
                break
            skipped = self.angles(at)
            at = skipped if skipped > at else self.over(at)
        first = self.from_modifiers(word)
        if t.at(at) == "{" and t.pair[at] > 0:
            return Definition(name, kind, word, first, t.pair[at], (0, 0), at)
        return Definition(name, kind, word, first, at - 1)

    def callee(self, i: int) -> list[str]:
        return [x for x in super().callee(i) if not x.startswith(("this.", "super."))]

    def called_at(self, i: int) -> bool:
        at = self.angles(i + 1)
        lambda_ = self.t.at(i + 1) == "{" and self.t.line[i + 1] == self.t.line[i] and self.t.at(i - 1) in ("{", "}", ";", "=", "(", ",", "return", "->", ".", "?.") and self.t.text[i] not in ("else", "try", "finally", "object", "get", "set", "do")
        return self.t.at(at) == "(" and (at > i + 1 or self.t.line[i + 1] == self.t.line[i]) or lambda_

    def imports(self) -> list[str]:
        t, out = self.t, []
        for i in range(self.n):
            if t.text[i] == "import" and t.around[i] < 0 and t.is_name(i + 1):
                at = i + 1
                while t.at(at + 1) == "." and t.is_name(at + 2):
                    at += 2
                out.append("".join(t.text[i + 1 : at + 1]))
        return out

    def marks(self, i: int) -> bool:
        t, word = self.t, self.t.text[i]
        return word == "import" and t.around[i] < 0 or word in ("val", "var") and self.starts(self.from_modifiers(i)) and (t.around[i] < 0 or t.text[t.around[i]] == "{") or word == "@" and t.is_name(i + 1)

    def counts(self, d: Definition) -> bool:
        return d.kind != "object"


READERS = {"javascript": JavaScript, "typescript": TypeScript, "go": Go, "rust": Rust, "java": Java, "kotlin": Kotlin}
