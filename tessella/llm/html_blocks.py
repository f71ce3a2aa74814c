"""Pages as sequences of leaf blocks: a tag's path and the text between block-level tags."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Elements of HTML by how they break text.
BLOCK = set("address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li listing main menu nav noscript ol optgroup option p plaintext pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = {"script", "style"}
RAW = SKIPPED | {"textarea", "title", "iframe", "noembed", "noframes", "xmp"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
WALLS = {"ul", "ol", "menu", "dl", "table", "select", "html", "body", "article", "section", "div", "aside", "main", "nav", "header", "footer", "form"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
NO_P = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}

MARKUP = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
NAMED = re.compile(r"""(?:\s|^)(class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORD = re.compile(r"[a-z]+|[A-Z]+[a-z]*|[0-9]+")


@dataclass(slots=True)
class Block:
    """path: marks of the open elements, outermost first. linked: how many characters of text lie in links."""

    path: tuple[tuple[str, ...], ...]
    text: str
    linked: int


def marks(tag: str, attributes: str) -> tuple[str, ...]:
    """A tag and the words of its class, id and role."""
    if not attributes or "=" not in attributes:
        return (tag,)
    return (tag, *dict.fromkeys(f"{n[:1].lower()}.{w.lower()}" if n.lower() == "role" else f".{w.lower()}" for n, v in NAMED.findall(attributes) for w in WORD.findall(v)))


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, white space made one space, without empty ones."""
    out: list[Block] = []
    stack: list[str] = []
    path: list[tuple[str, ...]] = []
    held: list[str] = []
    linked = [0]

    def flush() -> None:
        if held:
            if text := " ".join("".join(held).split()):
                out.append(Block(tuple(path), text, linked[0]))
            held.clear()
            linked[0] = 0

    def add(raw: str) -> None:
        if raw:
            if "&" in raw:
                raw = html.unescape(raw)
            held.append(raw)
            if "a" in stack:
                linked[0] += len(raw.strip())

    def cut(at: int) -> None:
        del stack[at:], path[at:]

    def close(tags: set[str], walls: set[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] in tags:
                cut(i)
                return close(tags, walls)
            if stack[i] in walls:
                return None
        return None

    at, n = 0, len(page)
    while at < n:
        m = MARKUP.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            if tag in HEADINGS and tag not in stack:
                tag = next((t for t in stack[::-1] if t in HEADINGS), tag)
            if tag in stack:
                i = len(stack) - 1 - stack[::-1].index(tag)
                if tag in BLOCK or not BLOCK.intersection(stack[i:]):
                    cut(i)
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if "p" in stack and tag not in ("option", "optgroup", "button", "iframe", "select", "textarea", "noscript", "col"):
                close({"p"}, WALLS)
            if tag in NO_P and tag != "p":
                close(NO_P, WALLS)
            if tag in CLOSES:
                close(CLOSES[tag], WALLS)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            body, at = page[at : end.start() if end else n], end.start() if end else n
            if tag not in SKIPPED and body:
                stack.append(tag), path.append(marks(tag, m[3]))
                add(body)
                if tag in BLOCK:
                    flush()
                cut(len(stack) - 1)
            if end:
                at = page.find(">", at) + 1 or n
            continue
        if m[3].endswith("/") and tag not in BLOCK:
            continue
        stack.append(tag)
        path.append(marks(tag, m[3]))
    flush()
    return out
