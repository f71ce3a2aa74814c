"""Generated pages with known labels, which the block labeller is trained on.

Layouts, container names, places of boilerplate and languages vary by chance; words are made of
syllables, so that no vocabulary of any table is learnt. There are four families: pages whose tags and
names tell what a part is; the same with names that say nothing, or none; pages of nothing but div
elements; and layouts made of tables. In the last three, boilerplate is such that a reader could tell it
by its words, links, fields or place.
"""

from __future__ import annotations

import html
import random
import re

from tessella.llm.html_blocks import blocks

#: Names that sites give to parts of pages.
MAIN = "article body content entry main post story text page blog news single prose".split()
WRAP = "wrapper container inner outer row col layout site root app grid box".split()
JUNK = {
    "nav": "nav navigation menu navbar topnav breadcrumb breadcrumbs links toc pagination pager sitemap".split(),
    "header": "header masthead banner topbar branding logo head site".split(),
    "footer": "footer bottom copyright colophon legal credits foot".split(),
    "side": "sidebar side aside widget rail related recommended popular trending archive tags more secondary".split(),
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner commercial".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal warning message overlay privacy newsletter subscribe paywall".split(),
    "form": "form search login signup register contact subscribe newsletter".split(),
    "comment": "comment comments reply replies respond discussion disqus thread feedback reader responses".split(),
    "share": "share social sharing follow buttons tools actions".split(),
}
PHRASES = {
    "nav": "Home|About|Contact|News|Next|Previous|Sports|Archive".split("|"),
    "footer": "All rights reserved|Copyright 2020|Terms of use|Privacy policy|©|Impressum|Last updated|Last modified|Webmaster|Powered by|Best viewed with".split("|"),
    "notice": "We use cookies|Accept all|By using this site you agree|Subscribe to our newsletter|Please log in".split("|"),
    "side": "Related articles|Most read|Popular posts|Recent posts|See also".split("|"),
    "ad": "Advertisement|Sponsored|Buy now|Sale ends today|Click here".split("|"),
    "form": "Search|Your name|E-mail|Send|Password|Log in".split("|"),
    "comment": "Leave a reply|Comments|says|Reply|Posted by|likes|wrote".split("|"),
    "header": "Welcome|The daily|Log in|Edition".split("|"),
    "share": "Share|Tweet|Print|Follow us".split("|"),
}


def r_few(r: random.Random) -> int:
    return r.randint(1, 3)


FAMILIES = ("named", "unnamed", "flat", "table")
TAGS = re.compile(r"<(/?)(article|main|section|nav|header|footer|aside|p|h[1-6]|ul|ol|li|blockquote|figure|figcaption|pre|div)\b([^>]*)>")
ATTRIBUTE = re.compile(r"""\s(?:class|id|role)=(?:"[^"]*"|'[^']*')""")


class PageMaker:
    """plain: boilerplate must be recognisable without names; every element is closed."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.plain = self.noisy = False

    def word(self) -> str:
        r = self.r
        w = "".join(r.choice(("b", "d", "f", "l", "m", "n", "r", "s", "t", "th", "st", "ch", "")) + r.choice("aeiouéäö" if r.random() < 0.15 else "aeiou") + r.choice(("", "n", "r", "s", "t")) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))
        return w + r.choice(("", "", "", "", "***", "###", "$$$")) if self.noisy else w

    def sentence(self, least: int = 3, most: int = 18) -> str:
        s = " ".join(self.word() for _ in range(self.r.randint(least, most)))
        return s[:1].upper() + s[1:] + self.r.choice("....!?")

    def title(self, least: int = 1, most: int = 10) -> str:
        """A heading, mostly without a mark at its end."""
        s = self.sentence(least, most)
        return s if self.r.random() < 0.25 else s.rstrip(".!?") or s

    def odd(self) -> str:
        """Text that isn't prose: few words again and again, numbers, addresses, symbols, capitals, one word."""
        r, w = self.r, [self.word() for _ in range(r_few(self.r))]
        kind = r.randrange(7)
        if kind == 0:
            return " ".join(r.choice(w) for _ in range(r.randint(5, 120)))
        if kind == 1:
            return " ".join([w[0]] * r.randint(2, 150)) + r.choice(("", ".", "!"))
        if kind == 2:
            return " ".join(str(r.randint(0, 10 ** r.randint(1, 9))) for _ in range(r.randint(1, 30)))
        if kind == 3:
            return f"{self.sentence()} {w[0]}@{w[-1]}.com +{r.randint(1, 99)} {r.randint(100, 9999999)} http://{w[0]}.org/{r.randint(1, 99)}"
        if kind == 4:
            return " | ".join(self.word() for _ in range(r.randint(2, 40)))
        if kind == 5:
            return self.prose().upper()
        return "".join(r.choice("#$%&*-=_~.,;:!?()[]{}<>/ ab1") for _ in range(r.randint(2, 200))).strip() or "-"

    def prose(self, most: int = 5) -> str:
        if self.r.random() < 0.08:
            return self.odd()
        if self.r.random() < 0.03:
            most *= 8
        return " ".join(self.sentence() for _ in range(self.r.randint(1, most)))

    def name(self, names: list[str]) -> str:
        """An attribute for a part of a page; at times composed, at times with a second class."""
        r, own = self.r, self.r.choice(names)
        if r.random() < 0.4:
            own = r.choice((f"{own}-{r.choice(WRAP)}", f"{r.choice(('site', 'page', 'main', 'top', 'my', 'js', 'c'))}-{own}", f"{own}_{r.randint(1, 99)}", f"{own}{r.choice(WRAP).title()}"))
        if r.random() < 0.2:
            own = f"{own} {r.choice(WRAP)}" if r.random() < 0.5 else f"{r.choice(WRAP)} {own}"
        return f'{r.choice(("class", "class", "id"))}="{own}"'

    def inline(self, text: str) -> str:
        words = [html.escape(w, quote=False) for w in text.split(" ")]
        if len(words) > 2 and self.r.random() < 0.3:
            i = self.r.randrange(len(words) - 1)
            tag = self.r.choice(("b", "i", "em", "strong", "a href='/x'", "span", "code"))
            words[i] = f"<{tag}>{words[i]}" + (f"</{tag.split()[0]}>" if self.r.random() < 0.9 else "")
        return " ".join(words)

    def tag(self, name: str, body: str, attributes: str = "") -> str:
        end = "" if name in ("p", "li") and not self.plain and self.r.random() < 0.1 else f"</{name}>"
        return f"<{name}{' ' + attributes if attributes else ''}>{body}{end}"

    def plain_junk(self, kind: str) -> str:
        """A piece of boilerplate that its words, links or fields give away."""
        r, says = self.r, PHRASES[kind]
        named = self.name(JUNK[kind])
        own = lambda: html.escape(r.choice(says))
        link = lambda: f'<a href="/{self.word()}">{own() if r.random() < 0.3 else html.escape(" ".join(self.word() for _ in range(r.randint(1, 5))).title())}</a>'
        some = lambda least, most: [link() for _ in range(r.randint(least, most))]
        listed = lambda least, most: r.choice(("<ul>" + "".join(f"<li>{x}</li>" for x in some(least, most)) + "</ul>", "".join(f"<div>{x}</div>" for x in some(least, most)), r.choice((" ", " | ", " &middot; ")).join(some(least, most))))
        if kind in ("nav", "share"):
            inner = listed(2, 9)
        elif kind == "header":
            inner = r.choice((f"<div>{link()}</div>", f"<div>{' '.join(self.word() for _ in range(r.randint(1, 3))).title()}</div>" + listed(2, 6), listed(2, 6), f"<p>{own()} {link()}</p>"))
        elif kind == "footer":
            inner = r.choice((f"<p>{own()} {html.escape(self.sentence(1, 6))}</p>", f"&copy; {r.randint(1995, 2025)} {self.word().title()} &middot; {own()}", f"{r.choice(('Copyright', '(c)', 'Copyright &copy;'))} {r.randint(1995, 2025)} {' '.join(self.word() for _ in range(r.randint(1, 3))).title()}. {own()}.", f"<div>{own()} {r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1996, 2024)}, {own()}</div>", listed(2, 6), f"<p>{own()}</p>" + listed(1, 4)))
        elif kind == "side":
            inner = f"<h3>{own()}</h3>" * (r.random() < 0.7) + listed(3, 8)
        elif kind == "comment":
            one = lambda: f"<div><b>{self.word().title()}</b> {r.choice(('says', 'wrote', 'Posted by', 'Reply'))}</div><div>{html.escape(self.prose(2))}</div>" + f"<div>{link()}</div>" * (r.random() < 0.4)
            inner = f"<h3>{r.choice(('', str(r.randint(1, 99)) + ' '))}{r.choice(('Comments', 'Leave a reply'))}</h3>" + "".join(one() for _ in range(r.randint(1, 4)))
        elif kind == "form":
            inner = f"<form action='/s'><label>{own()}</label><input name='q'><button>{own()}</button></form>"
        else:
            inner = f"<p>{own()} {html.escape(self.sentence(1, 8))}</p>" + f"<div>{link()}</div>" * (r.random() < 0.5)
        tag = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside"}.get(kind, "section")
        return r.choice((f"<{tag} {named}>{inner}</{tag}>", f"<div {named}>{inner}</div>"))

    def junk(self, kind: str) -> str:
        """A piece of boilerplate."""
        if self.plain:
            return self.plain_junk(kind)
        r, says = self.r, PHRASES[kind]
        short = lambda: r.choice(says) if r.random() < 0.4 else " ".join(self.word() for _ in range(r.randint(1, 4))).title()
        link = lambda: f'<a href="/{self.word()}">{html.escape(short())}</a>'
        named = self.name(JUNK[kind])
        if kind == "nav":
            items = "".join(self.tag("li", link()) for _ in range(r.randint(2, 9)))
            inner = r.choice((f"<ul>{items}</ul>", " ".join(link() for _ in range(r.randint(2, 8))), f"<ul class='menu'>{items}</ul>"))
            return r.choice((f"<nav>{inner}</nav>", f"<nav {named}>{inner}</nav>", f"<div {named}>{inner}</div>", f"<ul {named}>{items}</ul>", f'<div role="navigation">{inner}</div>'))
        if kind == "header":
            inner = r.choice((f"<h1>{short()}</h1>", f"<p>{html.escape(self.sentence())}</p>", link(), f"<h2>{link()}</h2><p>{short()}</p>", html.escape(self.sentence()), self.junk("nav")))
            return r.choice((f"<header>{inner}</header>", f"<header {named}>{inner}</header>", f"<div {named}>{inner}</div>", f'<div role="banner">{inner}</div>'))
        if kind == "footer":
            inner = r.choice((f"&copy; {self.word()}.com &middot; {html.escape(self.prose(2))}", f"<p>{r.choice(says)} {html.escape(self.sentence())}</p>", self.junk("nav"), " ".join(link() for _ in range(3)), f"<p>{html.escape(self.prose(2))}</p>"))
            return r.choice((f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f"<footer {named}>{inner}</footer>", f"<div {named}>{inner}</div>"))
        if kind == "side":
            inner = f"<h3>{short()}</h3>" * (r.random() < 0.6) + r.choice(("<ul>" + "".join(self.tag("li", link()) for _ in range(r.randint(2, 6))) + "</ul>", f"<p>{self.inline(self.prose(3))}</p>", html.escape(self.prose(2))))
            return r.choice((f"<aside>{inner}</aside>", f"<aside {named}>{inner}</aside>", f"<div {named}>{inner}</div>", f"<section {named}>{inner}</section>"))
        if kind == "comment":
            one = lambda: r.choice((f"<p>{self.inline(self.prose(3))}</p>", f"<b>{short()}</b><p>{html.escape(self.prose(3))}</p>", html.escape(self.prose(2))))
            inner = f"<h3>{short()}</h3>" * (r.random() < 0.6) + "".join(r.choice((f'<div class="comment">{one()}</div>', f"<li>{one()}</li>", one())) for _ in range(r.randint(1, 5)))
            return r.choice((f"<div {named}>{inner}</div>", f"<section {named}>{inner}</section>", f"<ol {named}>{inner}</ol>", f"<ul {named}>{inner}</ul>"))
        if kind == "form":
            inner = r.choice((f"<label>{short()}</label><input name='q'>", f"<p>{html.escape(self.sentence())}</p>", "")) + f"<button>{short()}</button>" + r.choice(("", f"<select><option>{short()}<option>{short()}</select>", "<textarea>x y</textarea>"))
            return r.choice((f"<form>{inner}</form>", f"<form {named}>{inner}</form>", f"<div {named}><form action='/s'>{inner}</form></div>"))
        body = r.choice((html.escape(self.prose(2)), f"<p>{self.inline(self.prose(2))}</p>", f"{r.choice(says)} {link()}", html.escape(r.choice(says)), f"<span>{self.sentence()}</span>"))
        return r.choice((f"<div {named}>{body}</div>", f"<div {named}>{body}</div>", f"<section {named}>{body}</section>", f"<p {named}>{html.escape(self.prose(1))}</p>", f"<aside {named}>{body}</aside>"))

    def story(self) -> list[str]:
        """The parts of an article."""
        r, out = self.r, []
        if r.random() < 0.75:
            h1 = f"<h1>{self.inline(self.title())}</h1>"
            out.append(f"<header>{h1}</header>" if r.random() < 0.08 else h1)
        for _ in range(r.choice((1, 1, 2, 3, 4, 6, 9, 14))):
            kind = r.random()
            if kind < 0.62:
                out.append(self.tag("p", self.inline(self.prose(6))))
            elif kind < 0.68:
                out.append(f"<p><b>{self.inline(self.prose(2))}<br>" + "</b></p>" * self.plain)
            elif kind < 0.76:
                out.append(self.tag("p", self.sentence(1, 6)))
            elif kind < 0.84:
                out.append(self.tag(f"h{r.randint(2, 4)}", self.inline(self.title(1, 7))))
            elif kind < 0.89:
                out.append("<ul>" + "".join(self.tag("li", self.inline(self.title(1, 12))) for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.93:
                out.append(f"<blockquote>{r.choice((f'<p>{html.escape(self.prose(2))}</p>', html.escape(self.prose(2))))}</blockquote>")
            elif kind < 0.95:
                out.append(f"<figure><img src='x'><figcaption>{self.title()}</figcaption></figure>")
            elif kind < 0.97:
                out.append("<table>" + "".join("<tr>" + "".join(self.tag("td", self.word()) for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
            elif kind < 0.985:
                out.append(f"<pre>{html.escape(self.prose(2))}</pre>")
            else:
                out.append(f"<div>{html.escape(self.prose(3))}</div>")
        return out

    def named_page(self) -> str:
        r = self.r
        main = [_marked(p) for p in self.story()]
        inside = [self.junk(r.choice(("ad", "share", "side", "notice", "form", "footer", "comment"))) for _ in range(r.choice((0, 0, 0, 1, 1, 2)))]
        for j in inside:
            main.insert(r.randint(1, len(main)), j)
        body = "".join(main)
        kind = r.random()
        named = self.name(MAIN)
        if kind < 0.45:
            body = f"<article{'' if r.random() < 0.6 else ' ' + named}>{body}</article>"
        elif kind < 0.6:
            body = f"<main{'' if r.random() < 0.5 else ' ' + named}>{body}</main>"
        elif kind < 0.85:
            body = f"<{(t := r.choice(('div', 'section')))} {named}>{body}</{t}>"
        elif kind < 0.93:
            body = f"<div>{body}</div>"
        if r.random() < 0.25:
            body = f"<main>{body}</main>" if r.random() < 0.5 else f"<div {self.name(MAIN)}>{body}</div>"
        before = [self.junk(r.choice(("nav", "nav", "header", "ad", "notice", "form", "side"))) for _ in range(r.choice((0, 1, 2, 2, 3, 4)))]
        after = [self.junk(r.choice(("footer", "footer", "comment", "side", "ad", "notice", "form", "nav", "share"))) for _ in range(r.choice((0, 1, 1, 2, 3, 4)))]
        if r.random() < 0.2:
            body = f'<div class="{r.choice(WRAP)}">{body}{"".join(after)}</div>'
            after = []
        head = f"<head><meta charset=utf-8><title>{self.sentence(1, 9)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>" if r.random() < 0.85 else ""
        gap = r.choice(("", "\n", "<!-- x -->"))
        return f"<!DOCTYPE html><html>{head}<body>{gap.join([*before, body, *after])}</body></html>"

    def dull(self) -> str:
        """A name that says nothing."""
        r = self.r
        return r.choice((f"css-{r.getrandbits(24):x}", f"{r.choice('abcdxyz')}{r.randint(1, 99)}", f"{self.word() or 'q'}-{r.randint(1, 9)}", f"{r.choice(('box', 'wrap', 'blk', 'cell', 'item', 'part', 'unit', 'txt', 'hl', 'story', 'c', 'l', 'm'))}-{r.randint(1, 60)}", f"sc-{self.word()}{self.word().title()}", r.choice(WRAP)))

    def renamed(self, page: str, tags: bool) -> str:
        """A page whose names say nothing, the same name for the same part; with tags, all become div."""
        r, names, bare = self.r, {}, self.r.random() < 0.25

        def change(m: re.Match) -> str:
            tag = "div" if tags else m[2]
            if m[1]:
                return f"</{tag}>"
            old = " ".join(ATTRIBUTE.findall(m[3]))
            key = (m[2], old)
            if key not in names:
                names[key] = "" if bare or (not old and r.random() < (0.4 if tags else 0.8)) else f' {r.choice(("class", "class", "id"))}="{self.dull()}"'
            return f"<{tag}{names[key]}{ATTRIBUTE.sub('', m[3])}>"

        return TAGS.sub(change, page)

    def table_page(self) -> str:
        """A page laid out by tables: a title row, bars of links, a menu beside the text, a last row of notes."""
        r = self.r
        link = lambda: f'<a href="{self.word()}.html">{html.escape(" ".join(self.word() for _ in range(r.randint(1, 3))).title())}</a>'
        cell = lambda inner, more="": f"<td{more}{r.choice(('', ' valign=top', ' align=left', ' bgcolor=#ffffff'))}>{inner}</td>"
        font = lambda x: r.choice((x, f"<font size={r.randint(1, 4)}>{x}</font>", f"<b>{x}</b>"))
        title = r.choice((f"<h1>\x01{self.title(1, 8)}</h1>", f"<h2>\x01{self.title(1, 8)}</h2>", f"<p><font size=5>\x01{self.title(1, 8)}</font></p>", ""))
        texts = [self.inline(self.prose(6)) for _ in range(r.choice((1, 1, 2, 3, 4, 6)))]
        main = title + r.choice(("".join(f"<p>\x01{t}</p>" for t in texts), "".join(f"<p>\x01{t}" for t in texts), "\x01" + "<br><br>".join(texts), "".join(f"<div>\x01{t}</div>" for t in texts)))
        bar = r.choice((" | ", " &nbsp; ", " - ", " ")).join(link() for _ in range(r.randint(3, 8)))
        menu = r.choice(("<br>".join(link() for _ in range(r.randint(3, 9))), "".join(f"<p>{link()}</p>" for _ in range(r.randint(3, 9))), "<ul>" + "".join(f"<li>{link()}" for _ in range(r.randint(3, 9))) + "</ul>", "<table>" + "".join(f"<tr><td>{link()}</td></tr>" for _ in range(r.randint(3, 9))) + "</table>"))
        says = lambda: r.choice(PHRASES["footer"])
        notes = r.choice((f"{says()} {r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1996, 2012)} {says()} {link()}", f"&copy; {r.randint(1996, 2012)} {self.word().title()}. {says()}", f"{says()} {link()}", bar))
        rows = [f"<tr>{cell(font(' '.join(self.word() for _ in range(r.randint(1, 4))).title()), ' colspan=2')}</tr>"] * (r.random() < 0.7)
        rows += [f"<tr>{cell(bar, ' colspan=2')}</tr>"] * (r.random() < 0.6)
        middle = [cell(main)]
        if r.random() < 0.8:
            middle.insert(r.choice((0, 0, 0, 1)), cell(menu, r.choice((" width=150", ' width="20%"', ""))))
        if r.random() < 0.2:
            middle.append(cell(r.choice((f"{r.choice(PHRASES['ad'])} {link()}", f"<b>{r.choice(PHRASES['side'])}</b><br>" + "<br>".join(link() for _ in range(4))))))
        rows.append(f"<tr>{''.join(middle)}</tr>")
        last = font(notes)
        if r.random() < 0.5:
            rows.append(f"<tr>{cell(r.choice(('', '<hr>')) + last, ' colspan=2')}</tr>")
            last = ""
        table = f"<table width=100% border=0>{''.join(rows)}</table>"
        if r.random() < 0.3:
            table = f"<table><tr><td>{table}</td></tr></table>"
        return f"<html><head><title>{self.sentence(1, 6)}</title></head><body bgcolor=#ffffff>{table}{r.choice(('', '<hr>', '<p>')) + last}</body></html>"

    def page(self, family: str | None = None) -> str:
        """A page of a family, or of any; its main blocks' texts begin with the mark \x01, which labelled() takes off."""
        r = self.r
        family = family or r.choices(FAMILIES, (13, 3, 4, 3))[0]
        self.plain, self.noisy = family != "named", r.random() < 0.15 and family == "named"
        if family == "table":
            return self.table_page()
        page = self.named_page()
        return page if family == "named" else self.renamed(page, family == "flat")


def _marked(part: str) -> str:
    """Puts the mark ahead of every text that begins a block of an article's part."""
    return re.sub(r"(<(?:p|h[1-6]|li|blockquote|figcaption|td|pre|div)\b[^>]*>)(?!<p>)", "\\1\x01", part)


def labelled(count: int, seed: int, families: tuple[str, ...] = ()) -> list:
    """Pages (of the given families, or of all) as lists of blocks, and their labels."""
    maker, out = PageMaker(seed), []
    for n in range(count):
        own = blocks(maker.page(families[n % len(families)] if families else None))
        labels = ["\x01" in b.text for b in own]
        for b in own:
            b.text = b.text.replace("\x01", "")
        out.append((own, labels))
    return out
