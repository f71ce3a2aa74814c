import html
import re

import pytest

from tessella.llm import html_blocks, html_main, html_pages, queries


@pytest.fixture(scope="module")
def model():
    return html_main.trained()


def article_of(page):
    """The driver tables' pages have one article, of h1, p, b and br alone."""
    m = re.search(r"<article>(.*)</article>", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", m[1].replace("<br>", "")) if m else []
    return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"</?b>", "", p)).split()) for p in parts) if x)


def test_query_equals_rule_on_the_whole_table(spark, model):
    path = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    got = queries.op2_html_extraction(spark, path).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == article_of(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def accuracy(model, pages):
    guesses = model.label([p for p, _ in pages])
    pairs = [(a, b) for g, (_, y) in zip(guesses, pages, strict=True) for a, b in zip(g, y, strict=True)]
    return sum(a == b for a, b in pairs) / len(pairs)


def test_held_out_accuracy(model):
    assert accuracy(model, html_pages.labelled(200, 4242, ("named",))) > 0.99
    for family in html_pages.FAMILIES:
        assert accuracy(model, html_pages.labelled(200, 4243, (family,))) > 0.95


def test_stored_weights_are_those_of_the_recipe(model):
    import numpy as np

    with np.load(html_main.WEIGHTS) as stored:
        assert str(stored["recipe"]) == html_main.recipe(*[p.default for p in __import__("inspect").signature(html_main.trained.__wrapped__).parameters.values()])
        assert all(np.array_equal(stored[k].astype(np.float32), v) for k, v in model.p.items())


NEWS = "Council approves new bridge over the river|The city council voted on Tuesday to approve the construction of a new bridge, which is expected to open in three years.|Residents had asked for it for a long time, and many of them came to the meeting to speak in favour of the plan.".split("|")
#: Layouts that the generator doesn't make: what surrounds the parts of NEWS, and how each part stands.
FOREIGN = {
    "divs": ('<div class="c-1"><div><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a></div></div><div class="story-wrap-7">{}</div><div class="b9">Copyright 2020 The Gazette. All rights reserved.</div>', '<div class="hl">{}</div>', '<div class="txt">{}</div>'),
    "bare divs": ("<div><div><a href=/>Home</a></div><div><a href=/n>News</a></div><div><a href=/c>Contact</a></div></div><div>{}</div><div><div>© 2021 Site. Privacy policy</div></div>", "<div>{}</div>", "<div>{}</div>"),
    "tables": ("<table width=100%><tr><td colspan=2><a href=a.html>Home</a> | <a href=b.html>Links</a> | <a href=c.html>Guestbook</a></td></tr><tr><td width=150><a href=1.html>Trout</a><br><a href=2.html>Pike</a><br><a href=3.html>Salmon</a></td><td>{}</td></tr><tr><td colspan=2><font size=1>Last updated 3 May 1998 by the Webmaster</font></td></tr></table>", "<h1>{}</h1>", "<p>{}</p>"),
    "sections": ('<section class="t0"><ul><li><a href=/>Home</a><li><a href=/w>World</a><li><a href=/t>Tech</a></ul></section><section class="k4">{}</section><section class="z2"><h4>Related articles</h4><ul><li><a href=/1>First other story</a><li><a href=/2>Second other story</a><li><a href=/3>Third story of today</a></ul></section>', "<h2>{}</h2>", "<p>{}</p>"),
    "comments": ('<div id="root"><div class="css-9x"><a href="/">Start</a><a href="/x">About</a></div><div class="css-77">{}</div><div class="css-4"><div>3 Comments</div><div>Anna says</div><div>I like this very much, thank you.</div></div></div>', '<div class="css-5">{}</div>', '<div class="css-6">{}</div>'),
}


@pytest.mark.parametrize("layout", FOREIGN)
def test_layouts_that_the_generator_does_not_make(model, layout):
    around, head, body = FOREIGN[layout]
    page = "<html><head><title>x</title></head><body>" + around.format(head.format(NEWS[0]) + "".join(body.format(t) for t in NEWS[1:])) + "</body></html>"
    assert html_main.extract([page], model) == ["\n".join(NEWS)]


def test_a_short_article(model):
    page = '<html><body><div class="m"><a href="/">Start</a> <a href="/x">About</a></div><div class="s"><div class="a1">A short note</div><div class="a2">This is the only paragraph of the story, and it is not very long.</div></div><div class="f">Copyright 2020. All rights reserved.</div></body></html>'
    assert html_main.extract([page], model) == ["A short note\nThis is the only paragraph of the story, and it is not very long."]


def test_usual_boilerplate_goes(model):
    page = """<html><head><title>T</title><style>p{}</style><script>if (a < b) "<p>"</script></head><body>
    <header class="site-header"><div class="logo">My site</div></header><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>
    <div class="cookie-notice">We use cookies on this page.</div>
    <main><article><h1>A fine  title</h1><p>First &amp; foremost,\n this is text.</p><div class="ad">Buy this now, it is cheap.</div>
    <p>Second paragraph with <b>bold</b> words &#233; &nbsp;here.<p>Third one follows.</article></main>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href=/r>Another story</a></ul></aside>
    <form action=/s><input name=q><button>Search</button></form>
    <div id="comments"><div class="comment"><p>I do not agree with this at all.</p></div></div>
    <footer>&copy; 2020 My site. All rights reserved.</footer></body></html>"""
    assert html_main.extract([page], model) == ["A fine title\nFirst & foremost, this is text.\nSecond paragraph with bold words é here.\nThird one follows."]


def test_odd_pages(spark, model):
    rows = [(1, None), (2, ""), (3, "just text &lt;here&gt;"), (4, "<p>unclosed <b>x"), (5, "<!-- never ends <p>a</p>"), (6, "<article>" + "<p>Long text follows here.</p>" * 5000 + "</article>"), (7, "<a href='x>y"), (7, "<a href='x>y"), (8, "<" * 2000), (9, "<textarea>a</textarea><title>b")]
    df = spark.createDataFrame([(i, "u", h, 1) for i, h in rows], "page_id long, url string, html string, text int").select("page_id", html_main.main_text(__import__("pyspark").sql.functions.col("html"), model).alias("t"))
    got = df.collect()
    assert len(got) == len(rows) and all(r["t"] is not None for r in got)
    texts = {r["page_id"]: r["t"] for r in got}
    assert texts[1] == texts[2] == texts[5] == "" and texts[6].count("\n") == 4999
    assert df.limit(0).count() == 0


def test_blocks():
    got = [(b.path[-1][0] if b.path else "", b.text) for b in html_blocks.blocks("<ul><li>a<li>b <i>c</i></ul><p>x<br>y<p>z<h2>t</h2>u<td>v")]
    assert got == [("li", "a"), ("li", "b c"), ("p", "x y"), ("p", "z"), ("h2", "t"), ("", "u"), ("td", "v")]
    assert html_blocks.marks("div", ' class="main-navBar x" id=top role="menu"') == ("div", ".main", ".nav", ".bar", ".x", ".top", "r.menu")


def test_gradients_are_those_of_the_loss():
    import numpy as np

    pages = [p for p in html_pages.labelled(3, 1) if p[0]]
    m = html_main.BlockLabeller(seed=1)
    _, grads = m.step([p for p, _ in pages], [y for _, y in pages])
    rng = np.random.default_rng(0)
    for k in ("f", "b", "word", "size", "out", "path"):
        flat = np.flatnonzero(np.abs(grads[k]) > np.abs(grads[k]).max() / 10)
        i = np.unravel_index(rng.choice(flat), grads[k].shape)
        losses = []
        for e in (1e-5, -2e-5):
            m.p[k][i] += e
            losses.append(m.step([p for p, _ in pages], [y for _, y in pages])[0])
        m.p[k][i] += 1e-5
        assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(grads[k][i], rel=1e-3, abs=1e-8)


def test_digit_share_reads_the_whole_block():
    text = "word " * 100 + "7 " * 150
    block = html_blocks.Block((), text.strip(), 0)
    assert html_main.measures(block, text.split(), 0, 1)[5] == 150 / len(text.strip())
