"""Main texts: whole pages against another parser, pages without marks, the scan against all runs, odd pages and tables."""

import random
from collections import Counter
from html.parser import HTMLParser

import pytest

from vigil.llm import maintext as m
from vigil.llm.common import read

BLOCKS = {"p", "h1", "div", "article"}


class Article(HTMLParser):
    """Blocks of the article element, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in BLOCKS:
            self.blocks.append("")
        if tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in BLOCKS:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside > 0:
            self.blocks[-1] += data


def article(page):
    p = Article()
    p.feed(page or "")
    p.close()
    return "\n".join(x for b in p.blocks if (x := " ".join(b.split())))


PRIORS = m.weights({})


def test_whole_table(spark, sf):
    pages = read(spark, sf, "pages")
    wanted = sorted((r.page_id, r.url, article(r.html), len(article(r.html))) for r in pages.collect())
    got = m.op11_main_text(spark, sf)
    assert got.columns[:4] == ["page_id", "url", "text", "n_chars"] and dict(got.dtypes)["n_chars"] == "bigint"
    assert sorted(map(tuple, got.collect())) == wanted and all(t for _, _, t, _ in wanted)


def test_without_the_marks(spark, sf):
    """Weights learned from one half of the pages find the articles of the other half where the marks are taken away."""
    pages = [r.html for r in read(spark, sf, "pages").orderBy("page_id").collect()]
    got = Counter()
    for page in pages[::2]:
        got.update(m.counts(m.tokens(page)))
    weight = m.weights(got)
    for page in pages[1::2]:
        assert m.main_text(page.replace("<article>", " ").replace("</article>", " "), weight) == article(page)


def best_of_all(values):
    totals = [(sum(values[i:j]), -i, -j) for i in range(len(values)) for j in range(i + 1, len(values) + 1)]
    top = max(totals, default=(0, 0, 0))
    return (-top[1], -top[2]) if top[0] > 0 else (0, 0)


def test_scan_equals_all_runs():
    rng = random.Random(7)
    for _ in range(500):
        values = [rng.choice((-3, -1, 0, 1, 2, 4)) for _ in range(rng.randrange(0, 14))]
        first, end = m.best_run(values)
        a, b = best_of_all(values)
        assert sum(values[first:end]) == sum(values[a:b]), values


PAGE = """<!DOCTYPE html><html><head><title>Site | Story</title><style>p{}</style></head><body class="has-sidebar no-js">
<div id="cookie-consent"><p>We use cookies and this is a long notice about what we do with all of them, so please agree.</p></div>
<header class="site-header"><a href="/">Site</a><form action="/s"><label>Search</label><input name=q></form></header>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News &amp; more</a></ul></nav>
{open}<header><h1>A   story
 title</h1></header><p>First&nbsp;paragraph with <b>bold</b>face &lt;tag&gt; &copy 2024.<p>Second<br>line &#233;&#x1F600;<script>var x = "<p>no</p>";</script>
<div class="ad-slot"><p>Buy this now, buy that now, buy everything there is right now and then some more.</p></div>
<!-- <p>hidden</p> --><ul><li>one <a href="x">link</a></li><li>two</li></ul><p style="display: none">unseen</p><noscript>no script</noscript>
<blockquote>quoted 5 < 6</blockquote><p>Last.</p>{close}
<aside><h2>Related</h2><p>Another story that many people have read before, with a long teaser text.</p></aside>
<section class="comments"><h2>3 comments</h2><p>I do not agree with any of this, and here is a long text that says why I do not.</p></section>
<form><p>Leave a reply below, your address will not be shown.</p><button>Send</button></form>
<footer><p>Imprint and other things that every page has.</p></footer></body></html>"""
TEXT = "A story title\nFirst paragraph with boldface <tag> © 2024.\nSecond line é😀\none link\ntwo\nquoted 5 < 6\nLast."


@pytest.mark.parametrize("marks", [("<article>", "</article>"), ("<main>", "</main>"), ('<div role="main">', "</div>"), ('<form id="all"><article class="post">', "</article></form>"), ('<div class="content">', "</div>"), ("", "")])
def test_kinds_of_text_that_are_left_out(marks):
    page = PAGE.replace("{open}", marks[0]).replace("{close}", marks[1])
    if marks[0] in ('<div class="content">', ""):  # a header outside of any article is the site's
        page = page.replace("<header><h1>", "<h1>").replace("</h1></header>", "</h1>")
    assert m.main_text(page, PRIORS) == TEXT


def test_odd_pages():
    text = lambda page: m.main_text(page, PRIORS)
    assert [text(x) for x in (None, "", " \n ", "<", "<>", "<p", "<!--", "<!-- x", "</p>", "<nav>menu", "<script>x", "<p class='x>y")] == [""] * 3 + ["<", "<>"] + [""] * 6 + ["y"]
    assert text("just text") == "just text" and text("a < b > c &amp;amp; &bogus; &#0;") == "a < b > c &amp; &bogus; �"
    assert text('<p title="a > b">one</p><p data-class="ad">two</p><P CLASS=Sidebar>three</P>') == "one\ntwo"
    assert text("<p>kept</p><p class='x>also kept") == "kept\nalso kept"  # no quote closes: the tag ends at the first sign
    assert text("<article></article><p>outside words</p>") == "outside words"
    assert text("<b>" * 20_000 + "deep" + "</i></b>" * 20_000) == "deep"
    assert len(text("<p>word " * 100_000)) == 499_999
    assert text("<" * 100_000 + " x").endswith("x") and text('<a "' * 50_000) == ""


def test_odd_tables(spark):
    rows = [(1, "u", PAGE.replace("{open}", "<article>").replace("{close}", "</article>"), 5, "t", 1), (1, None, None, None, "t", 2), (None, "u", "<p>same</p>", 0, "t", 3), (None, "u", "<p>same</p>", 0, "t", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string, `a.b` int")
    got = m.extract_main_text(pages)
    assert got.columns == ["page_id", "url", "a.b", "text", "n_chars"]
    assert sorted((r["a.b"], r.text, r.n_chars) for r in got.collect()) == [(1, TEXT, len(TEXT)), (2, "", 0), (3, "same", 4), (3, "same", 4)]
    assert m.extract_main_text(pages.limit(0)).count() == 0
