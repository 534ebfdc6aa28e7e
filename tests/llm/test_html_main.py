import numpy as np

from webextract.htmltree import parse
from webextract.llm import html_main as h

MODEL = h.fit_model()


def text(html):
    return h.main_texts([h.blocks_of(parse(html))], MODEL)[0]


def test_held_out_pages():
    maker, wrong, blocks = h.PageMaker(77), 0, 0
    for _ in range(200):
        page, y = h.labelled(maker.page())
        forest = h.forest([page])
        inside = h.decode(*forest[1:], MODEL.score(h.features(*forest)))
        at = [i for i, b in enumerate(page) if b.text]
        wrong, blocks = wrong + sum(inside[i] != y[i] for i in at), blocks + len(at)
    assert wrong / blocks < 0.02


def test_decoding_is_the_best_consistent_labelling():
    draw = np.random.default_rng(0)
    for _ in range(200):
        n = int(draw.integers(1, 9))
        parent = np.array([-1, *(int(draw.integers(0, i)) for i in range(1, n))])
        depth = np.zeros(n, dtype=int)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        levels = [np.flatnonzero(depth == k) for k in range(depth.max() + 1)]
        odds = draw.normal(0, 2, n)
        worth = lambda y: sum(-np.logaddexp(0, -o) if k else -np.logaddexp(0, o) for o, k in zip(odds, y))
        allowed = [y for m in range(2**n) if all(not y[i] or y[parent[i]] for i in range(1, n)) for y in [[m >> i & 1 for i in range(n)]]] if False else [y for y in ([m >> i & 1 for i in range(n)] for m in range(2**n)) if all(not y[i] or y[parent[i]] for i in range(1, n))]
        got = h.decode(parent, levels, odds)
        assert all(not got[i] or got[parent[i]] for i in range(1, n))
        assert abs(worth(got) - max(map(worth, allowed))) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home page</a></li><li><a href="/b">About us all</a></li></ul></nav><!-- x --><div class="ad">Buy these fine things now.</div>
<div class="cookie-notice"><p>We use cookies on this page, as all do.</p></div>
<article><h1>A title &amp; more</h1><p><b>First  paragraph,
over two lines of text.<br>After the break.<p>Second&nbsp;one with <a href="#">a link</a> in it, and more words.</p><ul><li>An item of the list</li></ul></article>
<aside><h3>Related</h3><p>Other stories that you may like to read.</p></aside>
<section class="comments"><h2>Comments</h2><div class="comment"><p>I liked this article, thank you very much.</p></div></section>
<form><p>Subscribe to our letter</p><input></form><footer>&copy; Someone, all rights reserved.</footer></body></html>"""


def test_an_article_among_everything_else():
    assert text(PAGE) == "A title & more\n\nFirst paragraph, over two lines of text. After the break.\n\nSecond one with a link in it, and more words.\n\nAn item of the list"


def test_table_of_pages(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x"), (2, "v", "", "x"), (3, "w", "<b><i>" * 3000 + "deep", "x"), (4, "w", "<article><p>" + "word " * 50_000, "x"), (5, "w", "<nav><a href=a>only</a> <a href=b>menus</a></nav>", "x")]
    got = h.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1].startswith("A title") and by[None] == "" and by[2] == "" and by[5] == ""
    assert by[4].count("word") == 50_000
    assert h.extract_main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
