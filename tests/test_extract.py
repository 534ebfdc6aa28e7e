"""Whole pages: what the public behaviour must be."""

import json

import pytest

from webextract import Options, extract, extract_page, merge_options, to_contract_json
from webextract.htmltree import element, fragment, parse
from webextract.operators import metadata as m
from webextract.operators import scoring, standardize
from webextract.operators.markdown import to_markdown


def of(html, **options):
    return extract_page(html, options.pop("url", ""), Options(**options) if options else None)


PAGE = """<html><head><title>Advanced Test Article - Test Site</title><meta name="description" content="This is a comprehensive test article"><meta name="author" content="John Doe">
<meta property="og:title" content="Advanced Test Article - Test Site"><meta property="og:site_name" content="Test Site"><meta property="og:image" content="https://example.com/image.jpg"></head><body>
<header><h1>Site</h1></header><nav><a href="/">Home</a></nav><main><article><h1>Advanced Test Article</h1><p>First paragraph of the body with several words.</p><div class="wrapper"><div><p>Second paragraph.</p></div></div>
<h3>Trailing heading</h3></article></main><aside>Side</aside><div id="comments">Comment clutter</div><footer>Foot</footer></body></html>"""


def test_metadata_and_content():
    r = of(PAGE, url="https://www.example.com/a/b")
    assert (r["title"], r["description"], r["author"], r["image"], r["site"], r["domain"], r["favicon"]) == (
        "Advanced Test Article", "This is a comprehensive test article", "John Doe", "https://example.com/image.jpg", "Test Site", "example.com", "https://www.example.com/favicon.ico",
    )
    assert r["content"] == "<p>First paragraph of the body with several words.</p><p>Second paragraph.</p>"
    assert len(r["meta_tags"]) == 5 and r["extractor_type"] is None and r["content_markdown"] is None
    assert r["word_count"] == 9


def test_word_count_and_body():
    assert of("<p>This is a test with five words.</p>")["word_count"] == 7
    assert of("<span>Short body</span>")["content"] == "<span>Short body</span>" and of("<span>Short body</span>")["word_count"] == 2
    assert standardize.count_words("<p>a</p><p>b</p>") == 1
    assert of(None)["content"] == "" and of("")["word_count"] == 0


def test_sparse_pages_are_tried_again_without_patterns():
    text = "This sentence repeats within the reader section of the page. " * 24
    r = of(f'<html><body><main><section class="reader-comments-analysis"><p>{text}</p></section></main></body></html>')
    assert r["word_count"] > 200 and "repeats" in r["content"]


def test_images():
    html = "<article><h1>Test Article</h1><p>Text that stays here.</p><img src=a.png><svg></svg><video></video><canvas></canvas><picture><img src=b.png></picture></article>"
    with_images = extract_page(html, "", Options.zero())["content"]
    assert all(t in with_images for t in ("<img", "<svg", "<video"))
    without = extract_page(html, "", Options.zero(remove_images=True))["content"]
    assert not any(t in without for t in ("<img", "<svg", "<video", "<canvas", "<picture")) and "Text that stays here." in without
    small = of('<article><p>Words of it.</p><svg viewBox="0 0 20 80" width="20" height="80"></svg><svg viewBox="0 0 120 80" width="120" height="80"><path d="z"/></svg></article>')["content"]
    assert "0 0 20 80" not in small and "0 0 120 80" in small


def test_layout_tables_and_scored_blocks():
    text = "Words of the story go on and on. " * 20
    r = of(f"<table width=600><tr><td>Home Archive</td><td class=article><p>{text}</p></td><td>x</td></tr></table>")
    assert "story" in r["content"] and "Archive" not in r["content"] and r["word_count"] > 50
    r = of(f'<div class="site-nav"><a href=a>Home</a></div><section class="layout">{text}</section>')
    assert "story" in r["content"] and "site-nav" not in r["content"]


def test_options_merge():
    on = lambda o: (o.remove_exact_selectors, o.remove_partial_selectors, o.debug, o.url)
    assert on(merge_options(None)) == (True, True, False, "")
    assert on(merge_options(Options.zero())) == (False, False, False, "")
    assert on(merge_options(Options.zero(remove_exact_selectors=True, url="u"), Options.zero(debug=True))) == (False, False, True, "u")
    assert merge_options(Options(code_options={"a": 1}), Options.zero()).code_options == {"a": 1}


def test_debug_keeps_wrappers_and_reports():
    r = of('<article><div class="wrapper" id="w" data-score="5"><p style="x">Text of it.</p></div><div style="display:none">no</div></article>', debug=True)
    assert '<div class="wrapper" id="w" data-score="5"><p>Text of it.</p></div>' in r["content"]
    assert r["debug_info"]["main_content"] == "article" and [x["reason"] for x in r["debug_info"]["removed"]] == ["hidden"]


def test_mobile_styles():
    r = of('<article style="color: red;"><p>Some text here.</p></article>', mobile_styles=(("article", "display: none;"),))
    assert r["content"] == "<p>Some text here.</p>"


def script(data):
    return f'<script type="application/ld+json">{data if isinstance(data, str) else json.dumps(data)}</script>'


def test_schema_items():
    graph = {"@graph": [{"@type": "Organization", "name": "Org"}, {"@type": "Article", "headline": "Head", "author": [{"name": "First Author"}, {"name": "Second Author"}]}]}
    items = m.schema_items(parse(script(graph)))
    assert [i["@type"] for i in items] == ["Organization", "Article"] and items[0]["type"] == "Organization" and "@type" not in items[1]["author"][0]
    r = of(f"<html><head>{script(graph)}<title>T</title></head><body><article><p>x</p></article></body></html>")
    assert (r["title"], r["author"]) == ("Head", "First Author, Second Author")
    assert m.schema_items(parse(script("{invalid json"))) == []
    kept = m.schema_items(parse(script([{"@id": "https://schema.org/x"}, {"name": "a", "url": "b"}, {"name": "a"}, "text"])))
    assert kept == [{"@id": "https://schema.org/x"}, {"name": "a", "url": "b"}]
    wrapped = "<![CDATA[ /* c */ {\"@type\": \"Thing\", \"name\": \"n\"} ]]>"
    assert m.schema_property(m.schema_items(parse(script(wrapped))), "name") == "n"


@pytest.mark.parametrize(
    "data, path, want",
    [({"a": {"b": "x"}}, "a.b", "x"), ({"n": {"a": {"b": "x"}}}, "a.b", "x"), ([{"u": "1"}, {"u": "2"}], "u", "1, 2"), ({"author": [{"name": "A"}, {"name": "B"}]}, "author.[1].name", "B"), ({"author": {"name": "A"}}, "author", "A"), ({"k": [1, 2.5, "x"]}, "k", "1, 2.5, x"), ({"k": True}, "k", ""), ({"k": 3}, "k", ""), ({"author": [{"name": "A"}]}, "author.[].name", ""), (None, "k", ""), ({"l": [{"deep": "x"}]}, "deep", "")],
)
def test_schema_paths(data, path, want):
    assert m.schema_property(data, path) == want


@pytest.mark.parametrize("title, site, want", [("Story - Site", "Site", "Story"), ("Site | Story", "Site", "Story"), ("A – S (x)+", "S (x)+", "A"), ("Other", "Site", "Other"), (" T ", "", "T"), ("Foo - Jane", "jane", "Foo")])
def test_titles(title, site, want):
    assert m.clean_title(title, site) == want


@pytest.mark.parametrize("url, want", [("https://www.example.com/articles/1", "example.com"), ("://bad-url", ""), ("http://u:p@Host.org:8080/x", "Host.org"), ("", ""), ("relative/path", "")])
def test_domains(url, want):
    assert m.domain_of(url) == want


def test_dom_sources():
    page = parse('<head><link rel="canonical" href="https://www.example.net/a/b"><link rel="shortcut icon" href="../i.png"></head><body><span class="author">Alice, Bob Writer</span><a href="/author/x">Alice</a><time datetime="2026-01-02">d</time></body>')
    got = m.metadata(page)
    assert (got["domain"], got["author"], got["published"], got["favicon"]) == ("example.net", "Alice, Bob Writer", "2026-01-02", "https://www.example.net/i.png")
    assert m.author_list(["A,", " A ", "", *"BCDEFGHIJKL"]) == "A, B, C, D, E, F, G, H, I, J"


def root_of(html):
    root = element("div")
    for n in fragment(html):
        root.append(n)
    return root


def standard(html, title="", debug=False):
    root = root_of(html)
    standardize.standardize(root, title, debug)
    return root.inner_html()


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>Alpha   beta​ gamma , done</p>", "<p>Alpha beta gamma, done</p>"),
        ("<p>Read <b>bold</b><i>emphasis</i>, punctuation</p>", "<p>Read <b>bold</b> <i>emphasis</i>, punctuation</p>"),
        ('<p id="fn:1" class="x" onclick="y">a <a href="z" rel="q">b</a></p><pre><code class="language-go">c  d</code></pre>', '<p id="fn:1">a <a href="z">b</a></p><pre><code class="language-go">c  d</code></pre>'),
        ("<p>a<br><br><br><br>b</p>", "<p>a <br/> <br/> b</p>"),
        ('<div role="paragraph" title="t">Text</div>', '<p title="t">Text</p>'),
        ('<div role="list"><div role="listitem"><span class="label">1)</span><div class="content">One</div></div><div role="listitem"><div class="content"><div role="paragraph">Two</div></div></div></div>', "<ol><li>One</li><li><p>Two</p></li></ol>"),
        ('<p>x</p><lite-youtube videoid="abc"></lite-youtube>', None),
        ("<div><div><div>Inline text</div></div></div>", "<p>Inline text</p>"),
        ("<p>text</p><p></p><div><span>,</span></div>", "<p>text</p>"),
        ("<p>a</p><h2>Dangling</h2>", "<p>a</p>"),
        ('<p>Note<a href="#fn1">1</a> and more</p>', "<p>Note <sup>1</sup> and more</p>"),
        ("<p>a b</p>", "<p>a  b</p>"),
    ],
)
def test_standardized(html, want):
    got = standard(html)
    if want is None:
        assert 'src="https://www.youtube.com/embed/abc"' in got and 'title="YouTube video player"' in got
    else:
        assert got == want


def test_title_heading_goes_and_others_come_down():
    assert standard("<h1>My  Title</h1><h1>Other</h1><p>x</p>", "my title") == "<h2>Other</h2><p>x</p>"


def test_idempotent():
    once = standard('<div class="wrapper"><div><p>Some <b>bold</b> text.</p></div></div><h2>H</h2><p>more</p>')
    assert standard(once) == once


@pytest.mark.parametrize(
    "html, want",
    [
        ("<h1>Example</h1><p>See <a href='https://d'>docs</a> &amp; <strong>this</strong> <em>now</em>.</p>", "# Example\n\nSee [docs](https://d) & **this** *now*."),
        ("<blockquote><p>Quoted text</p></blockquote><ul><li>First</li><li>Second<ol><li>x</li></ol></li></ul>", "> Quoted text\n\n- First\n- Second\n  1. x"),
        ('<pre><code class="language-go">a\n  b</code></pre><p><code>c</code></p><hr><img src="/cover.png" alt="Cover image">', "```go\na\n  b\n```\n\n`c`\n\n* * *\n\n![Cover image](/cover.png)"),
        ("<p>a_b*c<br>d</p>", "a\\_b\\*c  \nd"),
        ("", ""),
    ],
)
def test_markdown(html, want):
    assert to_markdown(html) == want


def test_separate_markdown():
    r = of("<article><h1>T</h1><p>Readable markdown body.</p></article>", separate_markdown=True)
    assert "<p>Readable markdown body.</p>" in r["content"] and "Readable markdown body." in r["content_markdown"]


def test_scores():
    page = parse('<div id="nav" class="menu"><ul><li><a href=a>Home</a><li><a href=b>About us now</a></ul></div><div id="article" class="content"><p>' + "word " * 60 + '</p></div><div id="rel"><p>related menu share</p></div>')
    nav, article, rel = (next(n for n in page.find("div") if n.get("id") == k) for k in ("nav", "article", "rel"))
    assert scoring.score(article) > scoring.score(nav)
    assert scoring.score_terms(article)["content_class"] == 15 and scoring.score_terms(article)["paragraphs"] == 10
    assert scoring.best([nav, article], 1000) is None and scoring.best([nav, article], 0) is article
    assert scoring.clutter_blocks(page) == [nav, rel]
    dated = parse("<div>On January 2, 2024 étéby Jane wrote</div>").find("div")[0]
    assert scoring.score_terms(dated)["date"] == 10 and scoring.score_terms(dated)["byline"] == 10


def test_table_of_pages(spark):
    rows = [(1, "https://a.org/x", PAGE, "extra"), (2, None, None, "extra"), (None, "", "<p>x</p>", "extra"), (1, "https://a.org/x", PAGE, "extra"), (5, "u", "<div>" * 4000 + "deep", "extra"), (6, "u", "<p>" + "long " * 100_000, "extra")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, title string").repartition(3)
    got = {r.page_id: r for r in extract(pages, Options(max_html_chars=400_000)).collect()}
    assert got[1].title == "Advanced Test Article" and got[1].error is None and got[2].content == "" and got[None].content == "<p>x</p>"
    assert got[6].error == "over 400000 characters" and got[5].page_id == 5
    out = json.loads(to_contract_json(extract(pages.where("page_id = 1"))).first().json)
    assert out["wordCount"] == 9 and "metaTags" in out
    assert extract(pages.limit(0)).count() == 0
