import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webextract import constants as C
from webextract.css import BadSelector, SelectorIndex, closest, first, matcher, parse_selector, select
from webextract.htmltree import escape, fragment, parse

CASES = [
    ("<p><b>One.<br><p>Two</p><p>Three", "<p><b>One.<br/></b></p><p><b>Two</b></p><p><b>Three</b></p>"),
    ("<a>1<p>2</a>3</p>", "<a>1</a><p><a>2</a>3</p>"),
    ("<b>1<i>2</b>3</i>", "<b>1<i>2</i></b><i>3</i>"),
    ("<table><tr><td>a<td>b</table>x", "<table><tbody><tr><td>a</td><td>b</td></tr></tbody></table>x"),
    ("<table>foo<tr><td>z", "foo<table><tbody><tr><td>z</td></tr></tbody></table>"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>"),
    ("<p>a<div>b</div>c</p>", "<p>a</p><div>b</div>c<p></p>"),
    ("<select><option>1<option>2</select>", "<select><option>1</option><option>2</option></select>"),
    ('<svg viewbox="0 0 1 2"><path d="x"/></svg>y', '<svg viewBox="0 0 1 2"><path d="x"></path></svg>y'),
    ("a < b &amp; c &lt;d&gt; 'q'", "a &lt; b &amp; c &lt;d&gt; &#39;q&#39;"),
    ("<script>if (a < b) '</p>'</script>x", "<script>if (a < b) '</p>'</script>x"),
    ("<textarea>\n<b></textarea>", "<textarea>&lt;b&gt;</textarea>"),
    ("<!-- c --><p title='a\"b' title=z>x", '<p title="a&#34;b">x</p>'),
    ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
    ("<h1>a<h2>b</h2>", "<h1>a</h1><h2>b</h2>"),
    ("<pre>\n\nx</pre>", "<pre>\nx</pre>"),
]


@pytest.mark.parametrize("html, body", CASES)
def test_tree_construction(html, body):
    assert parse("<body>" + html).find("body")[0].inner_html().replace("<!-- c -->", "") == body


def test_head_and_implied_parts():
    assert parse("").outer_html() == "<html><head></head><body></body></html>"
    document = parse("<!DOCTYPE html><title>a&amp;b</title><meta charset=x>text<footer>f")
    assert document.outer_html() == '<!DOCTYPE html><html><head><title>a&amp;b</title><meta charset="x"/></head><body>text<footer>f</footer></body></html>'


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<i>", "</i>", "<a href=x>", "</a>", "<div>", "</div>", "<table>", "<tr>", "<td>", "</table>", "<ul>", "<li>", "</ul>", "x ", "<svg>", "</svg>", "<h1>", "</h2>", "<br>", "</", "<!--", "&am", "<button>", "<select>", "<option>", "</body>", "<body a=1>"]), max_size=25))
def test_any_soup_gives_a_tree_that_comes_back(parts):
    document = parse("".join(parts))
    seen = set()
    for n in document.walk():
        assert id(n) not in seen
        seen.add(id(n))
        assert all(c.parent is n for c in n.children)
    assert len(document.find("body")) == 1
    assert document.text() == parse("".join(parts)).text()


HTML = """<main id=m class="a b"><p class="x ad-z">1</p><div data-t="Yes"><span class=ad>2</span><ul><li><a href="#fn1" class="RefX">3</a></ul></div></main><footer hidden>4</footer>"""


@pytest.mark.parametrize(
    "selector, texts",
    [("p", ["1"]), (".a .ad", ["2"]), ("main > p", ["1"]), ("main > span", []), ('[data-t="yes" i]', ["23"]), ('a[href^="#"][class*="ref" i]', ["3"]), ('[class^="x "]', ["1"]), (".x:not(.ad-z)", []), ("p:not([id]), li a", ["1", "3"]), ("#m span.ad", ["2"]), ("[hidden]", ["4"]), ("#fn:1", []), ('[class$="-z"]', ["1"]), ('[class*=""]', [])],
)
def test_selectors(selector, texts):
    assert [n.text() for n in select(parse(HTML), selector)] == texts


def test_selector_tools():
    root = parse(HTML)
    link = first(root, "a")
    assert closest(link, "main").get("id") == "m" and closest(link, "table") is None
    with pytest.raises(BadSelector):
        parse_selector("#fn:1")
    index = SelectorIndex(C.EXACT_SELECTORS)
    for n in root.elements():
        assert index.matches(n) == [i for i, s in enumerate(C.EXACT_SELECTORS) if matcher(s)(n)]
    assert "".join(n.outer_html() if n.kind == "element" else escape(n.data) for n in fragment("a<b>c</b>")) == "a<b>c</b>"


def test_fixed_values():
    assert [len(x) for x in (C.EXACT_SELECTORS, C.FOOTNOTE_REFERENCES, C.FOOTNOTE_LISTS, C.ALLOWED_ATTRIBUTES, C.ALLOWED_EMPTY_TAGS, C.ENTRY_POINTS, C.NAVIGATION_PHRASES, C.NON_CONTENT_PATTERNS, C.CONTENT_INDICATORS)] == [144, 21, 15, 56, 36, 15, 35, 23, 14]
    patterns = C.PARTIAL_PATTERNS
    assert len(patterns) == len(set(patterns)) == 200
    goes = lambda name: any(p.lower() in name for p in patterns)
    assert all(map(goes, ("reader-comments-analysis", "post-meta", "article__header", "newsletter-signup", "breadcrumb", "author-bio", "site-header", "card-content", "carousel-container", "adlayout", "around-the-web")))
    assert not any(map(goes, ("article-content", "entry-content", "post-content", "main-content", "markdown-body", "story", "story-card", "comment-date", "share", "social", "promo")))
    assert C.patterns_from(["# own\n", "a-b\n", "\n", "end \r\n"]) == ("a-b", "end ")
