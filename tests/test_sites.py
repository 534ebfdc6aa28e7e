import pytest
from pyspark.sql import functions as F

from webextract import Options, extract_page
from webextract.htmltree import body_of, element, fragment, parse
from webextract.operators import elements as e
from webextract.operators import extractors as x
from webextract.operators.conversation import Footnote, Message, conversation_result, render_conversations
from webextract.operators.routing import BUILTIN, route, route_column

URLS = {
    "https://twitter.com/a/status/1": "twitter", "https://x.com/a": "twitter", "https://netflix.com/": "twitter", "https://www.youtube.com/watch?v=1": "youtube", "https://youtu.be/1": "youtube", "https://old.reddit.com/r/a": "reddit",
    "https://news.ycombinator.com/item?id=1": "hackernews", "https://news.ycombinator.com/news": None, "https://chatgpt.com/c/1": "chatgpt", "https://chatgpt.com/": None, "https://claude.ai/share/1": "claude", "https://grok.com/chat/1": "grok",
    "https://x.ai/b": "grok", "https://gemini.google.com/app/1": "gemini", "https://github.com/a/b": "github", "https://example.org/github.com": None, "": None, "://bad": None, "relative": None,
}


def test_routes(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    assert {r.url: r.x for r in df.select("url", route_column(F.col("url")).alias("x")).collect()} == URLS == {u: route(u) for u in URLS}
    mine = BUILTIN + (("mine", ("example.org",)),)
    assert route("https://example.org/github.com", mine) == "mine"


def test_own_extractor():
    own = lambda tree, url, items: {"content_html": f"<p>{url}</p>", "extracted": {}, "variables": {"title": "Own", "site": ""}}
    r = extract_page("<title>T</title><p>x</p>", "https://blog.test/1", Options(extractors=(("blog", ("blog.test",), own),)))
    assert (r["extractor_type"], r["title"], r["site"], r["content"]) == ("blog", "Own", "", "<p>https://blog.test/1</p>")
    none = extract_page("<title>T</title><p>x</p>", "https://blog.test/1", Options(extractors=(("blog", ("blog.test",), lambda *a: None),)))
    assert none["extractor_type"] is None and none["content"] == "<p>x</p>"


def test_registered_extractors(spark):
    import webextract as w

    w.register_extractor("wiki", ("wiki.test", r"re:/w/\d+$"), lambda tree, url, items: {"content_html": "<p>from wiki</p>", "extracted": {}, "variables": {"title": "W"}})
    try:
        assert w.registered_extractors()[-1][0] == "wiki"
        pages = spark.createDataFrame([(1, "https://a.wiki.test/x", "<p>x</p>"), (2, "https://b.test/w/12", "<p>x</p>"), (3, "https://b.test/", "<p>x</p>")], "page_id bigint, url string, html string")
        assert {r.page_id: r.extractor_type for r in w.extract(pages).collect()} == {1: "wiki", 2: "wiki", 3: None}
    finally:
        w.clear_extractors()
    assert len(w.registered_extractors()) == len(BUILTIN)
    text = w.summary(extract_page("<article><p>Some words</p><div style='display:none'>no</div></article>", "", Options(debug=True)))
    assert "Main content: article" in text and "Removed (hidden): no" in text and w.summary({}) == ""


def site(name, html, url, items=()):
    return x.extract_site(name, html, url, list(items))


def test_github():
    html = """<head><meta name="expected-hostname" content="github.com"><title>Bug · Issue #123 · owner/repo</title></head><div data-testid="issue-title">Bug</div>
    <div data-testid="issue-viewer-issue-container"><a data-testid="issue-body-header-author" href="/ann">ann</a><relative-time datetime="2026-04-21T10:00:00Z"></relative-time><div data-testid="issue-body-viewer"><div class="markdown-body"><p>Issue body</p><button>Copy</button></div></div></div>
    <div data-wrapper-timeline-id="c1"><div class="react-issue-comment"><a class="ActivityHeader-module__AuthorLink--iofTU" href="https://github.com/bob">bob</a><div class="markdown-body"><p>A comment</p></div></div></div><div data-wrapper-timeline-id="c1"><div class="react-issue-comment"><div class="markdown-body">again</div></div></div>"""
    r = site("github", html, "https://github.com/owner/repo/issues/123")
    assert r["extracted"] == {"type": "issue", "issueNumber": "123", "repository": "repo", "owner": "owner"}
    assert r["variables"]["site"] == "GitHub - owner/repo" and "April 21, 2026" in r["content_html"]
    assert "Issue body" in r["content_html"] and "A comment" in r["content_html"] and "again" not in r["content_html"] and "Copy" not in r["content_html"]
    full = extract_page(html, "https://github.com/owner/repo/issues/123", Options(markdown=True))
    assert full["extractor_type"] == "github" and "Issue body" in full["content_markdown"]
    assert site("github", "<p>x</p>", "https://github.com/a/b") is None


def test_reddit_and_hackernews():
    html = '<h1>Post title</h1><shreddit-post author="poster"><div slot="text-body"><p>Body text</p></div></shreddit-post><shreddit-comment depth="0" author="a" score="3" permalink="/r/x"><faceplate-timeago ts="1776729600000"></faceplate-timeago><div slot="comment">First</div></shreddit-comment><shreddit-comment depth="1" author="b" score="1"><div slot="comment">Reply</div></shreddit-comment>'
    r = site("reddit", html, "https://reddit.com/r/golang/comments/abc/t")
    assert r["extracted"] == {"postId": "abc", "subreddit": "golang", "postAuthor": "poster"} and r["variables"]["site"] == "r/golang"
    assert r["content_html"].count("<blockquote>") == r["content_html"].count("</blockquote>") == 2 and "2026-04-21" in r["content_html"]
    item = '<table class="fatitem"><tr class="athing"><td class="titleline"><a href="https://e.org">A title</a></td></tr><tr><td><a class="hnuser">ann</a><span class="age" title="2026-04-21T01:02:03"></span></td></tr></table><table><tr class="athing comtr" id="1"><td class="ind"><img width="0"></td><td><a class="hnuser">u</a><div class="commtext">One</div></td></tr><tr class="comtr" id="2"><td class="ind"><img width="40"></td><td><div class="commtext">Two</div></td></tr><tr class="comtr" id="2"><td><div class="commtext">Twice</div></td></tr></table>'
    r = site("hackernews", item, "https://news.ycombinator.com/item?id=77")
    assert r["extracted"] == {"postId": "77", "postAuthor": "ann"} and r["variables"]["title"] == "A title" and r["variables"]["published"] == "2026-04-21"
    assert "[deleted]" in r["content_html"] and "Twice" not in r["content_html"] and r["content_html"].count("<blockquote>") == 2
    comment = '<table class="fatitem"><tr><td class="comment"><span class="navs"><a href="item?id=1#parent">parent</a></span><a class="hnuser">bob</a><div class="commtext">' + "word " * 20 + "</div></td></tr></table>"
    assert site("hackernews", comment, "https://news.ycombinator.com/item?id=78")["variables"]["title"].startswith("Comment by bob: word word")


def test_twitter_and_youtube():
    tweet = lambda n: f'<article data-testid="tweet"><div data-testid="User-Name"><a href="/alice">Alice</a><a href="/alice">@alice</a></div><a href="/alice/status/{n}"><time datetime="2026-04-21T00:00:00Z"></time></a><div data-testid="tweetText"><span>Hello </span><a href="/bob">@bob</a></div><img src="https://pbs.twimg.com/media/x?format=jpg&amp;name=small" alt="a  b"></article>'
    r = site("twitter", f'<div aria-label="Timeline: Conversation">{tweet(123)}{tweet(124)}</div>', "https://x.com/alice/status/123")
    assert r["extracted"] == {"tweetId": "123", "tweetAuthor": "@alice"} and r["variables"]["title"] == "Thread by @alice"
    assert "name=large" in r["content_html"] and "Hello @bob" in r["content_html"] and 'alt="a b"' in r["content_html"] and "thread-tweets" in r["content_html"]
    video = {"@type": "VideoObject", "name": "Video", "author": "Channel", "description": "one\ntwo", "thumbnailUrl": ["t.jpg"], "uploadDate": "2026-01-01"}
    r = site("youtube", "<title>x - YouTube</title>", "https://www.youtube.com/watch?v=abc", [video])
    assert r["variables"]["title"] == "Video" and r["variables"]["image"] == "t.jpg" and "embed/abc" in r["content_html"] and "one<br>two" in r["content_html"]
    r = site("youtube", "<title>Clip - YouTube</title><div id=description>d</div>", "https://youtu.be/xyz")
    assert r["variables"]["title"] == "Clip" and r["variables"]["image"].endswith("/vi/xyz/maxresdefault.jpg")
    assert "<iframe" not in site("youtube", "<title>t</title>", "https://www.youtube.com/")["content_html"]
    assert x.shortened("w " * 150) == ("w " * 100).strip() and x.shortened(" s ") == "s"


def test_chats():
    html = '<title>ChatGPT</title><article data-testid="conversation-turn-1" data-message-author-role="user"><h5 class="sr-only">You said:</h5><div class="text-message">Ask</div></article><article data-testid="conversation-turn-2"><h6 class="sr-only">ChatGPT said:</h6><p>Answer<span> <a href="https://s.org/1" target="_blank" rel="noopener">s</a></span></p><span data-state="closed"><button>copy</button></span></article>'
    r = site("chatgpt", html, "https://chatgpt.com/c/1")
    assert r["extracted"]["messageCount"] == "2" and 'id="fn:1"' in r["content_html"] and "copy" not in r["content_html"] and r["variables"]["title"] == "Ask"
    r = site("claude", '<title>My talk - Claude</title><div data-testid="user-message"><p>Q</p></div><div data-testid="assistant-message">A</div>', "u")
    assert r["variables"]["title"] == "My talk" and r["extracted"]["messageCount"] == "2" and "message-you" in r["content_html"]
    box = '<div class="relative group flex flex-col justify-center w-full items-{}"><div class="message-bubble">{}</div></div>'
    links = '<a href="https://www.e.org/a">one</a> <a href="https://www.e.org/a">two</a><div class="relative border border-border-l1 bg-surface-base">artifact</div>'
    r = site("grok", "<title>Topic - Grok</title>" + box.format("end", "Q") + box.format("start", links), "https://grok.com/chat/1")
    assert r["content_html"].count('class="footnote"') == 1 and "artifact" not in r["content_html"] and r["variables"]["title"] == "Topic"
    r = site("gemini", '<title>Gemini</title><div class="title-text">Research title</div><browse-item><a href="https://e.org"><span class="domain">e.org</span><span class="title">T</span></a></browse-item><div class="conversation-container"><user-query><div class="query-text">Q</div></user-query><model-response><div class="model-response-text"><div class="markdown"><div class="table-content">t</div></div></div></model-response></div>', "u")
    assert r["variables"]["title"] == "Research title" and "e.org: T" in r["content_html"] and "table-content" not in r["content_html"]
    for name in ("chatgpt", "claude", "grok", "gemini", "twitter", "reddit", "hackernews"):
        assert site(name, "<p>nothing</p>", "u") is None


def test_rendering(spark):
    r = conversation_result([Message("Claude", "<p>a</p>", "10:00", {"model": "claude"}), Message("You", "b")], [Footnote("https://e.org", "E")], "T", "Claude")
    html = r["content_html"]
    assert 'data-model="claude"' in html and html.count("<p>a</p>") == 1 and "<p>b</p>" in html and "\n<hr>" in html and 'id="fn:1"' in html
    assert r["variables"]["description"] == "Claude conversation with 2 messages"
    rows = [(1, 1, "assistant", "A"), (1, 0, "user", "Q" * 60), (2, 0, None, None)]
    got = {r.conv_id: r for r in render_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert got[1].html == conversation_result([Message("user", "Q" * 60), Message("assistant", "A")], [], "", "")["content_html"]
    assert got[1].title == "Q" * 50 + "..." and got[2].title == "Chat Conversation" and got[1].message_count == 2


def processed(which, html):
    root = element("div")
    for n in fragment(html):
        root.append(n)
    e.PROCESSORS[which](root)
    return root.inner_html()


@pytest.mark.parametrize(
    "which, html, want",
    [
        ("code", '<div class="highlight-go"><pre class="lang-go">a\tb\n\n\n\nc</pre></div>', '<div class="highlight-go"><pre><code data-lang="go" class="language-go">a    b\n\nc</code></pre></div>'),
        ("code", '<pre><code class="language-python">x<br>y</code></pre>', '<pre><code data-lang="python" class="language-python">x\ny</code></pre>'),
        ("code", '<pre><span class="line-number">1</span><div class="line">a</div><div class="line">b</div></pre>', "<pre><code>a\nb</code></pre>"),
        ("headings", '<h2 id="a" style="x">Title<a href="#a">#</a><button>b</button></h2><h3><a href="#b">Only</a></h3>', '<h2 id="a">Title</h2><h3>Only</h3>'),
        ("roles", '<div role="paragraph" id="intro">x</div><div role="list" id="steps"><div role="listitem"><span class="label">1)</span>a</div></div><div role="button">b</div><span role="link">l</span>', '<p id="intro">x</p><ol id="steps"><li>a</li></ol><button>b</button><a>l</a>'),
        ("roles", '<div role="list"><div role="listitem"><span class="label">•</span>a</div></div>', "<ul><li>a</li></ul>"),
        ("math", '<div class="math-display"><span class="katex"><math><mi>x</mi></math></span></div>', '<div class="math-display"><math xmlns="http://www.w3.org/1998/Math/MathML" display="block"><mi>x</mi></math></div>'),
        ("math", '<p><span data-latex="a &quot;b&quot;">z</span></p>', '<p><math xmlns="http://www.w3.org/1998/Math/MathML" display="inline" data-latex="a &amp;amp;quot;b&amp;amp;quot;">a &#34;b&#34;</math></p>'),
    ],
)
def test_processors(which, html, want):
    assert processed(which, html) == want


def test_image_processor():
    html = '<img src="pixel.gif"><img src="/icon.png" width="16"><figure><img data-src="/launch-event_galleryView.jpg" alt="image" width="900" class="lazy big"></figure><img src="a.jpg" alt="A picture of some long thing here">'
    got = processed("images", html)
    root = parse(got)
    images = root.find("img")
    assert len(images) == 2 and images[0].get("src") == "/launch-event_galleryView.jpg" and images[0].get("alt") == "Launch event gallery View"
    assert images[0].get("loading") == "eager" and "lazy" not in images[0].classes() and "large-image" in root.find("figure")[0].classes()
    assert root.find("figcaption")[0].text() == images[0].get("alt")
    assert e.alt_from_file("/x/IMG01.jpg".lower()) == "" and e.is_tracking("https://t/1x1.gif?x") and e.is_decorative(images[0]) is False


def test_footnotes():
    body = body_of(parse('<p>One<sup><a href="#n1">1</a></sup> and [2].</p><div class="footnotes"><p id="n1">First note</p><p>2. Second note</p></div>'))
    notes = e.process_footnotes(body)
    assert [(n["id"], n["linked"], n["content"]) for n in notes] == [("n1", True, "First note"), ("2", False, "2. Second note")]
    html = body.inner_html()
    assert 'id="fnref:1"' in html and 'id="fn:2"' in html and "<h2>Footnotes</h2>" in html
    assert e.looks_like_latex("$x^2$") and e.looks_like_latex("alpha_beta") and not e.looks_like_latex("plain text")


def test_processors_on_tables(spark):
    pages = spark.createDataFrame([(1, "<h1>a<a href='#x'>#</a></h1>", "x"), (2, None, "x")], "page_id bigint, html string, url string")
    for which in e.PROCESSORS:
        assert e.process_pages(pages, which).count() == 2
    assert {r.page_id: r.html for r in e.process_pages(pages, "headings").collect()} == {1: "<h1>a</h1>", 2: ""}
