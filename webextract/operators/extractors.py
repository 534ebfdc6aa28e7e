"""Extractors for particular sites. Each takes (tree, url, schema items) and gives {content_html, extracted, variables}, or None."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import UTC, datetime
from urllib.parse import parse_qs, urlsplit

from webextract.css import closest, first, select
from webextract.htmltree import Node, escape, parse
from webextract.operators.conversation import Footnote, Message, conversation_result
from webextract.operators.metadata import _host

Extractor = Callable[[Node, str, list], dict | None]


def _text(root: Node | None, selector: str = "") -> str:
    n = first(root, selector) if root is not None and selector else root
    return n.text().strip() if n is not None else ""


def _flat(text: str, most: int) -> str:
    """The first `most` characters with white space collapsed."""
    return re.sub(r"\s+", " ", text[:most].strip())


def _found(pattern: str, text: str) -> str:
    m = re.search(pattern, text)
    return m[1] if m else ""


def _any(root: Node, selectors: tuple[str, ...]) -> list[Node]:
    """The matches of the first selector that has any."""
    return next((found for s in selectors if (found := select(root, s))), [])


# Videos


def youtube(tree: Node, url: str, items: list) -> dict | None:
    video = next((i for i in items if isinstance(i, dict) and i.get("@type") == "VideoObject"), {})
    parts = urlsplit(url)
    if (_host(url) or "").endswith("youtu.be"):
        code = parts.path.lstrip("/")
    else:
        code = parse_qs(parts.query).get("v", [""])[0]
    as_text = lambda k: video[k] if isinstance(video.get(k), str) else ""
    title = as_text("name") or re.sub(r" - YouTube$", "", _text(tree, "title"))
    description = as_text("description") or _text(tree, "#description")
    thumbs = video.get("thumbnailUrl")
    image = thumbs if isinstance(thumbs, str) else thumbs[0] if isinstance(thumbs, list) and thumbs and isinstance(thumbs[0], str) else ""
    image = image or (f"https://img.youtube.com/vi/{code}/maxresdefault.jpg" if code else "")
    player = (
        f'<iframe width="560" height="315" src="https://www.youtube.com/embed/{code}" title="YouTube video player" frameborder="0" allow="accelerometer; autoplay; clipboard-write; encrypted-media; gyroscope; picture-in-picture; web-share" allowfullscreen></iframe>'
        if code
        else ""
    )
    body = description.replace("\n", "<br>")
    return {
        "content_html": player + (f"<p>{body}</p>" if description else ""),
        "extracted": {"videoId": code, "author": as_text("author")},
        "variables": {"title": title, "author": as_text("author"), "site": "YouTube", "image": image, "published": as_text("uploadDate"), "description": shortened(description)},
    }


def shortened(text: str, most: int = 200, least: int = 150) -> str:
    """The first characters, back to the last space if that is far enough in."""
    if len(text) <= most:
        return text.strip()
    cut = text[:most]
    at = cut.rfind(" ")
    return (cut[:at] if at > least else cut).strip()


# Discussions


def _nested(comments: list[tuple[int, str]]) -> str:
    """Comments of a depth each, as nested quotes."""
    out, open_ = [], 0
    for depth, html in comments:
        if depth == 0:
            out.append("</blockquote>" * open_ + "<blockquote>")
            open_ = 1
        else:
            want = depth + 1
            out.append("</blockquote>" * (open_ - want) if want < open_ else "<blockquote>" * (want - open_))
            open_ = want
        out.append(html)
    return "".join(out) + "</blockquote>" * open_


REDDIT_POSTS = ("div[data-testid='post-content']", "div[data-click-id='text']", "div[data-click-id='body']", ".usertext-body", "[data-testid='post-content']", "div[data-testid='comment']", ".comment")
REDDIT_BODIES = ("div[data-testid='post-content']", "div[data-click-id='text']", "div[data-click-id='body']", ".usertext-body", ".md")
REDDIT_IMAGES = ("img[src*='preview.redd.it']", "img[src*='i.redd.it']", "img[src*='external-preview.redd.it']")
REDDIT_COMMENTS = ("div[data-testid='comment']", ".comment", ".comment-area .comment")


def reddit(tree: Node, url: str, items: list) -> dict | None:
    post = first(tree, "shreddit-post")
    if post is None and not any(first(tree, s) for s in REDDIT_POSTS):
        return None
    body = ""
    if post is not None:
        if (text := first(post, '[slot="text-body"]')) is not None:
            body += text.inner_html()
        if (image := first(post, "#post-image")) is not None:
            body += f'<div id="post-image">{image.inner_html()}</div>'
    if not body:
        if found := _any(tree, REDDIT_BODIES):
            body = found[0].inner_html()
        body += "".join(dict.fromkeys(n.outer_html() for s in REDDIT_IMAGES for n in select(tree, s)))
    comments = []
    for c in select(tree, "shreddit-comment"):
        depth = int(c.get("depth")) if c.get("depth").isdigit() else 0
        stamp, content = first(c, "faceplate-timeago"), first(c, '[slot="comment"]')
        raw = stamp.get("ts") if stamp is not None else ""
        when = datetime.fromtimestamp(int(raw) / 1000, UTC).strftime("%Y-%m-%d") if raw.isdigit() else raw[:10]
        head = f'<span class="comment-author"><strong>{c.get("author")}</strong></span> • <a href="https://reddit.com{c.get("permalink")}" class="comment-link">{c.get("score") or 0} points</a> • <span class="comment-date">{when}</span>'
        comments.append((depth, f'<div class="comment"><div class="comment-metadata">{head}</div><div class="comment-content">{content.inner_html() if content is not None else ""}</div></div>'))
    if not comments:
        comments = [(0, f'<div class="comment"><div class="comment-content">{n.inner_html()}</div></div>') for n in _any(tree, REDDIT_COMMENTS)]
    html = f'<div class="reddit-post"><div class="post-content">{body}</div></div>'
    if comments:
        html += f'<hr><h2>Comments</h2><div class="reddit-comments">{_nested(comments)}</div>'
    plain = Node("document")
    plain.set_inner(body)
    sub = _found(r"/r/([^/]+)", url)
    title = _text(tree, "h1") or _text(tree, "title")
    return {
        "content_html": html,
        "extracted": {"postId": _found(r"comments/([a-zA-Z0-9]+)", url), "subreddit": sub, "postAuthor": post.get("author") if post is not None else ""},
        "variables": {"title": title, "author": post.get("author") if post is not None else "", "site": f"r/{sub}", "description": _flat(plain.text(), 140)},
    }


def hackernews(tree: Node, url: str, items: list) -> dict | None:
    post = first(tree, ".fatitem")
    if post is None:
        return None
    parent = first(post, '.navs a[href*="parent"]')
    author = _text(post, ".hnuser")
    stamp = first(post, ".age")
    when = stamp.get("title").split("T")[0] if stamp is not None else ""
    if parent is not None:
        comment = first(post, ".comment") or post
        author = _text(comment, ".hnuser") or author
        text = first(post, ".commtext")
        points = _text(post, ".score")
        head = f'<span class="comment-author"><strong>{author}</strong></span> • <span class="comment-date">{when}</span>' + (f' • <span class="comment-points">{points}</span>' if points else "")
        head += f' • <a href="https://news.ycombinator.com/{parent.get("href")}" class="parent-link">parent</a>'
        body = f'<div class="comment main-comment"><div class="comment-metadata">{head}</div><div class="comment-content">{text.inner_html() if text is not None else ""}</div></div>'
        preview = _text(text)
        title = f"Comment by {author}: {preview[:50] + '...' if len(preview) > 50 else preview}"
        description = f"Comment by {author} on Hacker News"
    else:
        link, text = first(post, ".titleline a"), first(post, ".toptext")
        href = link.get("href") if link is not None else ""
        body = f'<p><a href="{escape(href)}" target="_blank">{escape(href)}</a></p>' if href else ""
        body += f'<div class="post-text">{text.inner_html()}</div>' if text is not None else ""
        title = _text(post, ".titleline")
        description = f"{title} - by {author} on Hacker News"
    comments, seen = [], set()
    for c in select(tree, "tr.comtr"):
        name, text = c.get("id"), first(c, ".commtext")
        if not name or name in seen or text is None:
            continue
        seen.add(name)
        indent = first(c, ".ind img")
        width = indent.get("width") if indent is not None else ""
        points, age = _text(c, ".score"), first(c, ".age")
        date = age.get("title").split("T")[0] if age is not None else ""
        head = f'<span class="comment-author"><strong>{_text(c, ".hnuser") or "[deleted]"}</strong></span> • <a href="https://news.ycombinator.com/item?id={name}" class="comment-link">{date}</a>' + (f' • <span class="comment-points">{points}</span>' if points else "")
        comments.append((int(width) // 40 if width.isdigit() else 0, f'<div class="comment"><div class="comment-metadata">{head}</div><div class="comment-content">{text.inner_html()}</div></div>'))
    html = f'<div class="hackernews-post"><div class="post-content">{body}</div>' + (f'<hr><h2>Comments</h2><div class="hackernews-comments">{_nested(comments)}</div>' if comments else "") + "</div>"
    return {"content_html": html, "extracted": {"postId": _found(r"id=([0-9]+)", url), "postAuthor": author}, "variables": {"title": title, "author": author, "site": "Hacker News", "description": description, "published": when}}


TIMELINES = ('[aria-label="Timeline: Conversation"]', '[aria-label*="Timeline"]', '[aria-label*="timeline"]', 'main[role="main"]', 'section[role="region"]')
TWEETS = ('article[data-testid="tweet"]', '[data-testid="tweet"]', 'article[role="article"]', "div[data-tweet-id]", ".tweet")
TWEET_IMAGES = ('[data-testid="tweetPhoto"]', '[data-testid="tweet-image"]', 'img[src*="media"]')


def _tweet_user(tweet: Node) -> dict[str, str]:
    name = first(tweet, '[data-testid="User-Name"]')
    full = handle = ""
    if name is not None:
        links = name.find("a")
        full, handle = (_text(links[i]) if len(links) > i else "" for i in (0, 1))
        full = full or _text(name, 'span[style*="color: rgb(15, 20, 25)"] span')
        handle = handle or _text(name, 'span[style*="color: rgb(83, 100, 113)"]')
    time = first(tweet, "time")
    link = closest(time, "a") if time is not None else None
    return {"name": full, "handle": handle, "date": time.get("datetime")[:10] if time is not None else "", "permalink": link.get("href") if link is not None else ""}


def _quoted(tweet: Node) -> Node | None:
    box = first(tweet, '[aria-labelledby*="id__"]')
    user = first(box, '[data-testid="User-Name"]') if box is not None else None
    return closest(user, '[aria-labelledby*="id__"]') if user is not None else None


def _tweet(tweet: Node) -> str:
    user, quote = _tweet_user(tweet), _quoted(tweet)
    text = first(tweet, '[data-testid="tweetText"]')
    lines = [x.strip() for x in text.text().split("\n")] if text is not None else []
    words = "".join(f"<p>{escape(x)}</p>" for x in lines if x)
    inside = set(map(id, quote.walk())) if quote is not None else set()
    images = []
    for s in TWEET_IMAGES:
        for n in select(tweet, s):
            img = n if n.tag == "img" else first(n, "img")
            if id(n) in inside or img is None or not img.get("src"):
                continue
            src, alt = re.sub(r"&name=\w+$", "&name=large", img.get("src")), re.sub(r"\s+", " ", img.get("alt")).strip()
            images.append(f'<img src="{escape(src)}" alt="{escape(alt)}" />')
    head = f'<span class="tweet-author"><strong>{user["name"]}</strong> <span class="tweet-handle">{user["handle"]}</span></span>' + (f' <a href="{user["permalink"]}" class="tweet-date">{user["date"]}</a>' if user["date"] else "")
    out = f'<div class="tweet"><div class="tweet-header">{head}</div>' + (f'<div class="tweet-text">{words}</div>' if words else "")
    if images:
        out += f'<div class="tweet-media">{"".join(dict.fromkeys(images))}</div>'
    return out + (f'<blockquote class="quoted-tweet">{_tweet(quote)}</blockquote>' if quote is not None else "") + "</div>"


def twitter(tree: Node, url: str, items: list) -> dict | None:
    timeline = next((n for s in TIMELINES if (n := first(tree, s)) is not None), None)
    tweets = select(timeline, 'article[data-testid="tweet"]') if timeline is not None else []
    tweets = tweets or _any(tree, TWEETS)
    if not tweets:
        return None
    main, thread = tweets[0], tweets[1:]
    html = f'<div class="tweet-thread"><div class="main-tweet">{_tweet(main)}</div>'
    if thread:
        html += '<hr><div class="thread-tweets">' + "\n<hr>\n".join(map(_tweet, thread)) + "</div>"
    name = first(main, '[data-testid="User-Name"]')
    links = name.find("a") if name is not None else []
    handle = _text(links[1]) if len(links) > 1 else ""
    author = handle if not handle or handle.startswith("@") else "@" + handle
    return {
        "content_html": html + "</div>",
        "extracted": {"tweetId": _found(r"status/([0-9]+)", url), "tweetAuthor": author},
        "variables": {"title": f"Thread by {author}", "author": author, "site": "X (Twitter)", "description": _flat(_text(main, '[data-testid="tweetText"]'), 140)},
    }


GITHUB_SITE = ('meta[name="expected-hostname"][content="github.com"]', 'meta[name="octolytics-url"]', 'meta[name="github-keyboard-shortcuts"]', ".js-header-wrapper", "#js-repo-pjax-container")
GITHUB_PAGE = ('[data-testid="issue-metadata-sticky"]', '[data-testid="issue-title"]')
ISSUE_AUTHORS = ('a[data-testid="issue-body-header-author"]', ".IssueBodyHeaderAuthor-module__authorLoginLink--_S7aT", ".ActivityHeader-module__AuthorLink--iofTU", 'a[href*="/users/"][data-hovercard-url*="/users/"]', 'a[aria-label*="profile"]')
COMMENT_AUTHORS = (".ActivityHeader-module__AuthorLink--iofTU", 'a[data-testid="avatar-link"]', 'a[href^="/"][data-hovercard-url*="/users/"]')


def _github_author(box: Node, selectors: tuple[str, ...]) -> str:
    for s in selectors:
        if (n := first(box, s)) is not None and (href := n.get("href")):
            if href.startswith("/"):
                return href[1:]
            if name := _found(r"github\.com/([^/?#]+)", href):
                return name
    return "Unknown"


def _github_body(n: Node) -> str:
    n = n.copy()
    for s in ('button, [data-testid*="button"], [data-testid*="menu"]', ".js-clipboard-copy, .zeroclipboard-container"):
        for x in select(n, s):
            x.detach()
    return n.inner_html().strip()


def _long_date(n: Node | None) -> str:
    try:
        when = datetime.fromisoformat(n.get("datetime").replace("Z", "+00:00")) if n is not None else None
    except ValueError:
        return ""
    return f"{when:%B} {when.day}, {when.year}" if when else ""


def github(tree: Node, url: str, items: list) -> dict | None:
    if not any(first(tree, s) for s in GITHUB_SITE) or not any(first(tree, s) for s in GITHUB_PAGE):
        return None
    out = []
    issue = first(tree, '[data-testid="issue-viewer-issue-container"]')
    if issue is not None:
        author, when = _github_author(issue, ISSUE_AUTHORS), _long_date(first(issue, "relative-time"))
        body = first(issue, '[data-testid="issue-body-viewer"] .markdown-body')
        if body is not None:
            out.append(f'<div class="issue-author"><strong>{author}</strong>' + (f" opened this issue on {when}" if when else "") + f'</div>\n\n<div class="issue-body">{_github_body(body)}</div>\n\n')
    seen = set()
    for c in select(tree, "[data-wrapper-timeline-id]"):
        box, name = first(c, ".react-issue-comment"), c.get("data-wrapper-timeline-id")
        body = first(box, ".markdown-body") if box is not None else None
        if body is None or not name or name in seen:
            continue
        seen.add(name)
        when = _long_date(first(box, "relative-time"))
        out.append(f'<div class="comment">\n<div class="comment-header"><strong>{_github_author(box, COMMENT_AUTHORS)}</strong>' + (f" commented on {when}" if when else "") + f'</div>\n<div class="comment-body">{_github_body(body)}</div>\n</div>\n\n')
    plain = Node("document")
    plain.set_inner("".join(out))
    title = _text(tree, "title")
    m = re.search(r"github\.com/([^/]+)/([^/]+)", url) or re.search(r"([^/\s]+)/([^/\s]+)", title)
    owner, repo = (m[1], m[2]) if m else ("", "")
    return {
        "content_html": "".join(out),
        "extracted": {"type": "issue", "issueNumber": _found(r"/issues/([0-9]+)", url), "repository": repo, "owner": owner},
        "variables": {"title": title, "author": "", "site": f"GitHub - {owner}/{repo}", "description": re.sub(r"\s+", " ", plain.text().strip()[:140])},
    }


# Chats


def _title(tree: Node, own: str, question: str, fallback: str, suffix: str = "") -> str:
    page = _text(tree, "title")
    if suffix:
        shorter = re.sub(suffix, "", page)
        if page and shorter.strip() and shorter.strip() != own:
            return shorter.strip()
    elif page and own not in page:
        return page
    return (question[:50] + "..." if len(question) > 50 else question) or fallback


_CITATION = re.compile(r'(?is)(?:&ZeroWidthSpace;)?<span[^>]*>\s*<a(?=[^>]*?href="([^"]+)")(?=[^>]*?target="_blank")(?=[^>]*?rel="noopener")[^>]*>.*?</a>\s*</span>')


def chatgpt(tree: Node, url: str, items: list) -> dict | None:
    turns = select(tree, 'article[data-testid^="conversation-turn-"]')
    if not turns:
        return None
    messages, notes = [], []

    def cite(m: re.Match) -> str:
        notes.append(Footnote(m[1], f"Source {len(notes) + 1}"))
        n = len(notes)
        return f'<sup id="fnref:{n}"><a href="#fn:{n}">{n}</a></sup>'

    for turn in turns:
        author = _text(turn, "h5.sr-only, h6.sr-only").removesuffix(":")
        body = turn.copy()
        for n in select(body, 'h5.sr-only, h6.sr-only, span[data-state="closed"]'):
            n.detach()
        content = re.sub(r"<p[^>]*>\s*</p>", "", _CITATION.sub(cite, body.inner_html().replace("​", ""))).strip()
        if content:
            messages.append(Message(author, content, metadata={"role": turn.get("data-message-author-role") or "unknown"}))
    page = _text(tree, "title")
    title = page if page and page != "ChatGPT" else _title(tree, "", _text(turns[0], ".text-message"), "ChatGPT Conversation", r"^.*$")
    return conversation_result(messages, notes, title, "ChatGPT")


CLAUDE_FALLBACKS = ('div[class*="message"]', 'div[data-testid*="message"]', ".message", 'div[role="article"]', "article", 'div[class*="chat"]')


def claude(tree: Node, url: str, items: list) -> dict | None:
    blocks = select(tree, 'div[data-testid="user-message"], div[data-testid="assistant-message"], div.font-claude-message') or _any(tree, CLAUDE_FALLBACKS)
    if not blocks:
        return None
    messages = []
    for n in blocks:
        who = {"user-message": ("You", "you"), "assistant-message": ("Claude", "assistant")}.get(n.get("data-testid"))
        if who and (content := n.inner_html().strip()):
            messages.append(Message(who[0], content, metadata={"role": who[1]}))
    page = _text(tree, "title")
    question = _text(first(tree, '[data-testid="user-message"]'))
    title = re.sub(r" - Claude$", "", page) if page and page != "Claude" else _text(tree, "header .font-tiempos") or _title(tree, "", question, "Claude Conversation", r"^.*$")
    return conversation_result(messages, [], title, "Claude")


GROK_BOX = ".relative.group.flex.flex-col.justify-center.w-full"
GROK_FALLBACKS = ('div[class*="message"]', 'div[class*="bubble"]', 'div[class*="chat"]', 'div[class*="conversation"]', ".message", 'div[role="article"]', "article", 'div[data-testid*="message"]')
_LINK = re.compile(r'(?is)<a\s+(?:[^>]*?\s+)?href="([^"]*)"[^>]*>(.*?)</a>')


def grok(tree: Node, url: str, items: list) -> dict | None:
    boxes = select(tree, GROK_BOX) or _any(tree, GROK_FALLBACKS)
    if not boxes:
        return None
    messages, notes, numbers = [], [], {}

    def note(m: re.Match) -> str:
        link, text = m[1], m[2]
        if not re.match(r"(?i)https?://", link):
            return m[0]
        if link not in numbers:
            domain = (_host(link) or link).removeprefix("www.")
            notes.append(Footnote(link, f'<a href="{link}" target="_blank" rel="noopener noreferrer">{domain}</a>'))
            numbers[link] = len(notes)
        n = numbers[link]
        return f'{text}<sup id="fnref:{n}" class="footnote-ref"><a href="#fn:{n}" class="footnote-link">{n}</a></sup>'

    for box in boxes:
        bubble = first(box, ".message-bubble")
        if bubble is None:
            continue
        if "items-end" in box.classes():
            author, role, content = "You", "user", bubble.text().strip()
        elif "items-start" in box.classes():
            body = bubble.copy()
            for n in select(body, ".relative.border.border-border-l1.bg-surface-base"):
                n.detach()
            author, role, content = "Grok", "assistant", _LINK.sub(note, body.inner_html()).strip()
        else:
            continue
        if content:
            messages.append(Message(author, content, metadata={"role": role}))
    first_user = next((b for b in boxes if "items-end" in b.classes()), None)
    title = _title(tree, "Grok", _text(first_user, ".message-bubble"), "Grok Conversation", r"\s-\s*Grok$")
    return conversation_result(messages, notes, title, "Grok", f"Grok conversation with {len(boxes)} messages")


def gemini(tree: Node, url: str, items: list) -> dict | None:
    boxes = select(tree, "div.conversation-container")
    if not boxes:
        return None
    messages, notes = [], []
    for link in (first(i, "a") for i in select(tree, "browse-item")):
        if link is not None and link.get("href"):
            domain, title = _text(link, ".domain"), _text(link, ".title")
            notes.append(Footnote(link.get("href"), f"{domain}: {title}" if title else domain))
    for box in boxes:
        query, answer = first(box, "user-query .query-text"), first(box, "model-response")
        if query is not None and (content := query.inner_html().strip()):
            messages.append(Message("You", content, metadata={"role": "user"}))
        if answer is not None:
            body = first(answer, "#extended-response-markdown-content") or first(answer, ".model-response-text .markdown")
            if body is not None:
                body = body.copy()
                for n in select(body, ".table-content"):
                    n.attrs["class"] = " ".join(c for c in n.classes() if c != "table-content")
                if content := body.inner_html().strip():
                    messages.append(Message("Gemini", content, metadata={"role": "assistant"}))
    page = _text(tree, "title")
    title = page if page and "Gemini" not in page else _text(tree, ".title-text") or _title(tree, "", _text(boxes[0], ".query-text"), "Gemini Conversation", r"^.*$")
    return conversation_result(messages, notes, title, "Gemini")


EXTRACTORS: dict[str, Extractor] = {"twitter": twitter, "youtube": youtube, "reddit": reddit, "hackernews": hackernews, "chatgpt": chatgpt, "claude": claude, "grok": grok, "gemini": gemini, "github": github}


def extract_site(name: str, html: str, url: str, items: list) -> dict | None:
    return EXTRACTORS[name](parse(html), url, items)


__all__ = ["EXTRACTORS", "Extractor", "extract_site", "shortened"]
