"""Main text of web pages: gradient-boosted trees over the features of DOM nodes, decoded along the tree.

A page's body becomes a tree of blocks: block elements, and the runs of text and inline elements between them. The trees give each node
the log-odds of belonging to the article (or holding some of it), from its tag, the families that its class, id and role tokens belong
to, its own and its ancestors', the text density of its subtree, its depth and its place among its siblings. Decoding takes the likeliest
labelling in which a node in the article has no ancestor outside of it: one pass up and one down.

There is no labelled page, so the trees are fitted on synthetic ones (training_pages of them, from a seed) whose articles are laid out in
many ways among menus, headers, footers, sidebars, notices, adverts, forms and comments.

Defined results. A null html is an empty page; pages without an article, and empty ones, have the text ''. White space is what str.split()
splits on. Repeated rows come out repeatedly; null ids and urls come out. An empty table gives an empty one. What isn't shown (scripts,
styles, templates) and controls (buttons, fields) are no text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webextract.htmltree import Node, body_of, parse
from webextract.llm import gbt

UNSEEN = frozenset("script style noscript template head title meta link iframe svg canvas audio video object embed select option button textarea input datalist progress meter map".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody tfoot thead tr td th caption ul".split()
)
TAG_GROUPS = [frozenset(x.split()) for x in ("article", "main", "section", "div center body html", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl menu dir", "li dt dd", "nav", "header hgroup", "footer", "aside", "form fieldset legend search", "table tbody thead tfoot tr td th caption", "blockquote pre", "figure figcaption", "address details dialog summary")]
#: Families of tokens in class, id, role and aria-label.
FAMILIES = {
    "body": "article articlebody content contents entry main post posting story text body prose markdown blog single",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager tabs topnav skip links",
    "head": "header masthead head banner logo branding topbar hero toolbar",
    "foot": "footer foot copyright colophon contentinfo bottom legal",
    "side": "sidebar side aside rail widget complementary related recommended recommendations popular trending more secondary",
    "note": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall message toast announcement warning dialog notification",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion dfp adsense banner outbrain taboola",
    "form": "form search login signin register contact field input",
    "reader": "comment comments commentlist reply replies respond discussion disqus reviews feedback responses",
    "share": "share sharing social facebook twitter follow like meta byline author tags tag",
}
_FAMILY_OF: dict[str, list[int]] = {}
for _i, _words in enumerate(FAMILIES.values()):
    for _w in _words.split():
        _FAMILY_OF.setdefault(_w, []).append(_i)
_TOKENS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_END = tuple(".!?:;\"'”»…")


@dataclass
class Block:
    tag: str
    parent: int
    depth: int
    families: tuple[int, ...]
    text: str = ""
    link_chars: int = 0
    controls: int = 0


def token_families(node: Node) -> tuple[int, ...]:
    raw = " ".join([node.attrs[k] for k in ("class", "id", "role", "aria-label") if k in node.attrs])
    out = [0] * len(FAMILIES)
    if raw:
        for token in _TOKENS.findall(_CAMEL.sub(" ", raw).lower()):
            for i in _FAMILY_OF.get(token, ()):
                out[i] = 1
    return tuple(out)


_NONE = (0,) * len(FAMILIES)


def blocks_of(document: Node) -> list[Block]:
    """Blocks in page order; a block's parent comes before it. Blocks with text have no children."""
    out: list[Block] = []
    run: list[str] = []
    links = [0]

    def flush(owner: int, whole: bool) -> None:
        text = " ".join("".join(run).split())
        run.clear()
        link, links[0] = links[0], 0
        if text:
            if whole:
                out[owner].text, out[owner].link_chars = text, link
            else:
                out.append(Block("", owner, out[owner].depth + 1, _NONE, text, link))

    # An explicit stack, as pages may be nested deeply: (node, owner, in a link), or (None, owner, the number of blocks when it began).
    stack: list[tuple] = [(body_of(document), -1, False)]
    while stack:
        node, owner, link = stack.pop()
        if node is None:
            flush(owner, len(out) == link)
            continue
        if node.kind == "text":
            run.append(node.data)
            if link:
                links[0] += len(node.data)
        elif node.kind == "element":
            tag = node.tag
            if tag in UNSEEN:
                if owner >= 0 and tag in ("select", "button", "textarea", "input"):
                    out[owner].controls += 1
            elif tag == "br":
                run.append(" ")
            elif tag in BLOCKS:
                if owner >= 0:
                    flush(owner, False)
                out.append(Block(tag, owner, out[owner].depth + 1 if owner >= 0 else 0, token_families(node)))
                me = len(out) - 1
                stack.append((None, me, len(out)))
                stack.extend([(c, me, link) for c in reversed(node.children)])
            else:
                inside = link or tag == "a"
                stack.extend([(c, owner, inside) for c in reversed(node.children)])
    return out


N_OWN = len(TAG_GROUPS) + len(FAMILIES)
_GROUP_OF = {tag: i for i, tags in reversed(list(enumerate(TAG_GROUPS))) for tag in tags}


def forest(pages: list[list[Block]]) -> tuple[list[Block], np.ndarray, list[np.ndarray]]:
    """The blocks of all pages, each one's parent among them (-1 for a page's body), and the blocks of each depth."""
    blocks = [b for page in pages for b in page]
    starts = np.repeat(np.cumsum([0, *map(len, pages)])[:-1], [len(p) for p in pages])
    parent = np.array([b.parent for b in blocks], dtype=np.int64)
    parent = np.where(parent < 0, -1, parent + starts)
    depth = np.array([b.depth for b in blocks], dtype=np.int64)
    order = np.argsort(depth, kind="stable")
    return blocks, parent, np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)


def features(blocks: list[Block], parent: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """A row for each block of a forest."""
    n = len(blocks)
    own = np.zeros((n, N_OWN))
    group = np.array([_GROUP_OF.get(b.tag, -1) for b in blocks])
    own[np.flatnonzero(group >= 0), group[group >= 0]] = 1
    own[:, len(TAG_GROUPS) :] = [b.families for b in blocks]
    words = np.array([b.text.count(" ") + 1 if b.text else 0 for b in blocks], dtype=float)
    ends = np.array([b.text.endswith(_END) for b in blocks], dtype=float)
    chars = np.array([len(b.text) for b in blocks], dtype=float)
    before = np.cumsum(chars) - chars
    # Sums over the subtrees: characters, of links, words, marks, ends, blocks, texts, controls, paragraphs.
    sums = np.column_stack(
        [
            chars,
            [b.link_chars for b in blocks],
            words,
            [b.text.count(",") + b.text.count(".") for b in blocks],
            ends,
            np.ones(n),
            chars > 0,
            [b.controls for b in blocks],
            [b.tag == "p" and b.text != "" for b in blocks],
        ]
    )
    for level in reversed(levels[1:]):
        np.add.at(sums, parent[level], sums[level])
    above = np.zeros((n, N_OWN))
    for level in levels[1:]:
        above[level] = np.maximum(above[parent[level]], own[parent[level]])
    root = np.arange(n)
    for level in levels[1:]:
        root[level] = root[parent[level]]
    siblings = np.argsort(parent, kind="stable")
    first = np.flatnonzero(np.diff(parent[siblings], prepend=-2))
    sizes = np.diff(np.append(first, n))
    index, many = np.empty(n), np.empty(n)
    index[siblings] = np.arange(n) - np.repeat(first, sizes)
    many[siblings] = np.repeat(sizes, sizes)
    top = parent < 0
    index[top], many[top] = 0, 1
    names: dict[str, int] = {}
    kind = np.array([names.setdefault(b.tag, len(names)) for b in blocks])
    _, at, times = np.unique(parent * (len(names) + 1) + kind, return_inverse=True, return_counts=True)
    alike = np.where(top, 1, times[at])
    all_chars, link, all_words, marks, all_ends, size, texts, controls, paragraphs = sums.T
    total, up = np.maximum(all_chars[root], 1), np.where(top, np.arange(n), parent)
    before = before - before[root]
    rest = np.column_stack(
        [
            np.log1p(all_chars),
            np.log1p(words),
            link / np.maximum(all_chars, 1),
            marks / np.maximum(all_words, 1),
            all_ends / np.maximum(texts, 1),
            all_chars / size,
            all_words / np.maximum(texts, 1),
            np.log1p(size),
            np.log1p(paragraphs),
            np.minimum(controls, 5),
            [b.depth for b in blocks],
            np.minimum(index, 30),
            np.minimum(many, 30),
            alike / many,
            (many - 1 - index).clip(0, 30),
            before / total,
            (before + all_chars) / total,
            all_chars / total,
            all_chars / np.maximum(all_chars[up], 1),
            link[up] / np.maximum(all_chars[up], 1),
            np.log1p(all_chars[up]),
            ends,
        ]
    )
    return np.column_stack([own, above, own[up], rest])


def decode(parent: np.ndarray, levels: list[np.ndarray], odds: np.ndarray) -> np.ndarray:
    """The likeliest labels in which no block is in the article under one that isn't."""
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    for level in reversed(levels[1:]):
        np.add.at(keep, parent[level], np.maximum(keep[level], drop[level]))
        np.add.at(drop, parent[level], drop[level])
    out = keep > drop
    for level in levels[1:]:
        out[level] &= out[parent[level]]
    return out


def main_texts(pages: list[list[Block]], model: gbt.Trees) -> list[str]:
    blocks, parent, levels = forest(pages)
    inside = decode(parent, levels, model.score(features(blocks, parent, levels)))
    out, at = [], 0
    for page in pages:
        out.append("\n\n".join([b.text for b, x in zip(page, inside[at : at + len(page)]) if x and b.text]))
        at += len(page)
    return out


class PageMaker:
    """Synthetic pages. What belongs to the article is marked by an attribute that the features don't see."""

    def __init__(self, seed: int) -> None:
        self.r = np.random.default_rng(seed)

    def pick(self, *options):
        return options[int(self.r.integers(len(options)))]

    def word(self) -> str:
        return "".join(self.pick("an", "er", "tho", "in", "re", "la", "ou", "sch", "que", "mi", "en", "st", "é", "ü", "ción", "ver") for _ in range(self.r.integers(1, 5)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.integers(low, high + 1)))

    def sentence(self, low: int = 3, high: int = 25) -> str:
        junk = self.pick("", "", "", "", "***", "!!", "%%%")
        text = self.words(low, high).capitalize() + self.pick(".", ".", ".", "!", "?", "")
        return " ".join(w + junk for w in text.split()) if junk else text

    def prose(self, most: int = 6) -> str:
        text = self.sentence(1, 3) if self.r.random() < 0.12 else " ".join(self.sentence() for _ in range(self.r.integers(1, most + 1)))
        if self.r.random() < 0.3:
            at = text.find(" ")
            text = f'{text[:at]} <a href="/x">{self.words(1, 4)}</a>{text[at:]}'
        if self.r.random() < 0.2:
            text = self.pick("<b>", "<b>", "<em>", "<i>") + text  # not closed
        if self.r.random() < 0.2:
            text += "<br>" + self.pick("", self.sentence())
        return text

    def attrs(self, *names: str, chance: float = 0.9) -> str:
        if not names or self.r.random() > chance:
            return ""
        name = self.pick(*names)
        return f' {self.pick("class", "class", "id")}="{self.pick("", "", "c-", "js-", "page-")}{name}{self.pick("", "", "-wrap", "-inner", "__block", " clearfix")}"'

    def label(self) -> str:
        """What a link in a menu says."""
        text = self.words(1, self.pick(1, 1, 3))
        return (text.capitalize() if self.r.random() < 0.4 else text) + self.pick("", "", "", ".", ",", ".")

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{i}">{self.label()}</a></li>' for i in range(n))

    def junk(self, kind: str) -> str:
        r, many = self.r, int(self.r.integers(2, 9))
        if kind == "menu":
            inner = self.pick(f"<ul>{self.links(many)}</ul>", " ".join(f'<a href="#">{self.label()}</a>' for _ in range(many)))
            return self.pick(f"<nav>{inner}</nav>", f"<nav>{inner}</nav>", f"<nav{self.attrs('menu', 'navbar')}>{inner}</nav>", f"<div{self.attrs('menu', 'navigation', 'nav', 'breadcrumbs', 'pagination', 'topnav', chance=1)}>{inner}</div>", f"<ul{self.attrs('menu', 'nav', 'breadcrumb', chance=1)}>{self.links(many)}</ul>")
        if kind == "head":
            inner = self.pick("", f"<h1>{self.words(1, 4)}</h1>", f"<h2>{self.words(1, 4)}</h2>") + self.pick(self.words(1, 6), f"<p>{self.sentence(2, 9)}</p>", self.junk("menu"))
            return self.pick(f"<header>{inner}</header>", f"<header{self.attrs('header', 'masthead')}>{inner}</header>", f"<div{self.attrs('header', 'masthead', 'topbar', 'branding', 'site-header', chance=1)}>{inner}</div>")
        if kind == "foot":
            text = f"{self.pick('&copy; ', '© 2020 ', '')}{self.words(1, 4)} {self.pick('&middot; ', '| ', '')}{self.sentence()}"
            inner = self.pick(text, f"<p>{text}</p>", f"<ul>{self.links(many)}</ul><p>{text}</p>")
            return self.pick(f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f"<div{self.attrs('footer', 'site-footer', 'copyright', 'bottom', chance=1)}>{inner}</div>")
        if kind == "side":
            inner = f"<h3>{self.words(1, 4)}</h3>" + self.pick(f"<ul>{self.links(many)}</ul>", f"<p>{self.prose(3)}</p>", f"<div><p>{self.prose(2)}</p></div><ul>{self.links(3)}</ul>")
            return self.pick(f"<aside>{inner}</aside>", f"<aside{self.attrs('sidebar', 'widget')}>{inner}</aside>", f"<div{self.attrs('sidebar', 'widget', 'related', 'related-posts', 'recommended', 'rail', 'popular', chance=1)}>{inner}</div>")
        if kind == "note":
            inner = self.pick(self.sentence(), f"<p>{self.prose(2)}</p>", f"<p>{self.sentence()}</p><button>{self.word()}</button>", f"{self.sentence()} <a href='#'>{self.word()}</a>")
            tag = self.pick("div", "div", "div", "section", "p", "aside", "dialog")
            role = self.pick("", ' role="alert"', ' role="dialog"')
            return f"<{tag}{self.attrs('cookie-notice', 'cookie-banner', 'notice', 'alert', 'consent', 'gdpr', 'popup', 'newsletter', 'subscribe', 'paywall', 'modal', 'announcement', chance=1)}{role}>{inner}</{tag}>"
        if kind == "advert":
            inner = self.pick(self.sentence(), self.sentence(), f"<p>{self.prose(2)}</p>", f'<a href="#">{self.sentence(2, 10)}</a>', f"<img src='x.gif'><p>{self.words(2, 8)}</p>")
            tag = self.pick("div", "div", "div", "section", "ins", "aside", "p")
            return f"<{tag}{self.attrs('ad', 'ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'ad-slot', 'banner-ad', 'ad-container', chance=1)}>{inner}</{tag}>"
        if kind == "form":
            inner = f"<label>{self.words(1, 3)}</label><input name=q><button>{self.word()}</button>" + self.pick("", f"<p>{self.sentence()}</p>", f"<legend>{self.words(1, 3)}</legend>")
            return self.pick(f"<form>{inner}</form>", f"<form{self.attrs('search', 'login', 'contact', 'newsletter')}>{inner}</form>", f"<div{self.attrs('search', 'login', 'signup', chance=1)}><form>{inner}</form></div>")
        if kind == "share":
            inner = self.pick(f"<ul>{self.links(3)}</ul>", " ".join(f'<a href="#">{self.word()}</a>' for _ in range(3)), f"{self.word()}: <a href='#'>{self.word()}</a>")
            return f"<div{self.attrs('share', 'social', 'sharing', 'share-buttons', 'tags', chance=1)}>{inner}</div>"
        one = lambda: f"<{(t := self.pick('div', 'li', 'article'))}{self.attrs('comment', 'comment-body', 'reply', chance=0.9)}>{self.pick('', f'<b>{self.word()}</b> ', f'<h4>{self.words(1, 2)}</h4>')}{self.pick(f'<p>{self.prose(3)}</p>', self.sentence())}</{t}>"
        inner = self.pick(f"<h3>{self.words(1, 3)}</h3>", f"<h2>{self.words(1, 3)}</h2>", "") + "".join(one() for _ in range(r.integers(1, 6))) + self.pick("", self.junk("form"))
        tag = self.pick("div", "section", "section", "ol", "aside")
        return f"<{tag}{self.attrs('comments', 'comments', 'discussion', 'comment-list', 'replies', 'disqus', 'responses', 'reader-comments', chance=1)}>{inner}</{tag}>"

    def own(self, html: str) -> str:
        """Marks every start tag of the article's own blocks."""
        return re.sub(r"<(p|h[1-6]|ul|ol|li|blockquote|pre|table|tr|td|th|figure|figcaption|div|section|article|main|header|dl|dt|dd)(?=[\s>])", r"<\1 data-own", html)

    def piece(self) -> str:
        kind = self.r.random()
        if kind < 0.72:
            return f"<p>{self.prose(self.pick(1, 2, 6, 10))}" + self.pick("</p>", "</p>", "</p>", "")
        if kind < 0.80:
            return f"<h{(k := self.pick(2, 2, 3, 4))}>{self.words(1, 8)}</h{k}>"
        if kind < 0.86:
            return f"<{(t := self.pick('ul', 'ol'))}>" + "".join(f"<li>{self.prose(1)}</li>" for _ in range(self.r.integers(1, 6))) + f"</{t}>"
        if kind < 0.90:
            return f"<blockquote>{self.pick(self.prose(2), f'<p>{self.prose(2)}</p>')}</blockquote>"
        if kind < 0.93:
            return f"<pre>{self.words(2, 20)}\n{self.words(2, 20)}</pre>"
        if kind < 0.96:
            return f"<figure><img src=a.jpg><figcaption>{self.sentence()}</figcaption></figure>"
        return "<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 6)}</td></tr>" for _ in range(self.r.integers(1, 5))) + "</table>"

    def page(self) -> str:
        r = self.r
        pieces = [self.own(self.piece()) for _ in range(self.pick(1, 1, 2, 3, 5, 8, 15))]
        title = self.words(1, self.pick(2, 10))
        heading = self.pick(f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>", "")
        inside = ["advert", "share", "side", "note", "form", "menu", "foot"]
        for _ in range(int(r.integers(0, 3)) if r.random() < 0.5 else 0):
            pieces.insert(int(r.integers(0, len(pieces) + 1)), self.junk(self.pick(*inside)))
        body = self.own(heading) + "".join(pieces)
        if r.random() < 0.12:
            body += self.junk("reader")
        article = self.pick(
            f"<article data-own>{body}</article>",
            f"<article data-own>{body}</article>",
            f"<article data-own{self.attrs('post', 'story')}><div data-own{self.attrs('entry-content', 'article-body', 'content')}>{body}</div></article>",
            f"<main data-own>{body}</main>",
            f"<main data-own><article data-own>{body}</article></main>",
            f"<div data-own{self.attrs('content', 'post-content', 'article', 'entry', 'main', 'story', 'post', 'article-body', 'text', chance=0.85)}>{body}</div>",
            f"<section data-own{self.attrs('content', 'article', 'story', chance=0.7)}>{body}</section>",
            f"<div data-own role='main'>{body}</div>",
        )
        outer = ["menu", "head", "advert", "note", "side", "form", "share"]
        first = [self.junk(self.pick(*outer)) for _ in range(self.pick(0, 1, 2, 2, 3, 4))]
        after = [self.junk(self.pick("side", "advert", "reader", "reader", "share", "note", "form", "menu")) for _ in range(self.pick(0, 0, 1, 2, 3))]
        if r.random() < 0.8:
            after.append(self.junk("foot"))
        if r.random() < 0.15:
            article = f"<div data-own{self.attrs('wrapper', 'container', 'row', 'layout', 'content')}>{article}{self.pick('', self.junk('side'))}</div>"
        inner = "".join(first) + article + "".join(after)
        if r.random() < 0.3:
            inner = f"<div data-own{self.attrs('wrapper', 'container', 'page', 'site', 'layout')}>{inner}</div>"
        return f"<!DOCTYPE html><html><head><title>{title}</title></head><body data-own>{inner}</body></html>"


def labelled(html: str) -> tuple[list[Block], np.ndarray]:
    """A synthetic page's blocks, and which of them are the article's own; a run of text is its parent's."""
    document = parse(html)
    marks: list[bool] = []
    for n in document.walk():
        if n.kind == "element" and n.tag in BLOCKS and n.tag != "html":
            n.attrs["aria-label"] = n.attrs.get("aria-label", "") + ("\x01" if "data-own" in n.attrs else "\x02")
    seen: list[Block] = []
    original = token_families

    def spy(node: Node) -> tuple[int, ...]:
        marks.append("\x01" in node.attrs.get("aria-label", ""))
        return original(node)

    globals()["token_families"] = spy
    try:
        seen = blocks_of(document)
    finally:
        globals()["token_families"] = original
    at, y = iter(marks), np.zeros(len(seen), dtype=bool)
    for i, b in enumerate(seen):
        y[i] = next(at) if b.tag else y[b.parent]
        if b.parent >= 0:
            y[i] &= y[b.parent]
    return seen, y


@lru_cache(maxsize=4)
def fit_model(training_pages: int = 1000, seed: int = 1) -> gbt.Trees:
    maker = PageMaker(seed)
    pages, y = zip(*(labelled(maker.page()) for _ in range(training_pages)))
    return gbt.fit(features(*forest(list(pages))), np.concatenate(y).astype(float), trees=60, depth=5, rate=0.25, bins=32, least=4, sample=0.4)


def extract_main_text(pages: DataFrame, model: gbt.Trees | None = None) -> DataFrame:
    """pages: page_id, url, html. Returns page_id, url, text, n_chars."""
    model = model or fit_model()
    source = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 100):
                batch = whole.slice(i, 100)
                pages = [blocks_of(parse(x.as_py())) for x in batch.column(2)]
                texts = main_texts(pages, model)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return source.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
