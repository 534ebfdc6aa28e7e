"""Taking clutter out of a document. Each pass logs what it takes: (reason, selector, node)."""

from __future__ import annotations

import re
from functools import lru_cache

from webextract import constants as C
from webextract.css import SelectorIndex, matcher
from webextract.htmltree import Node
from webextract.operators.scoring import as_int, clutter_blocks

Log = list[tuple[str, str, Node]]
HIDDEN = ("display:none", "display: none", "visibility:hidden", "visibility: hidden", "opacity:0", "opacity: 0")
SMALL = 33


def identifier(node: Node) -> str:
    """What pictures of one source have in common, or ''."""
    if node.tag == "img":
        for name, kind in (("data-src", "src"), ("src", "src"), ("srcset", "srcset"), ("data-srcset", "srcset")):
            if node.get(name):
                return f"{kind}:{node.get(name)}"
    if node.get("id"):
        return f"id:{node.get('id')}"
    if node.tag == "svg" and node.get("viewBox"):
        return f"viewBox:{node.get('viewBox')}"
    return f"class:{node.get('class')}" if node.get("class") else ""


def small_images(document: Node) -> set[str]:
    """Identifiers of images with a width or height of 1 to 32."""
    return {identifier(n) for n in document.find("img", "svg") if 0 < as_int(n.attrs.get("width")) < SMALL or 0 < as_int(n.attrs.get("height")) < SMALL} - {""}


def _take(nodes: list[Node], reason: str, selector: str, log: Log) -> None:
    for n in nodes:
        log.append((reason, selector, n))
        n.detach()


def remove_small_images(document: Node, small: set[str], log: Log) -> None:
    """Every image that shares an identifier with a small one, be it large."""
    _take([n for n in document.find("img", "svg") if identifier(n) in small], "small_image", "", log)


def remove_all_images(document: Node, log: Log) -> None:
    _take(document.find("img", "svg", "picture", "video", "canvas"), "image", "", log)


def remove_hidden(document: Node, log: Log) -> None:
    _take([n for n in document.elements() if "style" in n.attrs and any(h in n.attrs["style"].lower() for h in HIDDEN)], "hidden", "", log)


def remove_by_score(document: Node, log: Log) -> None:
    _take(clutter_blocks(document), "score", "", log)


@lru_cache(maxsize=16)
def _index(selectors: tuple[str, ...]) -> SelectorIndex:
    return SelectorIndex(selectors)


def remove_exact(document: Node, log: Log, selectors: tuple[str, ...] = C.EXACT_SELECTORS) -> None:
    """Selector by selector, so that what went with an ancestor isn't taken again. An element's matches don't change as others go, for
    what a selector asks of ancestors goes along with them; so all are found in one pass."""
    index = _index(selectors)
    hits = [(i, k, n) for k, n in enumerate(document.elements()) for i in index.matches(n)]
    for i, _, n in sorted(hits, key=lambda h: h[:2]):
        top = n
        while top.parent is not None:
            top = top.parent
        if top is document:
            log.append(("exact", selectors[i], n))
            n.detach()


@lru_cache(maxsize=16)
def partial_regex(patterns: tuple[str, ...] | None = None) -> str:
    return "|".join(re.escape(p.lower()) for p in (C.PARTIAL_PATTERNS if patterns is None else patterns)) or "(?!)"


@lru_cache(maxsize=16)
def _partial(patterns: tuple[str, ...] | None):
    return re.compile(partial_regex(patterns)).search


def partial_matches(document: Node, patterns: tuple[str, ...] | None = None) -> list[Node]:
    """Elements one of whose class, id or test attributes contains a pattern."""
    search = _partial(patterns)
    return [n for n in document.elements() if n.attrs and any(search(n.attrs[a].lower()) for a in C.TEST_ATTRIBUTES if a in n.attrs)]


def remove_partial(document: Node, log: Log, patterns: tuple[str, ...] | None = None) -> None:
    """They are found before any is taken."""
    _take(partial_matches(document, patterns), "partial", "", log)


def apply_mobile_styles(document: Node, styles: tuple[tuple[str, str], ...]) -> None:
    for selector, style in styles:
        test = matcher(selector)
        for n in document.elements():
            if test(n):
                n.attrs["style"] = n.get("style") + style
