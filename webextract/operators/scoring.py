"""Scores of blocks: which one is the main content, and which ones are clutter."""

from __future__ import annotations

import re
from collections.abc import Iterable

from webextract import constants as C
from webextract.css import SelectorIndex, closest, select
from webextract.htmltree import Node

#: \\b of an engine in which words are ASCII.
_EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
DATE_PATTERN = _EDGE + r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*[ \t\n\f\r]+[0-9]{1,2},?[ \t\n\f\r]+[0-9]{4}" + _EDGE
BYLINE_PATTERN = _EDGE + r"(?:by|written by|author:)[ \t\n\f\r]+[A-Za-z \t\n\f\r]+" + _EDGE
_DATE, _BYLINE = re.compile(DATE_PATTERN, re.I), re.compile(BYLINE_PATTERN, re.I)
_REFERENCES, _LISTS = SelectorIndex(C.FOOTNOTE_REFERENCES), SelectorIndex(C.FOOTNOTE_LISTS)
_ENTRIES = SelectorIndex(C.ENTRY_POINTS)


def as_int(text: str | None) -> int:
    """A whole number with nothing else in the text, else 0."""
    return int(text) if text and re.fullmatch(r"[+-]?[0-9]+", text) else 0


def has_footnote_list(elements: list[Node]) -> bool:
    return _LISTS.any(elements)


def score_terms(node: Node) -> dict[str, float]:
    """The terms of a block's score, by name; the score is their sum."""
    inside = node.elements()
    text = node.text().strip()
    words = len(text.split())
    count = lambda tag: sum(n.tag == tag for n in inside)
    style, look = node.get("style"), node.get("class").lower()
    terms = {
        "words": float(words),
        "paragraphs": count("p") * 10.0,
        "link_density": -5 * count("a") / max(words, 1),
        "image_density": -3 * count("img") / max(words, 1),
        "right_side": 5.0 * ("float: right" in style or "text-align: right" in style or node.get("align") == "right"),
        "date": 10.0 * bool(_DATE.search(text)),
        "byline": 10.0 * bool(_BYLINE.search(text)),
        "content_class": 15.0 * any(w in look for w in ("content", "article", "post")),
        "footnote_references": 10.0 * _REFERENCES.any(inside),
        "footnote_list": 10.0 * has_footnote_list(inside),
        "nested_tables": -5.0 * count("table"),
        "center_cell": 0.0,
    }
    if node.tag == "td" and (table := closest(node, "table")) is not None:
        look = table.get("class").lower()
        if as_int(table.attrs.get("width")) > 400 or table.get("align") == "center" or "content" in look or "article" in look:
            cells = table.find("td")
            at = next(i for i, c in enumerate(cells) if c is node)
            terms["center_cell"] = 10.0 * (0 < at < len(cells) - 1)
    return terms


def score(node: Node) -> float:
    return sum(score_terms(node).values())


def best(candidates: Iterable[Node], over: float = 50.0) -> Node | None:
    """The first of the highest scores, if it is more than `over`."""
    found, top = None, 0.0
    for n in candidates:
        if (s := score(n)) > top:
            found, top = n, s
    return found if top > over else None


def main_content(document: Node) -> tuple[Node | None, str]:
    """The main content, and what found it: an entry point's selector, "table_cell", "scored_block" or "body"."""
    found: dict[int, Node] = {}
    for n in document.elements():
        for i in _ENTRIES.matches(n):
            found.setdefault(i, n)
    for i, selector in enumerate(C.ENTRY_POINTS):
        if selector != "body" and i in found:
            return found[i], selector
    if (cell := best(select(document, "table td"))) is not None:
        return cell, "table_cell"
    if (block := best(document.find("div", "section", "article", "main"))) is not None:
        return block, "scored_block"
    body = document.find("body")
    return (body[0], "body") if body else (None, "")


def is_likely_content(node: Node) -> bool:
    if node.get("role") in C.CONTENT_ROLES:
        return True
    names = (node.get("class").lower(), node.get("id").lower())
    if any(w in x for w in C.CONTENT_INDICATORS for x in names):
        return True
    words, paragraphs = len(node.text().split()), len(node.find("p"))
    return words > 100 or (words > 50 and paragraphs > 1) or (words > 30 and paragraphs > 0)


def clutter_score(node: Node) -> float:
    """Below zero for a block of navigation or the like."""
    inside = node.elements()
    text = node.text().strip()
    words = len(text.split())
    if has_footnote_list(inside) or words < 3:
        return 0.0
    text = text.lower()
    out = -10.0 * sum(p in text for p in C.NAVIGATION_PHRASES)
    links, lists = sum(n.tag == "a" for n in inside), sum(n.tag in ("ul", "ol") for n in inside)
    if links / max(words, 1) > 0.5:
        out -= 15
    if lists and links > 3 * lists:
        out -= 10
    names = (node.get("class").lower(), node.get("id").lower())
    return out - 8.0 * sum(any(p in x for x in names) for p in C.NON_CONTENT_PATTERNS)


def clutter_blocks(document: Node) -> list[Node]:
    """Judged before any of them is taken out."""
    return [n for n in document.find(*C.BLOCK_TAGS) if not is_likely_content(n) and clutter_score(n) < 0]
