"""Normalising the main content: headings, footnotes, roles, wrappers, attributes, white space."""

from __future__ import annotations

import re

from webextract import constants as C
from webextract.css import first, select
from webextract.htmltree import Node, element, fragment, text_node

_SEMANTIC = re.compile("article|main|content|footnote|reference|bibliography")
_WRAPPER = re.compile("wrapper|container|layout|row|col|grid|flex|outer|inner|content-area")
_ORDERED = re.compile(r"^[0-9]+\)")
_S = r"[ \t\n\f\r]"
_WIDTHLESS = "‌​‍‎‏﻿"
_BLANK = re.compile(rf"^[{_WIDTHLESS}\xa0 \t\n\f\r]*$")
_BLOCK_EDGE = re.compile(rf"^[\n\r\t {_WIDTHLESS}\xa0]*$")
_INLINE_EDGE = re.compile(rf"^[\n\r\t{_WIDTHLESS}]*$")
_STARTS = re.compile(r"^[,.!?:;)\]]")
_ENDS = re.compile(rf"[,.!?:;(\[]{_S}*$")
#: In this order, outside of pre and code.
TEXT_CHAIN = (
    (r"\n{3,}", "\n\n"),
    (r"^[\n\r\t]+", ""),
    (r"[\n\r\t]+$", ""),
    (r"[ \t]*\n[ \t]*", "\n"),
    (r"[ \t]{3,}", " "),
    (r"^[ ]+$", " "),
    (rf"{_S}+([,.!?:;])", r"\1"),
    (rf"[{_WIDTHLESS}]+", ""),
    (r"\xa0{2,}", "\xa0"),
)
# In Go's and this chain's sense $ is the end of the text, not the place before a last newline.
_CHAIN = tuple((re.compile(p.replace("$", r"\Z")), to) for p, to in TEXT_CHAIN)


def normalized_text(text: str) -> str:
    for pattern, to in _CHAIN:
        text = pattern.sub(to, text)
    return text


def _renamed(node: Node, tag: str, drop: tuple[str, ...] = ()) -> Node:
    """A `tag` with the node's children and allowed attributes in its place."""
    new = Node("element", tag, {k: v for k, v in node.attrs.items() if k in C.ALLOWED_ATTRIBUTES and k not in drop})
    node.replace([new])
    new.take_children(node)
    return new


def spaces(root: Node) -> None:
    """A no-break space outside of pre and code becomes as many spaces as it has bytes."""
    stack = [root]
    while stack:
        n = stack.pop()
        if n.kind == "text":
            n.data = n.data.replace("\xa0", "  ")
        elif n.tag not in ("pre", "code"):
            stack.extend(n.children)


def _plain(text: str) -> str:
    return re.sub(_S + "+", " ", text.replace("\xa0", " ")).strip().lower()


def headings(root: Node, title: str) -> None:
    for h in root.find("h1"):
        _renamed(h, "h2")
    second = root.find("h2")
    if second and (t := _plain(title)) and t == _plain(second[0].text()):
        second[0].detach()


def footnotes(root: Node) -> None:
    for s in ('a[href^="#"][class*="anchor"]', 'a[href^="#"][class*="ref"]', 'a[class*="footnote-backref"]', ".footnote-backref"):
        for n in select(root, s):
            n.detach()
    for s in C.FOOTNOTE_REFERENCES:
        for n in select(root, s):
            if n.tag != "sup":
                sup = element("sup")
                n.replace([sup])
                sup.take_children(n)


def _paragraphs(root: Node) -> None:
    for d in select(root, 'div[role="paragraph"]'):
        p = element("p")
        d.replace([p])
        p.take_children(d)


def _list_of(node: Node, depth: int = 0) -> Node:
    label = first(node, 'div[role="listitem"] .label')
    out = element("ol" if label is not None and _ORDERED.match(label.text().strip()) else "ul")
    for item in select(node, 'div[role="listitem"]'):
        li, content = element("li"), first(item, ".content")
        if content is not None:
            _paragraphs(content)
            if depth == 0:
                for inner in select(content, 'div[role="list"]'):
                    if inner.parent is not None:
                        inner.replace([_list_of(inner, 1)])
            li.take_children(content)
        out.append(li)
    return out


def roles(root: Node) -> None:
    """Paragraphs, lists and list items that are divs with a role, and lite-youtube players."""
    for n in select(root, 'div[data-testid^="paragraph"], div[role="paragraph"]'):
        _renamed(n, "p", ("role",))
    for n in select(root, 'div[role="list"]'):
        if _attached(n, root):
            n.replace([_list_of(n)])
    for n in select(root, 'div[role="listitem"]'):
        content = first(n, ".content")
        if content is not None and _attached(n, root):
            _paragraphs(content)
            content.detach()
            n.replace([content])
    for n in select(root, "lite-youtube"):
        if video := n.get("videoid"):
            attrs = {"width": "560", "height": "315", "src": f"https://www.youtube.com/embed/{video}", "title": n.get("videotitle") or "YouTube video player", "frameborder": "0"}
            attrs |= {"allow": "accelerometer; autoplay; clipboard-write; encrypted-media; gyroscope; picture-in-picture; web-share", "allowfullscreen": ""}
            n.replace([element("iframe", attrs)])


def _attached(n: Node, root: Node) -> bool:
    while n is not None and n is not root:
        n = n.parent
    return n is root


def _only_block_kids(n: Node) -> bool:
    kids = n.kids()
    return bool(kids) and not any(k.tag in C.INLINE_TAGS for k in kids)


def _own_text(n: Node) -> bool:
    return any(c.kind == "text" and c.data.strip() for c in n.children)


def _inline_inside(n: Node) -> bool:
    return _own_text(n) or any(c.kind == "element" and c.tag in C.INLINE_TAGS for c in n.children)


def is_preserved(n: Node) -> bool:
    keeps = lambda x, roles: x.tag in C.PRESERVED_TAGS or x.get("role") in roles or bool(_SEMANTIC.search(x.get("class").lower()))
    return keeps(n, ("article", "main", "navigation", "banner", "contentinfo")) or any(keeps(k, ("article",)) for k in n.kids())


def is_wrapper(n: Node) -> bool:
    if _inline_inside(n):
        return False
    kids = n.kids()
    if not kids or not n.text().strip():
        return True
    if all(k.tag in C.BLOCK_TAGS or k.tag in C.MORE_BLOCK_TAGS for k in kids):
        return True
    return bool(_WRAPPER.search(n.get("class").lower())) or not _own_text(n) or _only_block_kids(n)


def _flatten_one(n: Node, root: Node) -> bool:
    """The first rule that holds for a block; whether one did."""
    if n.parent is None or is_preserved(n):
        return False
    if n.tag not in C.ALLOWED_EMPTY_TAGS and not n.kids() and not n.text().strip():
        n.detach()
        return True
    if (n.parent is root and _only_block_kids(n)) or is_wrapper(n):
        n.unwrap()
        return True
    inline_only = all(c.kind == "text" or (c.kind == "element" and c.tag in C.INLINE_TAGS) for c in n.children)
    if inline_only and _own_text(n):
        p = element("p")
        n.replace([p])
        p.take_children(n)
        return True
    kids = n.kids()
    if len(kids) == 1 and kids[0].tag in C.BLOCK_TAGS and not is_preserved(kids[0]):
        bare = element(kids[0].tag)
        bare.take_children(kids[0])
        n.replace([bare])
        return True
    if any(a.tag in C.BLOCK_TAGS for a in n.ancestors()) and not _inline_inside(n):
        n.unwrap()
        return True
    return False


def _depth(n: Node) -> int:
    return sum(1 for _ in n.ancestors())


def flatten(root: Node) -> None:
    """Takes wrappers off: the top level, then the deepest blocks first, then what holds only paragraphs; again until nothing changes."""
    while True:  # every change takes an element away, so it ends
        changed = False
        for n in root.kids():
            if n.tag in C.BLOCK_TAGS:
                changed |= _flatten_one(n, root)
        for n in sorted(root.find(*C.BLOCK_TAGS), key=_depth, reverse=True):
            if _attached(n, root):
                changed |= _flatten_one(n, root)
        for n in root.find(*C.BLOCK_TAGS):
            if _attached(n, root):
                kids = n.kids()
                if (kids and all(k.tag == "p" for k in kids)) or (not is_preserved(n) and is_wrapper(n)):
                    n.unwrap()
                    changed = True
        if not changed:
            return


def strip_attributes(root: Node, debug: bool = False) -> None:
    for n in [root, *root.elements()]:
        if n.tag == "svg" or n.ns == "svg":
            continue
        for k, v in list(n.attrs.items()):
            name = k.lower()
            if name == "id" and (v.startswith(("fnref:", "fn:")) or v == "footnotes"):
                continue
            if name == "class" and ((n.tag == "code" and v.startswith("language-")) or v == "footnote-backref"):
                continue
            if name not in C.ALLOWED_ATTRIBUTES and not (debug and (name in ("class", "id") or name.startswith("data-"))):
                del n.attrs[k]


def _is_empty(n: Node) -> bool:
    if n.tag in C.ALLOWED_EMPTY_TAGS:
        return False
    kids = n.kids()
    if n.tag == "div" and kids and all(k.tag == "span" and k.text().strip() in ("", ",") for k in kids):
        return True
    return all(c.kind == "text" and not c.data.strip() and "\xa0" not in c.data for c in n.children)


def remove_empty(root: Node) -> None:
    while True:
        empty = [n for n in root.elements() if _is_empty(n)]
        for n in empty:
            n.detach()
        if not empty:
            return


def remove_trailing_headings(root: Node) -> None:
    """Headings after which no sibling has text, in order."""
    for h in root.find("h1", "h2", "h3", "h4", "h5", "h6"):
        if not any(s.text().strip() for s in h.parent.children[h.index() + 1 :] if s.kind == "element"):
            h.detach()


def remove_extra_breaks(root: Node) -> None:
    extra, run = [], 0
    for br in root.find("br"):
        after = next((s for s in br.parent.children[br.index() + 1 :] if s.kind == "element"), None)
        if after is not None and after.tag == "br":
            run += 1
            if run >= 2:
                extra.append(br)
        else:
            run = 0
    for br in extra:
        br.detach()


def _outside_code(root: Node) -> list[Node]:
    """The nodes from root on, parents first, without what is in pre and code. By a list, as pages may be nested very deeply."""
    todo, out = [root], []
    while todo:
        n = todo.pop()
        if n.kind != "element" or n.tag not in ("pre", "code"):
            out.append(n)
            todo.extend(reversed(n.children))
    return out


def _clean_texts(root: Node) -> None:
    for n in _outside_code(root):
        if n.kind == "text":
            if _BLANK.match(n.data):
                if n.parent is not None:
                    n.detach()
            else:
                n.data = normalized_text(n.data)


def _content(n: Node) -> str:
    return n.data if n.kind == "text" else n.text() if n.kind == "element" else ""


def _clean_edges(root: Node) -> None:
    for n in reversed(_outside_code(root)):
        if n.kind == "element":
            _clean_edges_of(n)


def _clean_edges_of(n: Node) -> None:
    edge = _BLOCK_EDGE if n.tag in C.BLOCK_TAGS or n.tag in C.MORE_BLOCK_TAGS else _INLINE_EDGE
    for at in (0, -1):
        while n.children and n.children[at].kind == "text" and edge.match(n.children[at].data):
            n.children[at].detach()
    inline = lambda x: x.kind == "text" or (x.kind == "element" and x.tag in C.INLINE_TAGS)
    children = list(n.children)
    for a, b in zip(children, children[1:]):
        if inline(a) and inline(b) and "element" in (a.kind, b.kind):
            spaced = (a.kind == "text" and a.data.endswith(" ")) or (b.kind == "text" and b.data.startswith(" "))
            if not (spaced or _STARTS.match(_content(b)) or _ENDS.search(_content(a))):
                n.insert(b.index(), text_node(" "))


def clean_lines(root: Node) -> None:
    _clean_texts(root)
    _clean_edges(root)


def standardize(root: Node, title: str, debug: bool = False) -> None:
    """All of it, in order. debug keeps wrappers, empty elements, classes, ids and data attributes."""
    spaces(root)
    headings(root, title)
    footnotes(root)
    roles(root)
    if debug:
        strip_attributes(root, True)
        remove_trailing_headings(root)
        remove_extra_breaks(root)
        return
    flatten(root)
    strip_attributes(root)
    remove_empty(root)
    remove_trailing_headings(root)
    flatten(root)
    remove_extra_breaks(root)
    clean_lines(root)


def count_words(html: str) -> int:
    """Words of the text of a piece of HTML, in which nothing stands between elements."""
    return len("".join(n.text() if n.kind != "text" else n.data for n in fragment(html)).split())
