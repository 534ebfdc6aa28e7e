"""HTML text to a tree of nodes and back, after the HTML standard's tree construction, without a library.

Covered: implied html, head, body, tbody and tr; implied end tags; void and raw-text elements; re-opened formatting elements and
misnested ones (adoption agency); content put into tables by mistake goes before them; svg and math. Scripting counts as on, so noscript
holds raw text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript plaintext".split())
RCDATA = frozenset(("title", "textarea"))
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Their start tags close an open paragraph.
CLOSES_P = HEADINGS | frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr listing main menu nav ol p pre search section summary table ul xmp li dd dt plaintext".split()
)
IN_HEAD = frozenset("base basefont bgsound link meta noframes script style template title".split())
SCOPE = frozenset("applet caption html table td th marquee object template foreignObject desc".split())
SPECIAL = CLOSES_P | SCOPE | IN_HEAD | frozenset("area body br button col colgroup embed frame frameset head iframe img input keygen noembed noscript param select source tbody textarea tfoot thead tr track wbr".split())
TABLE_PARTS = frozenset("caption colgroup col tbody tfoot thead tr td th".split())
IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
#: SVG attributes whose names have capitals.
SVG_CASE = {x.lower(): x for x in "attributeName attributeType baseProfile clipPathUnits gradientTransform gradientUnits markerHeight markerWidth pathLength patternTransform patternUnits preserveAspectRatio refX refY spreadMethod startOffset stdDeviation textLength viewBox".split()}

_TAG = re.compile(r"<(?:!--(.*?)(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|!([^>]*)>|\?([^>]*)>|/([^a-zA-Z>][^>]*)>|/>)", re.S)
_ATTR = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_REF = re.compile(r"&(?:#[xX]?[0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;|[a-zA-Z][a-zA-Z0-9]*(?![a-zA-Z0-9=]))")
_SPACE = " \t\n\f\r"


class Node:
    __slots__ = ("kind", "tag", "ns", "attrs", "children", "parent", "data")

    def __init__(self, kind: str, tag: str = "", attrs: dict[str, str] | None = None, data: str = "", ns: str = "") -> None:
        self.kind, self.tag, self.ns, self.data = kind, tag, ns, data
        self.attrs: dict[str, str] = attrs if attrs is not None else {}
        self.children: list[Node] = []
        self.parent: Node | None = None

    # Structure

    def append(self, child: Node) -> Node:
        child.detach()
        child.parent = self
        self.children.append(child)
        return child

    def insert(self, at: int, child: Node) -> Node:
        child.detach()
        child.parent = self
        self.children.insert(at, child)
        return child

    def index(self) -> int:
        return next(i for i, c in enumerate(self.parent.children) if c is self)

    def detach(self) -> None:
        if self.parent is not None:
            del self.parent.children[self.index()]
            self.parent = None

    def replace(self, nodes: list[Node]) -> None:
        """These nodes stand where this one stood."""
        parent, at = self.parent, self.index()
        self.detach()
        for i, n in enumerate(nodes):
            parent.insert(at + i, n)

    def unwrap(self) -> None:
        self.replace(list(self.children))

    def take_children(self, other: Node) -> None:
        for c in list(other.children):
            self.append(c)

    # Reading

    @property
    def is_element(self) -> bool:
        return self.kind == "element"

    def get(self, name: str, default: str = "") -> str:
        return self.attrs.get(name, default)

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in document order."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            if n.children:
                stack.extend(reversed(n.children))

    def elements(self) -> list[Node]:
        """The elements below this node, in document order."""
        out, stack = [], self.children[::-1]
        while stack:
            n = stack.pop()
            if n.kind == "element":
                out.append(n)
            if n.children:
                stack.extend(reversed(n.children))
        return out

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.elements() if n.tag in tags]

    def kids(self) -> list[Node]:
        return [c for c in self.children if c.kind == "element"]

    def ancestors(self) -> Iterator[Node]:
        n = self.parent
        while n is not None and n.kind == "element":
            yield n
            n = n.parent

    def text(self) -> str:
        if not self.children:
            return self.data if self.kind == "text" else ""
        out, stack = [], self.children[::-1]
        while stack:
            n = stack.pop()
            if n.kind == "text":
                out.append(n.data)
            if n.children:
                stack.extend(reversed(n.children))
        return "".join(out)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def copy(self) -> Node:
        alone = lambda n: Node(n.kind, n.tag, dict(n.attrs), n.data, n.ns)
        out = alone(self)
        todo = [(self, out)]
        while todo:
            old, new = todo.pop()
            for c in old.children:
                d = alone(c)
                d.parent = new
                new.children.append(d)
                if c.children:
                    todo.append((c, d))
        return out

    def inner_html(self) -> str:
        out: list[str] = []
        raw = self.tag in RAW
        for c in self.children:
            _write(c, out, raw)
        return "".join(out)

    def outer_html(self) -> str:
        out: list[str] = []
        _write(self, out, False)
        return "".join(out)

    def set_inner(self, html: str) -> None:
        for c in list(self.children):
            c.detach()
        for c in fragment(html):
            self.append(c)


def element(tag: str, attrs: dict[str, str] | None = None, *children: Node | str) -> Node:
    out = Node("element", tag, attrs)
    for c in children:
        out.append(text_node(c) if isinstance(c, str) else c)
    return out


def text_node(data: str) -> Node:
    return Node("text", data=data)


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("'", "&#39;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&#34;").replace("\r", "&#13;")


def _write(n: Node, out: list[str], raw: bool) -> None:
    """By a list, as pages may be nested very deeply; what waits is a node, with whether its text is raw, or an end tag."""
    todo: list[tuple[Node, bool] | str] = [(n, raw)]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        n, raw = x
        if n.kind == "text":
            out.append(n.data if raw else escape(n.data))
        elif n.kind == "element":
            out.append(f"<{n.tag}")
            for k, v in n.attrs.items():
                out.append(f' {k}="{escape(v)}"')
            if n.tag in VOID and not n.ns:
                out.append("/>")
                continue
            out.append(">")
            todo.append(f"</{n.tag}>")
            inner = n.tag in RAW
            todo.extend([(c, inner) for c in reversed(n.children)])
        elif n.kind == "comment":
            out.append(f"<!--{n.data}-->")
        elif n.kind == "doctype":
            out.append(f"<!DOCTYPE {n.data}>")
        else:
            todo.extend([(c, False) for c in reversed(n.children)])


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        name = m[1].lower()
        if name not in found:
            v = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
            found[name] = _REF.sub(lambda r: unescape(r[0]), v) if "&" in v else v
    return found


class _Builder:
    def __init__(self, context: str | None = None) -> None:
        self.document = Node("document")
        self.html: Node | None = None
        self.head: Node | None = None
        self.body: Node | None = None
        self.open: list[Node] = []
        self.formatting: list[Node | None] = []
        self.head_done = False
        self.context = context
        if context:
            self.html = self.body = self.document.append(Node("element", context))
            self.head_done = True
            self.open = [self.html]

    # Places

    @property
    def top(self) -> Node:
        return self.open[-1]

    def in_scope(self, tag: str, more: tuple[str, ...] = ()) -> bool:
        for n in reversed(self.open):
            if n.tag == tag and not n.ns:
                return True
            if n.tag in SCOPE or n.tag in more:
                return False
        return False

    def pop_to(self, tag: str) -> None:
        while self.open:
            if self.open.pop().tag == tag:
                return

    def implied_ends(self, but: str = "") -> None:
        while self.open and self.top.tag in IMPLIED_END and self.top.tag != but:
            self.open.pop()

    def close_p(self) -> None:
        if self.in_scope("p", ("button",)):
            self.implied_ends("p")
            self.pop_to("p")

    def need_html(self) -> None:
        if self.html is None:
            self.html = self.document.append(Node("element", "html"))
            self.open = [self.html]

    def need_head(self) -> None:
        self.need_html()
        if self.head is None:
            self.head = self.html.append(Node("element", "head"))
            self.open = [self.html, self.head]

    def need_body(self) -> None:
        if self.body is None:
            self.need_head()
            self.head_done = True
            self.body = self.html.append(Node("element", "body"))
            self.open = [self.html, self.body]

    def put(self, node: Node, fostered: bool = False) -> Node:
        """Appends to the current node; what doesn't belong in a table goes before it."""
        if fostered and self.top.tag in ("table", "tbody", "tfoot", "thead", "tr"):
            table = next(n for n in reversed(self.open) if n.tag in ("table", "html", self.context))
            if table.tag == "table" and table.parent is not None:
                parent, at = table.parent, table.index()
                if node.kind == "text" and at and parent.children[at - 1].kind == "text":
                    parent.children[at - 1].data += node.data
                    return parent.children[at - 1]
                return parent.insert(at, node)
        top = self.top
        if node.kind == "text" and top.children and top.children[-1].kind == "text":
            top.children[-1].data += node.data
            return top.children[-1]
        node.parent = top
        top.children.append(node)
        return node

    def reconstruct(self) -> None:
        active = self.formatting
        if not active or active[-1] is None or active[-1] in self.open:
            return
        i = len(active) - 1
        while i > 0 and active[i - 1] is not None and active[i - 1] not in self.open:
            i -= 1
        for k in range(i, len(active)):
            n = self.put(Node("element", active[k].tag, dict(active[k].attrs)), True)
            self.open.append(n)
            active[k] = n

    def adopt(self, tag: str) -> None:
        """The end tag of a formatting element (adoption agency)."""
        if self.top.tag == tag and self.top not in self.formatting:
            self.open.pop()
            return
        for _ in range(8):
            found = None
            for n in reversed(self.formatting):
                if n is None:
                    break
                if n.tag == tag:
                    found = n
                    break
            if found is None:
                self.any_end(tag)
                return
            if found not in self.open:
                self.formatting.remove(found)
                return
            if not self.in_scope(tag):
                return
            at = self.open.index(found)
            furthest = next((n for n in self.open[at + 1 :] if n.tag in SPECIAL and not n.ns), None)
            if furthest is None:
                del self.open[at:]
                self.formatting.remove(found)
                return
            ancestor = self.open[at - 1]
            bookmark = self.formatting.index(found)
            last, i = furthest, self.open.index(furthest)
            step = 0
            while True:
                step += 1
                i -= 1
                node = self.open[i]
                if node is found:
                    break
                if step > 3 and node in self.formatting:
                    bookmark -= self.formatting.index(node) < bookmark
                    self.formatting.remove(node)
                if node not in self.formatting:
                    self.open.remove(node)
                    continue
                new = Node("element", node.tag, dict(node.attrs))
                self.formatting[self.formatting.index(node)] = new
                self.open[i] = new
                if last is furthest:
                    bookmark = self.formatting.index(new) + 1
                new.append(last)
                last = new
            if ancestor.tag in ("table", "tbody", "tfoot", "thead", "tr") and (table := next((n for n in reversed(self.open) if n.tag == "table"), None)) is not None and table.parent is not None:
                last.detach()
                table.parent.insert(table.index(), last)
            else:
                ancestor.append(last)
            new = Node("element", found.tag, dict(found.attrs))
            new.take_children(furthest)
            furthest.append(new)
            where = self.formatting.index(found)
            self.formatting.remove(found)
            self.formatting.insert(bookmark - (where < bookmark), new)
            self.open.remove(found)
            self.open.insert(self.open.index(furthest) + 1, new)

    def any_end(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            n = self.open[i]
            if n.tag == tag:
                self.implied_ends(tag)
                del self.open[i:]
                return
            if n.tag in SPECIAL and not n.ns:
                return

    def clear_formatting(self) -> None:
        while self.formatting and self.formatting.pop() is not None:
            pass

    # Tokens

    def text(self, data: str) -> None:
        if self.body is None:
            lead = len(data) - len(data.lstrip(_SPACE))
            if self.html is not None and self.head is not None and lead and (self.head_done or self.top is self.head):
                (self.head if not self.head_done else self.html).append(text_node(data[:lead]))
            data = data[lead:]
            if not data:
                return
            self.need_body()
        if self.top.ns:
            self.put(text_node(data))
            return
        if self.top.tag in ("table", "tbody", "tfoot", "thead", "tr", "colgroup"):
            if not data.strip(_SPACE):
                self.put(text_node(data))
                return
        self.reconstruct()
        self.put(text_node(data), True)

    def comment(self, data: str) -> None:
        node = Node("comment", data=data)
        if self.open:
            self.put(node)
        else:
            self.document.append(node)

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> str:
        """Returns the tag whose raw text follows, or ''."""
        if tag == "html":
            self.need_html()
            for k, v in attrs.items():
                self.html.attrs.setdefault(k, v)
            return ""
        if tag == "head":
            if self.head is None:
                self.need_html()
                self.head = self.html.append(Node("element", "head", attrs))
                self.open = [self.html, self.head]
            return ""
        if tag == "body":
            if self.body is None:
                self.need_head()
                self.head_done = True
                self.body = self.html.append(Node("element", "body", attrs))
                self.open = [self.html, self.body]
            else:
                for k, v in attrs.items():
                    self.body.attrs.setdefault(k, v)
            return ""
        if self.body is None and (tag in IN_HEAD or tag == "noscript"):
            self.need_head()
            node = self.head.append(Node("element", tag, attrs))
            if tag in VOID:
                return ""
            if tag in RAW or tag in RCDATA:
                self.open.append(node)
                return tag
            self.open.append(node)
            return ""
        if not (self.body is None and self.open and any(n.tag == "template" for n in self.open)):
            self.need_body()
        foreign = self.top.ns
        if foreign and not (self.top.tag in ("foreignobject", "desc", "title", "mtext", "mi", "mo", "mn", "ms", "annotation-xml")):
            if tag in CLOSES_P or tag in ("b", "big", "body", "br", "code", "em", "embed", "head", "i", "img", "s", "small", "span", "strong", "strike", "sub", "sup", "tt", "u", "var"):
                while self.top.ns:
                    self.open.pop()
            else:
                if foreign == "svg":
                    attrs = {SVG_CASE.get(k, k): v for k, v in attrs.items()}
                node = self.put(Node("element", tag, attrs, ns=foreign))
                if not closed:
                    self.open.append(node)
                return ""
        if tag in ("svg", "math"):
            self.reconstruct()
            if tag == "svg":
                attrs = {SVG_CASE.get(k, k): v for k, v in attrs.items()}
            node = self.put(Node("element", tag, attrs, ns=tag), True)
            if not closed:
                self.open.append(node)
            return ""
        if tag in TABLE_PARTS:
            return self.table_part(tag, attrs)
        fostered = self.top.tag in ("table", "tbody", "tfoot", "thead", "tr") and tag not in ("script", "style", "template")
        if tag in CLOSES_P:
            self.close_p()
            if tag in HEADINGS and self.top.tag in HEADINGS:
                self.open.pop()
            if tag in ("li", "dd", "dt"):
                same = ("li",) if tag == "li" else ("dd", "dt")
                for i in range(len(self.open) - 1, 0, -1):
                    n = self.open[i]
                    if n.tag in same:
                        del self.open[i:]
                        break
                    if n.tag in SPECIAL and n.tag not in ("address", "div", "p"):
                        break
                self.close_p()
        elif tag in ("option", "optgroup"):
            if self.top.tag == "option":
                self.open.pop()
            if tag == "optgroup" and self.top.tag == "optgroup":
                self.open.pop()
            self.reconstruct()
        elif tag == "button":
            if self.in_scope("button"):
                self.implied_ends()
                self.pop_to("button")
            self.reconstruct()
        elif tag in ("a", "nobr"):
            old = None
            for n in reversed(self.formatting):
                if n is None:
                    break
                if n.tag == tag:
                    old = n
                    break
            if old is not None:
                self.adopt(tag)
                if old in self.formatting:
                    self.formatting.remove(old)
                if old in self.open:
                    self.open.remove(old)
            self.reconstruct()
        elif tag not in IN_HEAD:
            self.reconstruct()
        if tag == "image":
            tag = "img"
        node = self.put(Node("element", tag, attrs), fostered)
        if tag in VOID:
            return ""
        self.open.append(node)
        if tag in FORMATTING:
            alike = [n for n in self._since_marker() if n.tag == tag and n.attrs == attrs]
            if len(alike) >= 3:
                self.formatting.remove(alike[0])
            self.formatting.append(node)
        elif tag in ("applet", "marquee", "object"):
            self.formatting.append(None)
        return tag if tag in RAW or tag in RCDATA else ""

    def _since_marker(self) -> list[Node]:
        out: list[Node] = []
        for n in reversed(self.formatting):
            if n is None:
                break
            out.insert(0, n)
        return out

    def table_part(self, tag: str, attrs: dict[str, str]) -> str:
        if not self.in_scope_table():
            return ""
        while self.top.tag not in ("table", "tbody", "tfoot", "thead", "tr", "html", "colgroup"):
            popped = self.open.pop()
            if popped.tag in ("td", "th", "caption"):
                self.clear_formatting()
        if self.top.tag == "colgroup" and tag != "col":
            self.open.pop()
        if tag in ("caption", "colgroup", "tbody", "tfoot", "thead"):
            while self.top.tag not in ("table", "html"):
                self.open.pop()
        elif tag == "col":
            if self.top.tag != "colgroup":
                while self.top.tag not in ("table", "html"):
                    self.open.pop()
                self.open.append(self.put(Node("element", "colgroup")))
        else:
            if self.top.tag == "tr" and tag == "tr":
                self.open.pop()
            if self.top.tag == "table":
                self.open.append(self.put(Node("element", "tbody")))
            if tag != "tr" and self.top.tag != "tr":
                self.open.append(self.put(Node("element", "tr")))
        node = self.put(Node("element", tag, attrs))
        if tag != "col":
            self.open.append(node)
        if tag in ("td", "th", "caption"):
            self.formatting.append(None)
        return ""

    def in_scope_table(self) -> bool:
        for n in reversed(self.open):
            if n.tag == "table":
                return True
            if n.tag in ("html", "template"):
                return False
        return False

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {}, False)
            return
        if tag == "p":
            self.need_body()
            if not self.in_scope("p", ("button",)):
                self.put(Node("element", "p"))
            else:
                self.close_p()
            return
        if not self.open:
            return
        if tag in ("html", "body"):
            return
        if tag == "head":
            if self.body is None and self.head is not None:
                self.head_done = True
                self.open = [self.html]
            return
        if self.top.ns:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == tag:
                    del self.open[i:]
                    return
                if not self.open[i].ns:
                    break
        if tag in FORMATTING:
            if self.body is not None:
                self.adopt(tag)
        elif tag in HEADINGS:
            if any(self.in_scope(h) for h in HEADINGS):
                self.implied_ends()
                while self.open.pop().tag not in HEADINGS:
                    pass
        elif tag in TABLE_PARTS or tag == "table":
            if any(n.tag == tag for n in self.open) and self.in_scope_table():
                while self.open:
                    n = self.open.pop()
                    if n.tag in ("td", "th", "caption"):
                        self.clear_formatting()
                    if n.tag == tag:
                        break
        elif tag in CLOSES_P or tag in ("button", "template"):
            more = ("ol", "ul") if tag == "li" else ()
            if self.in_scope(tag, more):
                self.implied_ends(tag)
                self.pop_to(tag)
        elif tag in ("applet", "marquee", "object"):
            if self.in_scope(tag):
                self.implied_ends()
                self.pop_to(tag)
                self.clear_formatting()
        else:
            self.any_end(tag)


def _feed(b: _Builder, html: str) -> None:
    at, size = 0, len(html)
    find = _TAG.search
    while at < size:
        m = find(html, at)
        if m is None:
            b.text(_decoded(html[at:]))
            return
        if m.start() > at:
            b.text(_decoded(html[at : m.start()]))
        at = m.end()
        if m[3] is not None:
            tag = m[3].lower()
            if m[2]:
                b.end(tag)
                continue
            raw = m[4]
            closed = raw.endswith("/")
            follows = b.start(tag, _attributes(raw) if raw and not raw.isspace() else {}, closed)
            if follows:
                # Raw text goes on to its own end tag.
                close = re.compile(rf"</{follows}(?=[\s/>])", re.I).search(html, at)
                stop = close.start() if close else size
                data = html[at:stop]
                if follows in RCDATA:
                    data = _decoded(data)
                    if follows == "textarea" and data.startswith("\n"):
                        data = data[1:]
                node = b.open.pop()
                if data:
                    node.append(text_node(data))
                at = stop
                if close:
                    end = html.find(">", close.end())
                    at = size if end < 0 else end + 1
            elif tag in ("pre", "listing") and html.startswith("\n", at):
                at += 1
        elif m[1] is not None:
            b.comment(m[1])
        elif m[5] is not None:
            words = m[5].split()
            if words and words[0].lower() == "doctype":
                if b.html is None:
                    b.document.append(Node("doctype", data=" ".join(words[1:2]).lower()))
            elif m[5].startswith("[CDATA[") and b.open and b.top.ns:
                b.text(m[5][7:].removesuffix("]]"))
            else:
                b.comment(m[5])
        elif m[6] is not None or m[7] is not None:
            b.comment("?" + m[6] if m[6] is not None else m[7])


def _decoded(text: str) -> str:
    if "\0" in text:
        text = text.replace("\0", "")
    return unescape(text) if "&" in text else text


def parse(html: str | None) -> Node:
    """The document: doctype, comments and html with head and body."""
    b = _Builder()
    _feed(b, (html or "").replace("\r\n", "\n").replace("\r", "\n"))
    b.need_body()
    return b.document


def fragment(html: str, context: str = "div") -> list[Node]:
    """The nodes of a piece of HTML as the content of a `context` element."""
    b = _Builder(context)
    _feed(b, html)
    out = list(b.html.children)
    for n in out:
        n.parent = None
    return out


def body_of(document: Node) -> Node:
    return next(n for n in document.walk() if n.tag == "body")
