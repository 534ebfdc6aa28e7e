"""Element processors: code, images, headings, math, footnotes and ARIA roles. Each rewrites a whole document; extract() runs none."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webextract.css import closest, first, matcher, select
from webextract.htmltree import Node, body_of, element, parse, text_node

# Code

CODE_BLOCKS = 'pre, div[class*="prismjs"], .syntaxhighlighter, .highlight, .highlight-source, .wp-block-syntaxhighlighter-code, .wp-block-code, div[class*="language-"]'
# Fixed values.
CODE_LANGUAGES = frozenset(
    (
        "abap actionscript ada adoc agda antlr4 applescript arduino armasm asciidoc aspnet atom bash batch c clojure cmake cobol coffeescript cpp c++ crystal csharp cs dart django dockerfile dotnet elixir elm "
        "erlang fortran fsharp gdscript gitignore glsl golang go gradle graphql groovy haskell hs haxe hlsl html idris java javascript js jsx jsdoc json jsonp julia kotlin latex lisp elisp livescript lua makefile "
        "markdown md markup masm mathml matlab mongodb mysql nasm nginx nim nix objc ocaml pascal perl php postgresql powershell prolog puppet python regex rss ruby rb rust scala scheme shell sh solidity sparql sql "
        "ssml svg swift tcl terraform tex toml typescript ts tsx unrealscript verilog vhdl webassembly wasm xml yaml yml zig"
    ).split()
)
# How highlighters name a language in a class.
LANGUAGE_PATTERNS = tuple(
    map(re.compile, (r"^language-(\w+)$", r"^lang-(\w+)$", r"^(\w+)-code$", r"^code-(\w+)$", r"^syntax-(\w+)$", r"^code-snippet__(\w+)$", r"^highlight-(\w+)$", r"^(\w+)-snippet$", r"(?:^|\s)(?:language|lang|brush|syntax)-(\w+)(?:\s|$)"))
)


def language_of(node: Node) -> str:
    """The language that one element's attributes and classes name, or ''."""
    for name in ("data-lang", "data-language"):
        if node.get(name):
            return node.get(name).lower()
    classes = [c.lower() for c in node.classes()]
    if "syntaxhighlighter" in classes:
        for c in classes:
            if c not in ("syntaxhighlighter", "nogutter") and c in CODE_LANGUAGES:
                return c
    for pattern in LANGUAGE_PATTERNS:
        for c in (*classes, node.get("class").lower()):
            if (m := pattern.search(c)) and m[1] in CODE_LANGUAGES:
                return m[1]
    return next((c for c in classes if c in CODE_LANGUAGES), "")


def code_language(node: Node) -> str:
    """Of the element or its first code, or of the nearest ancestor so."""
    for n in (node, *node.ancestors()):
        inner = n.find("code")
        if found := language_of(n) or (language_of(inner[0]) if inner else ""):
            return found
    return ""


_GUTTER = re.compile("line-?number|gutter|lineno", re.I)


def code_text(node: Node) -> str:
    """Text of structured code: breaks and line elements end lines, gutters are left out."""
    if lines := select(node, ".code .container > *") or select(node, ".code .line"):
        rows = []
        for line in lines:
            parts = [c for c in line.kids() if c.tag == "code"]
            rows.append("".join(" " * len(c.text()) if "spaces" in c.classes() else c.text() for c in parts) if parts else line.text())
        return "\n".join(rows)
    out: list[str] = []

    def visit(n: Node) -> None:
        if n.kind == "text":
            out.append(n.data)
        elif n.kind == "element":
            if n.tag == "br":
                out.append("\n")
            elif not _GUTTER.search(n.get("class")):
                for c in n.children:
                    visit(c)
                if n is not node and (n.tag in ("div", "p", "li", "tr") or "line" in n.classes()) and out and not out[-1].endswith("\n"):
                    out.append("\n")

    visit(node)
    return "".join(out)


def normal_code(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", text.strip().replace("\t", "    ").replace("\xa0", " "))


def process_code(root: Node) -> None:
    for n in select(root, CODE_BLOCKS):
        if n.parent is None or not _under(n, root):
            continue
        language, text = code_language(n), normal_code(code_text(n))
        attrs = {"data-lang": language, "class": f"language-{language}"} if language else {}
        n.replace([element("pre", None, element("code", attrs, text))])


def _under(n: Node, root: Node) -> bool:
    while n is not None and n is not root:
        n = n.parent
    return n is root


# Images

TRACKING = re.compile(r"pixel\.gif|1x1\.gif|tracking\.gif|analytics|metrics|beacon")
DECORATIVE = ("icon", "avatar", "emoji", "bullet", "decoration", "logo-small")
GENERIC_ALT = ("image", "picture", "photo", "screenshot", "icon", "logo", "banner", "graphic")
_GENERIC_FILE = re.compile(r"^(?:image\d*|img\d*|picture\d*|photo\d*|screenshot\d*|\d+|untitled\d*)\.(?:jpg|jpeg|png|gif|webp)$")
EAGER, SMALLEST, LARGE, THIN = 3, 50, 800, 300


def _size(n: Node, name: str) -> int:
    return int(n.get(name)) if n.get(name).isdigit() else 0


def is_tracking(src: str) -> bool:
    return bool(TRACKING.search(src.lower()))


def is_decorative(n: Node) -> bool:
    small = any(0 < _size(n, k) < SMALLEST for k in ("width", "height"))
    return small or any(w in n.get("class").lower() for w in DECORATIVE) or is_tracking(n.get("src"))


def is_generic(alt: str) -> bool:
    return len(alt) < 3 or any(w in alt.lower() for w in GENERIC_ALT)


def alt_from_file(src: str) -> str:
    name = src.split("?")[0].rsplit("/", 1)[-1]
    if not name or _GENERIC_FILE.match(name.lower()):
        return ""
    words = re.sub(r"([a-z])([A-Z])", r"\1 \2", re.sub(r"[-_]", " ", re.sub(r"\.[^.]*$", "", name))).strip()
    return words[:1].upper() + words[1:]


def better_alt(n: Node) -> str:
    """The alternative text, or if that says nothing: title, caption, what is around, file name."""
    alt = n.get("alt").strip()
    if alt and not is_generic(alt):
        return alt
    if len(n.get("title")) > 3:
        return n.get("title")
    figure = closest(n, "figure")
    caption = first(figure, "figcaption") if figure is not None else None
    if caption is not None and caption.text().strip():
        return caption.text().strip()
    for a in n.ancestors():
        if a.tag in ("section", "article", "div") and (h := next((k for k in a.kids() if k.tag in ("h1", "h2", "h3", "h4", "h5", "h6")), None)) is not None and h.text().strip():
            return h.text().strip()
    link = closest(n, "a")
    if link is not None and link.text().strip():
        return link.text().strip()
    if n.get("aria-label"):
        return n.get("aria-label")
    for a in n.ancestors():
        text = a.text().strip()
        if 10 < len(text) < 100 and len(a.kids()) <= 2:
            return text
    return alt_from_file(n.get("src")) or alt


def process_images(root: Node) -> None:
    images = root.find("img")
    early = set(map(id, images[:EAGER]))
    for n in images:
        if not n.get("src"):
            if not n.get("data-src"):
                continue
            n.attrs["src"] = n.get("data-src")
        important = is_important(n, id(n) in early)
        if is_decorative(n):
            n.detach()
            continue
        if n.get("data-srcset"):
            n.attrs["srcset"] = n.get("data-srcset")
        for k in ("data-src", "data-srcset", "data-lazy"):
            n.attrs.pop(k, None)
        classes = [c for c in n.classes() if c not in ("lazy", "lazyload")]
        n.attrs["alt"] = better_alt(n)
        eager = id(n) in early
        n.attrs |= {"loading": "eager" if eager else "lazy", "decoding": "async"} | ({} if eager else {"data-lazy": "true"}) | ({"fetchpriority": "high"} if important else {})
        n.attrs |= {"class": " ".join([*classes, "responsive-image"]), "style": "max-width: 100%; height: auto;", "sizes": n.get("sizes") or "(max-width: 768px) 100vw, 50vw"}
    for i, figure in enumerate(root.find("figure"), 1):
        image, caption = first(figure, "img"), first(figure, "figcaption")
        if caption is not None and not caption.text().strip():
            caption.detach()
            caption = None
        if image is None:
            continue
        image.attrs.setdefault("id", f"img-{i}")
        if caption is None and len(image.get("alt")) >= 10 and not is_generic(image.get("alt")):
            caption = figure.append(element("figcaption", None, image.get("alt")))
        if caption is not None and len(caption.text()) > 200:
            caption.attrs["class"] = " ".join([*caption.classes(), "long-caption"])
        width = _size(image, "width")
        figure.attrs["class"] = " ".join([*figure.classes(), "image-figure", *(["large-image"] if width > LARGE else ["small-image"] if 0 < width < THIN else [])])
    for source in select(root, "picture source[srcset]"):
        source.attrs["srcset"] = source.get("srcset").strip()
    for n in root.find("img"):
        if any(0 < _size(n, k) < SMALLEST for k in ("width", "height")) and not is_important(n, False) and (is_tracking(n.get("src")) or is_decorative(n)):
            n.detach()


def is_important(n: Node, early: bool) -> bool:
    return early or closest(n, "figure.featured") is not None or (len(n.get("alt")) > 20 and not is_generic(n.get("alt"))) or closest(n, "article, main, .content, .post") is not None


# Headings

HEADING_CLUTTER = 'a[href*="#"], .anchor, button'


def _spoken(heading: Node) -> str:
    """The text of the first link or anchor put into a heading, in the order of the tree; buttons have none to give."""
    for n in heading.elements():
        text = ""
        if (n.tag == "a" and "#" in n.get("href")) or "anchor" in n.classes():
            text = n.text().strip()
        if n.tag in ("span", "div") and (link := first(n, 'a[href^="#"]')) is not None:
            text = link.text().strip()
        if text:
            return text
    return ""


def process_headings(root: Node) -> None:
    """Headings without the links and buttons put into them; if nothing else is left, the first link's text."""
    for h in root.find("h1", "h2", "h3", "h4", "h5", "h6"):
        spoken = _spoken(h)
        for n in select(h, HEADING_CLUTTER) + [n for n in h.find("span", "div") if first(n, 'a[href^="#"]') is not None]:
            if n.parent is not None:
                n.detach()
        text = h.text().strip() or spoken
        h.attrs = {k: v for k, v in h.attrs.items() if k in ("id", "class")}
        for c in list(h.children):
            c.detach()
        h.append(text_node(text))


# Math

MATH = 'math, .MathJax, .MathJax_Display, .MathJax_Preview, .katex, .katex-display, .katex-block, script[type^="math/"], script[type="application/x-tex"], script[type="text/latex"], [data-math], [data-latex], [data-katex], [data-mathjax]'
MATH_SCRIPTS = 'script[type^="math/"], script[type="application/x-tex"], script[type="text/latex"]'
_BLOCK_MATH = ("MathJax_Display", "katex-display", "katex-block")
_WRAPPERS = frozenset(("MathJax", "MathJax_Display", "katex", "katex-display", "katex-block"))


LATEX_PATTERN = r"\$.*\$|\\\w+|\{.*\}|\^|_"


def looks_like_latex(text: str) -> bool:
    return bool(re.search(LATEX_PATTERN, text))


def latex_of(n: Node) -> str:
    for name in ("data-latex", "data-tex"):
        if n.get(name):
            return n.get(name)
    own = [n] if matcher(MATH_SCRIPTS)(n) else []
    for s in [*own, *select(n, MATH_SCRIPTS), *select(n, 'annotation[encoding="application/x-tex"]')]:
        if s.text().strip():
            return s.text().strip()
    text = n.text().strip()
    return text if looks_like_latex(text) else ""


def is_block_math(n: Node) -> bool:
    math = n if n.tag == "math" else first(n, "math")
    if math is not None and "display" in math.attrs:
        return math.get("display") == "block"
    if any(c in n.classes() for c in _BLOCK_MATH):
        return True
    p = n.parent
    if p is None or p.kind != "element":
        return False
    style = p.get("style").lower()
    return (p.tag == "div" and "math-display" in p.classes()) or ("text-align" in style and "center" in style)


def process_math(root: Node) -> None:
    for n in select(root, MATH):
        if not _under(n, root) or "MathJax_Preview" in n.classes():
            continue
        if n.tag == "script" and n.parent is not None and _WRAPPERS.intersection(n.parent.classes()):
            continue
        if any(a.attrs.get("data-clean-math") for a in n.ancestors()):
            continue
        inner = n if n.tag == "math" else first(n, "math")
        latex = latex_of(n)
        if inner is None and not latex:
            continue
        display = "block" if is_block_math(n) else "inline"
        # Quotes and then ampersands are escaped, and the serializer escapes once more.
        attrs = {"xmlns": "http://www.w3.org/1998/Math/MathML", "display": display} | ({"data-latex": latex.replace('"', "&quot;").replace("&", "&amp;")} if latex else {})
        clean = element("math", attrs)
        if inner is not None:
            clean.take_children(inner)
        else:
            clean.append(text_node(latex))
        clean.attrs["data-clean-math"] = "1"
        parent = n.parent
        n.replace([clean])
        for s in select(parent, f"{MATH_SCRIPTS}, .MathJax_Preview, script[src*='mathjax'], script[src*='katex']"):
            s.detach()
    for n in select(root, "[data-clean-math]"):
        del n.attrs["data-clean-math"]


# Footnotes

LINKED_NOTES = "sup a[href^='#'], a.footnote, .footnote-ref, a[href^='#footnote'], a[href^='#fn']"
TEXT_NOTES = tuple(map(re.compile, (r"\[([0-9]+)\]", r"\(([0-9]+)\)", r"\*([0-9]+)", r"†([0-9]+)", r"\[([a-zA-Z]+)\]")))
NOTE_LISTS = "ol.references, ul.references, .footnotes ol, .footnotes ul"


def note_definition(root: Node, key: str) -> Node | None:
    for name in (f"footnote-{key}", f"fn-{key}", f"note-{key}", f"ref-{key}"):
        if (n := next((x for x in root.elements() if x.get("id") == name), None)) is not None:
            return n
    for name in ("data-footnote", "data-note"):
        if (n := next((x for x in root.elements() if x.get(name) == key), None)) is not None:
            return n
    for section in select(root, ".footnotes, .notes, .references, .endnotes"):
        for n in section.find("li", "div", "p"):
            if n.text().startswith((f"{key}.", f"[{key}]", f"{key})")):
                return n
    return None


def find_footnotes(root: Node) -> list[dict]:
    """id, ref_text, linked, definition text and the nodes, the first of each id: linked ones, ones in the text, and lists of references."""
    ids = {n.get("id"): n for n in reversed(root.elements()) if n.get("id")}
    found: list[dict] = []
    for n in select(root, LINKED_NOTES):
        key = n.get("href").removeprefix("#")
        found.append({"id": key, "ref_text": n.text().strip(), "linked": True, "reference": n, "definition": ids.get(key)})
    for n in root.elements():
        text = n.text()
        for pattern in TEXT_NOTES:
            for m in pattern.finditer(text):
                found.append({"id": m[1], "ref_text": m[0], "linked": False, "reference": n, "definition": note_definition(root, m[1])})
    for box in select(root, NOTE_LISTS):
        for li in select(box, "li[id]"):
            back = next((a for a in root.find("a") if a.get("href") == f"#{li.get('id')}"), None)
            found.append({"id": li.get("id"), "ref_text": back.text().strip() if back is not None else "", "linked": back is not None, "reference": back, "definition": li})
    out: dict[str, dict] = {}
    for f in found:
        if f["id"]:
            out.setdefault(f["id"], f)
    notes = list(out.values())
    for i, f in enumerate(notes, 1):
        f["number"], f["content"] = i, f["definition"].text().strip() if f["definition"] is not None else ""
    return notes


def process_footnotes(root: Node, section: bool = True) -> list[dict]:
    """Numbers the notes, links references and definitions to each other, and appends a section of those with content."""
    notes = find_footnotes(root)
    for f in notes:
        n, i = f["reference"], f["number"]
        if n is not None and f["linked"]:
            n.attrs |= {"id": f"fnref:{i}", "href": f"#fn:{i}", "role": "doc-noteref", "aria-describedby": f"fn:{i}"}
        if f["definition"] is not None:
            f["definition"].attrs |= {"id": f"fn:{i}", "role": "doc-endnote"}
    filled = [f for f in notes if f["content"]]
    if section and filled:
        items = [element("li", {"id": f"fn:{f['number']}"}, f["content"] + " ", element("a", {"href": f"#fnref:{f['number']}", "class": "footnote-backref"}, "↩")) for f in filled]
        root.append(element("div", {"class": "footnotes"}, element("h2", None, "Footnotes"), element("ol", None, *items)))
    return notes


# Roles


def _as(node: Node, tag: str) -> Node:
    new = Node("element", tag, {k: v for k, v in node.attrs.items() if k != "role"})
    node.replace([new])
    new.take_children(node)
    return new


def process_roles(root: Node) -> None:
    """role=paragraph, list, listitem, button and link become p, ul or ol, li, button and a."""
    for n in select(root, '[role="list"]'):
        labels = [label.text() for item in select(n, '[role="listitem"]') if (label := first(item, ".label")) is not None]
        for item in select(n, '[role="listitem"]'):
            for label in select(item, ".label"):
                label.detach()
            _as(item, "li")
        _as(n, "ol" if any(")" in t or "." in t for t in labels) else "ul")
    for role, tag in (("listitem", "li"), ("paragraph", "p"), ("button", "button"), ("link", "a")):
        for n in select(root, f'[role="{role}"]'):
            if n.tag != tag:
                _as(n, tag)
            else:
                n.attrs.pop("role")


# On tables of pages

PROCESSORS: dict[str, Callable[[Node], object]] = {"code": process_code, "images": process_images, "headings": process_headings, "math": process_math, "footnotes": process_footnotes, "roles": process_roles}


def process_pages(pages: DataFrame, which: str) -> DataFrame:
    """page_id, html to page_id, html: the body's HTML after one of the processors."""
    import pyarrow as pa

    run = PROCESSORS[which]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for html in part.column(1):
                body = body_of(parse(html.as_py()))
                run(body)
                out.append(body.inner_html())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], names=["page_id", "html"])

    source = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    return source.mapInArrow(batches, f"page_id {source.schema['page_id'].dataType.simpleString()}, html string")


