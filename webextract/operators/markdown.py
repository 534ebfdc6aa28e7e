"""HTML to Markdown (CommonMark)."""

from __future__ import annotations

import re

from webextract.htmltree import Node, element, fragment

_SKIPPED = frozenset("script style noscript template iframe head meta link button select textarea input".split())
_BLOCK = frozenset("p div section article main header footer nav aside h1 h2 h3 h4 h5 h6 ul ol li blockquote pre hr table thead tbody tr figure figcaption dl dt dd details summary address form".split())
_ESCAPED = re.compile(r"([\\*_`\[\]])")


def _inline(n: Node) -> str:
    if n.kind == "text":
        return _ESCAPED.sub(r"\\\1", re.sub(r"[ \t\n\f\r]+", " ", n.data))
    if n.kind != "element" or n.tag in _SKIPPED:
        return ""
    inner = "".join(map(_inline, n.children))
    if n.tag == "br":
        return "  \n"
    if n.tag == "img":
        title = f' "{n.get("title")}"' if n.get("title") else ""
        return f"![{n.get('alt')}]({n.get('src')}{title})" if n.get("src") else ""
    if n.tag == "code":
        text = n.text()
        ticks = "`" * (max([0, *map(len, re.findall("`+", text))]) + 1)
        return f"{ticks}{text}{ticks}" if text else ""
    core = inner.strip()
    if not core:
        return inner
    wrap = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~"}.get(n.tag)
    if n.tag == "a" and "href" in n.attrs:
        title = f' "{n.get("title")}"' if n.get("title") else ""
        core = f"[{core}]({n.get('href')}{title})"
    elif wrap:
        core = f"{wrap}{core}{wrap}"
    else:
        return inner
    return inner[: len(inner) - len(inner.lstrip())] + core + inner[len(inner.rstrip()) :]


def _indented(text: str, by: str) -> str:
    return "\n".join(by + line if line else line for line in text.split("\n"))


def _blocks(nodes: list[Node]) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = "".join(run).strip()
        run.clear()
        if text:
            out.append(re.sub(r"[ ]+\n(?! )", "  \n", text) if "  \n" in text else text)

    for n in nodes:
        if n.kind == "element" and n.tag in _SKIPPED:
            continue
        if n.kind != "element" or (n.tag not in _BLOCK and not any(d.tag in _BLOCK for d in n.elements())):
            run.append(_inline(n))
            continue
        flush()
        if n.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            if text := "".join(map(_inline, n.children)).strip():
                out.append("#" * int(n.tag[1]) + " " + re.sub(r"\s+", " ", text))
        elif n.tag in ("ul", "ol"):
            items, at = [], int(n.get("start")) if n.get("start").isdigit() else 1
            for li in n.kids():
                mark = f"{at}. " if n.tag == "ol" else "- "
                at += 1
                tight = not any(k.tag == "p" for k in li.kids())
                body = ("\n" if tight else "\n\n").join(_blocks(li.children if li.tag == "li" else [li]))
                items.append(mark + _indented(body, " " * len(mark)).lstrip())
            out.append("\n".join(items))
        elif n.tag == "blockquote":
            out.append("\n".join("> " + x if x else ">" for x in "\n\n".join(_blocks(n.children)).split("\n")))
        elif n.tag == "pre":
            code = n.find("code")
            names = (code[0] if code else n).classes()
            language = next((c.removeprefix("language-") for c in names if c.startswith("language-")), "")
            out.append(f"```{language}\n{n.text().rstrip(chr(10))}\n```")
        elif n.tag == "hr":
            out.append("* * *")
        else:
            out.extend(_blocks(n.children))
    flush()
    return out


def to_markdown(html: str) -> str:
    root = element("div")
    for n in fragment(html):
        root.append(n)
    text = "\n\n".join(_blocks(root.children)).strip()
    return text.replace("\n\n\n", "\n\n")
