"""A subset of CSS selectors, matched on trees: type, #id, .class, attribute tests with the i flag, :not(), descendant and child, lists."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from webextract.htmltree import Node

_TOKEN = re.compile(
    r"\s*(?P<comma>,)\s*|\s*(?P<child>>)\s*|(?P<space>\s+)|(?P<star>\*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|(?P<tag>[a-zA-Z][\w-]*)"
    r"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*(?P<flag>[iIsS])?\s*)?\]"
    r"|:not\((?P<not>[^()]+)\)"
)


@dataclass(frozen=True)
class Test:
    """One condition on an element: its kind (tag, class, attr, not), a name, an operator and a value."""

    kind: str
    name: str = ""
    op: str = ""
    value: str = ""
    fold: bool = False
    inner: tuple = ()


#: A chain of (combinator to the left, tests of one element), from left to right.
Chain = tuple[tuple[str, tuple[Test, ...]], ...]


class BadSelector(ValueError):
    pass


@lru_cache(maxsize=4096)
def parse_selector(selector: str) -> tuple[Chain, ...]:
    chains: list[Chain] = []
    chain: list[tuple[str, tuple[Test, ...]]] = []
    tests: list[Test] = []
    combinator, at, text = "", 0, selector.strip()

    def close() -> None:
        nonlocal tests, combinator
        if not tests:
            raise BadSelector(selector)
        chain.append((combinator, tuple(tests)))
        tests, combinator = [], ""

    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise BadSelector(selector)
        at = m.end()
        if m["comma"]:
            close()
            chains.append(tuple(chain))
            chain = []
        elif m["child"] or m["space"]:
            close()
            combinator = ">" if m["child"] else " "
        elif m["star"]:
            tests.append(Test("any"))
        elif m["id"]:
            tests.append(Test("attr", "id", "=", m["id"]))
        elif m["cls"]:
            tests.append(Test("class", value=m["cls"]))
        elif m["tag"]:
            tests.append(Test("tag", value=m["tag"].lower()))
        elif m["attr"]:
            value = next((v for v in (m["dq"], m["sq"], m["bare"]) if v is not None), "")
            fold = (m["flag"] or "").lower() == "i"
            tests.append(Test("attr", m["attr"].lower(), m["op"] or "", value.lower() if fold else value, fold))
        else:
            tests.append(Test("not", inner=parse_selector(m["not"])))
    close()
    chains.append(tuple(chain))
    return tuple(chains)


def _holds(t: Test) -> Callable[[Node], bool]:
    """The test of an element that one part of a selector is."""
    name, op, value, fold = t.name, t.op, t.value, t.fold
    if t.kind == "tag":
        return lambda n: n.tag.lower() == value
    if t.kind == "class":
        return lambda n: "class" in n.attrs and value in n.attrs["class"] and value in n.attrs["class"].split()
    if t.kind == "not":
        inner = [_all(c[0][1]) for c in t.inner if len(c) == 1]
        return lambda n: not any(f(n) for f in inner)
    if t.kind != "attr":
        return lambda n: True
    if op == "":
        return lambda n: name in n.attrs
    if op == "=" and not fold:
        return lambda n: n.attrs.get(name) == value

    def attribute(n: Node) -> bool:
        v = n.attrs.get(name)
        if v is None:
            return False
        if fold:
            v = v.lower()
        if op == "=":
            return v == value
        if op == "~=":
            return value in v.split()
        if op == "|=":
            return v == value or v.startswith(value + "-")
        if not value:
            return False
        return v.startswith(value) if op == "^=" else v.endswith(value) if op == "$=" else value in v

    return attribute


def _all(tests: tuple[Test, ...]) -> Callable[[Node], bool]:
    found = [_holds(t) for t in tests]
    if len(found) == 1:
        return found[0]
    if len(found) == 2:
        x, y = found
        return lambda n: x(n) and y(n)
    return lambda n: all(f(n) for f in found)


def _chain(chain: Chain) -> Callable[[Node], bool]:
    own, how = _all(chain[-1][1]), chain[-1][0]
    if len(chain) == 1:
        return own
    rest = _chain(chain[:-1])
    if how == ">":
        return lambda n: own(n) and n.parent is not None and n.parent.kind == "element" and rest(n.parent)
    return lambda n: own(n) and any(rest(a) for a in n.ancestors())


@lru_cache(maxsize=4096)
def matcher(selector: str) -> Callable[[Node], bool]:
    """A test of elements. A selector that isn't valid matches nothing."""
    try:
        chains = parse_selector(selector)
    except BadSelector:
        return lambda n: False
    tests = [_chain(c) for c in chains]
    if len(tests) == 1:
        return tests[0]
    return lambda n: any(f(n) for f in tests)


def select(root: Node, selector: str) -> list[Node]:
    """Elements below root, in document order."""
    test = matcher(selector)
    return [n for n in root.elements() if test(n)]


def first(root: Node, selector: str) -> Node | None:
    test = matcher(selector)
    stack = root.children[::-1]
    while stack:
        n = stack.pop()
        if n.kind == "element" and test(n):
            return n
        if n.children:
            stack.extend(reversed(n.children))
    return None


def closest(node: Node, selector: str) -> Node | None:
    test = matcher(selector)
    if test(node):
        return node
    return next((a for a in node.ancestors() if test(a)), None)


class SelectorIndex:
    """Many selectors at once: an element is tested only against those that ask for its tag, one of its classes or one of its attributes."""

    def __init__(self, selectors: tuple[str, ...]) -> None:
        self.tests = [matcher(s) for s in selectors]
        self.by_tag: dict[str, list[int]] = {}
        self.by_class: dict[str, list[int]] = {}
        self.by_attribute: dict[str, list[int]] = {}
        self.others: list[int] = []
        for i, s in enumerate(selectors):
            try:
                chains = parse_selector(s)
            except BadSelector:
                continue
            for chain in chains:
                last = {t.kind: t for t in reversed(chain[-1][1])}
                if "class" in last:
                    self.by_class.setdefault(last["class"].value, []).append(i)
                elif "attr" in last:
                    self.by_attribute.setdefault(last["attr"].name, []).append(i)
                elif "tag" in last:
                    self.by_tag.setdefault(last["tag"].value, []).append(i)
                else:
                    self.others.append(i)

    def matches(self, n: Node) -> list[int]:
        """Places of the selectors that match, ascending."""
        maybe = [*self.by_tag.get(n.tag, ()), *self.others]
        for name, value in n.attrs.items():
            maybe += self.by_attribute.get(name, ())
            if name == "class":
                for c in value.split():
                    maybe += self.by_class.get(c, ())
        return sorted({i for i in maybe if self.tests[i](n)})

    def any(self, nodes: list[Node]) -> bool:
        return any(self.matches(n) for n in nodes)
