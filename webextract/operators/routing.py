"""Which site extractor a page goes to: the first whose patterns match its URL."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from webextract.operators.metadata import _host

#: In this order. A plain pattern matches a host that equals, ends with or contains it; one with a caret-free "re:" prefix is searched for
#: in the whole URL.
BUILTIN: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("twitter", ("twitter.com", "x.com", r"re:twitter\.com/.*/status/.*", r"re:x\.com/.*/status/.*")),
    ("youtube", ("youtube.com", "youtu.be", r"re:youtube\.com/watch\?v=.*", r"re:youtu\.be/.*")),
    ("reddit", ("reddit.com", "old.reddit.com", "new.reddit.com", r"re:reddit\.com/r/.*/comments/.*")),
    ("hackernews", (r"re:news\.ycombinator\.com/item\?id=.*",)),
    ("chatgpt", (r"re:^https?://chatgpt\.com/(c|share)/.*",)),
    ("claude", (r"re:^https?://claude\.ai/(chat|share)/.*",)),
    ("grok", ("grok.x.ai", "x.ai", r"re:^https?://grok\.x\.ai.*", r"re:^https?://x\.ai.*", r"re:^https?://grok\.com/(chat|share)(/.*)?$")),
    ("gemini", ("gemini.google.com", r"re:^https?://gemini\.google\.com/app/.*")),
    ("github", ("github.com", r"re:^https?://github\.com/.*")),
)


def route(url: str, rules: tuple = BUILTIN) -> str | None:
    """The name of the first rule that matches. Each URL is judged by itself."""
    try:
        host = _host(url) if "://" in url else ""
    except ValueError:
        return None
    if not host:
        return None
    for name, patterns in rules:
        for p in patterns:
            if (re.search(p[3:], url) if p.startswith("re:") else p in host):
                return name
    return None


def route_column(url: Column, rules: tuple = BUILTIN) -> Column:
    """The same as an expression; null where no rule matches."""
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    out = F.lit(None).cast("string")
    for name, patterns in reversed(rules):
        hit = F.lit(False)
        for p in patterns:
            hit = hit | (F.regexp_like(url, F.lit(p[3:])) if p.startswith("re:") else host.contains(p))
        out = F.when((host != "") & hit, F.lit(name)).otherwise(out)
    return out
