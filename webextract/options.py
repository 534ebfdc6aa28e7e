"""Settings of an extraction, and how they are merged."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Options:
    """Options() has both selector passes on; Options.zero() has every flag off, so that a flag left out of a request counts as off.

    process_* flags and their options are carried along for the standalone element processors; extract() doesn't run these.
    partial_patterns: substrings of class, id and test attributes that mark clutter; None takes the built-in ones,
    constants.PARTIAL_PATTERNS; constants.patterns_from() reads a longer list from a file.
    mobile_styles: (selector, style text) pairs appended to the style of what they match.
    extractors: (name, patterns, function) of the caller's own, after the built-in ones.
    """

    url: str = ""
    debug: bool = False
    markdown: bool = False
    separate_markdown: bool = False
    remove_exact_selectors: bool = True
    remove_partial_selectors: bool = True
    remove_images: bool = False
    process_code: bool = False
    process_images: bool = False
    process_headings: bool = False
    process_math: bool = False
    process_footnotes: bool = False
    process_roles: bool = False
    code_options: dict[str, Any] | None = None
    image_options: dict[str, Any] | None = None
    heading_options: dict[str, Any] | None = None
    math_options: dict[str, Any] | None = None
    footnote_options: dict[str, Any] | None = None
    role_options: dict[str, Any] | None = None
    partial_patterns: tuple[str, ...] | None = None
    mobile_styles: tuple[tuple[str, str], ...] = ()
    extractors: tuple[tuple[str, tuple, Callable], ...] = ()
    max_html_chars: int | None = None

    @classmethod
    def zero(cls, **given: Any) -> Options:
        off = {f.name: False for f in fields(cls) if f.type == "bool"}
        return cls(**(off | given))


def merge_options(base: Options | None, override: Options | None = None) -> Options:
    """Defaults, then base, then override. Of each given one every flag overwrites, the url if it isn't empty, nested options if any."""
    out = Options()
    for given in (base, override):
        if given is None:
            continue
        changes: dict[str, Any] = {}
        for f in fields(Options):
            value = getattr(given, f.name)
            if f.type == "bool" or (f.name == "url" and value) or (f.name != "url" and value not in (None, ())):
                changes[f.name] = value
        out = replace(out, **changes)
    return out
