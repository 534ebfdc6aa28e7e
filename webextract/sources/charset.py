"""Decoding the bytes of a page."""

from __future__ import annotations

import codecs
import re

_META = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([a-zA-Z0-9_:.-]+)", re.I)
#: By the web's encoding standard these names mean windows-1252.
_LATIN = frozenset(("iso-8859-1", "iso8859-1", "latin1", "latin-1", "us-ascii", "ascii"))


def _codec(name: str) -> str | None:
    name = name.strip().strip("\"'").lower()
    try:
        return codecs.lookup("windows-1252" if name in _LATIN else name).name
    except LookupError:
        return None


def decode_page(body: bytes | None, content_type: str = "") -> str:
    """By the header's charset, else a byte order mark, else the page's meta tag in its first 1024 bytes, else UTF-8 if it is, else windows-1252."""
    if not body:
        return ""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if body.startswith(mark):
            return body.decode(name, "replace")
    header = re.search(r"charset\s*=\s*([^;]+)", content_type or "", re.I)
    meta = _META.search(body[:1024])
    for name in (header[1] if header else "", meta[1].decode("ascii") if meta else ""):
        if name and (codec := _codec(name)):
            return body.decode(codec, "replace")
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError:
        return body.decode("windows-1252", "replace")
