"""Column expressions on text, with the same meaning as the page-at-a-time operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from webextract import constants as C
from webextract.operators.elements import LATEX_PATTERN
from webextract.operators.scoring import BYLINE_PATTERN, DATE_PATTERN
from webextract.operators.standardize import TEXT_CHAIN

#: Unicode white space, as a class that Java's and RE2's engines take alike.
SPACE = r"[\s\x{00A0}\x{0085}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1680}\x{0B}]"


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACE + "+"), lambda w: w != "")).cast("long")


def has_date(text: Column) -> Column:
    return text.rlike("(?i)" + DATE_PATTERN)


def has_byline(text: Column) -> Column:
    return text.rlike("(?i)" + BYLINE_PATTERN)


def navigation_hits(text: Column) -> Column:
    """How many of the navigation phrases the text contains."""
    low = F.lower(text)
    return reduce(Column.__add__, [low.contains(p).cast("long") for p in C.NAVIGATION_PHRASES])


def flattened(text: Column, most: int) -> Column:
    """The first characters, white space collapsed."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.substring(text, 1, most), r"^[ \t\n\f\r]+|[ \t\n\f\r]+$", "")), r"[ \t\n\f\r]+", " ")


def shortened(text: Column, most: int = 200, least: int = 150) -> Column:
    """The first characters, back to the last space if that is far enough in."""
    cut = F.substring(text, 1, most)
    at = F.length(cut) - F.instr(F.reverse(cut), " ")
    whole = F.trim(F.when((F.instr(cut, " ") > 0) & (at > least), F.substring(cut, F.lit(1), at)).otherwise(cut))
    return F.when(F.length(text) <= most, F.trim(text)).otherwise(whole)


def looks_like_latex(text: Column) -> Column:
    return text.rlike(LATEX_PATTERN)


def normalized_text(text: Column) -> Column:
    """The chain that text nodes of the content go through."""
    for pattern, to in TEXT_CHAIN:
        text = F.regexp_replace(text, pattern.replace("$", r"\z"), to.replace("\\1", "$1"))
    return text


def domain(url: Column) -> Column:
    """The host without user, port and a leading www."""
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")
