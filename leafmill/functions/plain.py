"""Rules for plain text: line joining, title, metadata and heading tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions import rules as R
from leafmill.functions.text import col, collapse, count_of, has_any, has_words, length_to, starts_any, words


def join_lines(c) -> Column:
    """One paragraph from its lines: hyphen + lower case joins tight, '/' and dashes join without a blank."""
    t = F.regexp_replace(col(c), r"^\s+|\s+$", "")
    t = F.regexp_replace(t, r"\s*\n\s*", "\n")
    t = F.regexp_replace(t, r"-\n(\p{Ll})", "$1")
    t = F.regexp_replace(t, r"([/—–])\n", "$1")
    return F.trim(F.regexp_replace(collapse(t), r" ([,.;:!?])", "$1"))


def paragraphs(c) -> Column:
    """Array of paragraphs: newlines unified, split on blank lines, lines joined, blanks dropped."""
    t = F.translate(F.regexp_replace(col(c), "\r\n?", "\n"), " ", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return F.filter(F.transform(F.split(t, r"\n\s*\n+"), join_lines), lambda p: p != "")


def is_heading(c) -> Column:
    c = col(c)
    return (
        length_to(c, 111).between(3, 110)
        & ~c.rlike(r"[.?!]$")
        & has_words(c, 1)
        & ~has_words(c, 15)
        & ~c.rlike("(?i)^https?://")
        & c.rlike(r"[\p{Lu}\p{Nd}]")
    )


def is_title(c) -> Column:
    c = col(c)
    return (
        F.length(c).between(4, 140)
        & words(c).between(1, 18)
        & ~c.rlike(r"[.?!]$")
        & c.rlike(r"\p{Lu}")
    )


def is_metadata(c) -> Column:
    c = col(c)
    low = F.lower(c)
    listed = (
        (words(c) <= 20)
        & c.rlike("[,;]")
        & (count_of(c, r"\p{Lu}") >= 2)
        & ~c.endswith(".")
    )
    return (
        F.length(c).between(3, 220)
        & ~starts_any(low, ["abstract", "introduction"])
        & (has_any(low, R.PLAIN_METADATA_MARKERS) | listed)
    )
