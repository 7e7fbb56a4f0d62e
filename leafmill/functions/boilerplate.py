"""Boilerplate rules over one block: footer stripping, the twelve classifiers, stop headings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions import rules as R
from leafmill.functions.rules import any_of
from leafmill.functions.text import (
    col,
    contains_any,
    has_any,
    has_words,
    length_to,
    let,
    n_contained,
    one_of,
    starts_any,
    strings,
    words,
)


def article_remainder(c) -> Column:
    c = col(c)
    return (
        (length_to(c, 40) >= 40) & has_words(c, 8) & c.rlike(r"\p{Ll}") & c.rlike("[.,;:]")
    )


def article_or_title(c) -> Column:
    c = col(c)
    title = F.length(c).between(12, 220) & words(c).between(2, 24) & c.rlike(r"\p{Ll}")
    return article_remainder(c) | title


def _keep_if(rest: Column, ok: Column, text: Column) -> Column:
    return F.when(ok, rest).otherwise(text)


def strip_part(c, pattern: str) -> Column:
    """Remove the matched part if the remainder stands on its own."""

    def apply(text):
        rest = F.trim(F.regexp_replace(text, pattern, ""))
        return let(rest, lambda r: _keep_if(r, text.rlike(pattern) & article_or_title(r), text))

    return let(c, apply)


def strip_copyright_lead(c) -> Column:
    """Drop 'Copyright ... all rights reserved <publisher> <hash>' in front of article text."""

    def apply(text):
        low = F.lower(text)
        # position, list rank and length of each publisher packed in one number; the last position wins
        packed = [
            F.when(F.instr(low, p) > 0, F.instr(low, p) * 10000 + i * 100 + len(p)).otherwise(F.lit(0))
            for i, p in enumerate(R.FOOTER_PUBLISHERS)
        ]
        rights = F.regexp_extract(text, R.RIGHTS_SENTENCE, 0)
        rights_end = F.locate("all rights reserved", low) - 1 + F.length(rights)
        end = let(
            F.greatest(*packed),
            lambda best: F.when(
                best > 0, F.floor(best / 10000).cast("int") + best % 100 - 1
            ).otherwise(rights_end),
        )
        rest = F.trim(F.regexp_replace(F.substr(text, end + 1), R.COPYRIGHT_TAIL_NOISE, ""))
        applies = low.rlike("^(?:copyright|©)") & low.contains("all rights reserved")
        return F.when(
            applies, let(rest, lambda r: _keep_if(r, article_remainder(r), text))
        ).otherwise(text)

    return let(c, apply)


def strip_inline_footers(c) -> Column:
    """The five strips in order; every one only if what remains reads like an article or a title."""
    text = strip_part(F.trim(col(c)), R.LEAD_PUBLISHER_LABEL)
    text = strip_copyright_lead(text)
    for pattern in (R.LEAD_PUBLISHER_FOOTER, R.TRAIL_COPYRIGHT_FOOTER, R.TRAIL_PUBLISHER_FOOTER):
        text = strip_part(text, pattern)
    return F.trim(text)


# a block without any of these words can not be changed by the strips
# the words are tried only at letters that one of them begins with
STRIP_HINT = (
    r"(?=[cC©wWdDnNbBaA])"
    r"(?i:copyright|©|wall street journal|dow jones|new york times|washington post|bloomberg|associated press)"
)


def stripped(c) -> Column:
    """``strip_inline_footers`` behind a cheap test, so ordinary text pays one regex."""
    return let(c, lambda t: F.when(t.rlike(STRIP_HINT), strip_inline_footers(t)).otherwise(t))


def tokens(c) -> Column:
    trimmed = F.transform(
        F.split(F.lower(col(c)), r"\s+"),
        lambda t: F.regexp_replace(t, f"^[{R.TOKEN_TRIM}]+|[{R.TOKEN_TRIM}]+$", ""),
    )
    return F.filter(trimmed, lambda t: t != "")


def up_to(c, n: int) -> Column:
    return length_to(c, n + 1) <= n


# The rules take the lower-case text of a block; a caller that asks several of them makes it once.
def lowered(c, low: Column | None) -> Column:
    return F.lower(col(c)) if low is None else low


def social_share(c, low: Column | None = None) -> Column:
    def judge(low):
        hits = F.filter(
            strings(R.SOCIAL_TOKENS),
            lambda t: (low == t)
            | low.contains(F.concat(F.lit(" "), t))
            | low.startswith(F.concat(t, F.lit(" "))),
        )
        return (F.size(hits) >= 2) | starts_any(low, R.SOCIAL_STARTS)

    def hinted(x):
        return F.when(contains_any(x, R.SOCIAL_TOKENS + R.SOCIAL_STARTS), judge(x)).otherwise(F.lit(False))

    low = lowered(c, low)
    return F.when(up_to(c, 220), let(low, hinted)).otherwise(F.lit(False))


def ad_tech(c, heading: Column, low: Column | None = None) -> Column:
    c = col(c)
    few = ~has_words(c, 9) | (heading & up_to(c, 80))
    judge = lambda x: one_of(x, R.AD_EXACT) | (few & contains_any(x, R.AD_TOKENS))
    return up_to(c, 180) & let(lowered(c, low), judge)


def copyright_footer(c, low: Column | None = None) -> Column:
    c = col(c)
    low = lowered(c, low)
    mark = low.contains("copyright") | low.contains("©")
    rights = low.contains("all rights reserved")
    publisher = contains_any(low, R.RIGHTS_PUBLISHERS)
    return up_to(c, 360) & (
        (mark & (rights | publisher)) | (rights & (publisher | low.rlike(R.HASH_PATTERN)))
    )


def publisher_footer(c, low: Column | None = None) -> Column:
    c = col(c)
    low = lowered(c, low)
    return (
        up_to(c, 220)
        & contains_any(low, R.FOOTER_PUBLISHERS)
        & (low.rlike(R.HASH_PATTERN) | (~has_words(c, 11) & ~c.rlike("[.!?]")))
    )


# one of the words as a whole token
UTILITY_HINT = (
    rf"(?<!\S)[{R.TOKEN_TRIM}]*+{any_of(sorted(set(R.ACTION_TOKENS + R.UTILITY_TOKENS)))}[{R.TOKEN_TRIM}]*+(?!\S)"
)


def action_utility(c, heading: Column, low: Column | None = None) -> Column:
    c = col(c)

    def judge(toks):
        n = F.size(toks)
        actions = F.size(F.filter(toks, lambda t: one_of(t, R.ACTION_TOKENS)))
        utilities = F.size(F.filter(toks, lambda t: one_of(t, R.UTILITY_TOKENS)))
        mostly_short = F.size(F.filter(toks, lambda t: F.length(t) > 14)) <= 1
        return (n > 0) & (
            (mostly_short & (actions >= 2))
            | (heading & (actions >= 1) & (n <= 4))
            | (mostly_short & (utilities >= 3) & (n <= 10))
        )

    # no listed word, no hit: the regex spares most blocks the token arrays
    hint = lowered(c, low).rlike(UTILITY_HINT)
    return F.when(up_to(c, 180) & hint, let(tokens(c), judge)).otherwise(F.lit(False))


def site_info(c, low: Column | None = None) -> Column:
    low = lowered(c, low)
    judged = let(
        low,
        lambda x: (n_contained(x, R.SITE_INFO_PHRASES) >= 2)
        | starts_any(x, ["site information", "site index"]),
    )
    hint = let(low, lambda x: contains_any(x, R.SITE_INFO_PHRASES))
    return F.when(up_to(c, 260) & hint, judged).otherwise(F.lit(False))


def nav_line(c) -> Column:
    """At least three parts by the first separator that gives three, three of them short."""
    c = col(c)

    def judge(text):
        splits = F.transform(
            F.expr(r"array(' \\| ', ' · ', ' • ', ' / ')"), lambda sep: F.split(text, sep)
        )
        parts = F.try_element_at(F.filter(splits, lambda p: F.size(p) >= 3), F.lit(1))
        short = F.filter(
            parts, lambda p: (F.trim(p) != "") & (F.length(F.trim(p)) <= 22) & (words(p) <= 3)
        )
        return F.coalesce(F.size(short) >= 3, F.lit(False))

    return F.when(up_to(c, 220) & c.rlike(" [|·•/] "), let(c, judge)).otherwise(F.lit(False))


def media_credit(c, heading: Column, low: Column | None = None) -> Column:
    low = lowered(c, low)
    return ~heading & up_to(c, 160) & low.rlike("^" + any_of(R.CREDIT_PREFIXES) + "(?:$|[ :])")


def acknowledgement(c, low: Column | None = None) -> Column:
    c = col(c)
    return (
        up_to(c, 220)
        & lowered(c, low).rlike("^" + any_of(R.ACK_PREFIXES) + "(?:$| )")
        & ~has_words(c, 29)
    )


def boilerplate_rules(text, heading: Column, low: Column | None = None) -> dict[str, Column]:
    """One boolean column per rule over a normalised block."""
    c = col(text)
    low = lowered(c, low)
    short = up_to(c, 180)
    return {
        "hard_prefix": starts_any(low, R.HARD_PREFIXES),
        "heading_phrase": heading & short & has_any(low, R.HEADING_PHRASES),
        "ui_phrase": short & ~has_words(c, 7) & starts_any(low, R.UI_PHRASES),
        "social_share": social_share(c, low),
        "ad_tech": ad_tech(c, heading, low),
        "copyright_footer": copyright_footer(c, low),
        "publisher_footer": publisher_footer(c, low),
        "action_utility": action_utility(c, heading, low),
        "site_info": site_info(c, low),
        "nav_line": nav_line(c),
        "media_credit": media_credit(c, heading, low),
        "acknowledgement": acknowledgement(c, low),
    }


def is_boilerplate(text, heading: Column) -> Column:
    """Any rule.  Only the prefix rule applies above 360 characters, so long text stops there."""
    def judge(head, low):
        named = boilerplate_rules(head, heading, low)
        prefix = named.pop("hard_prefix")
        return prefix | (up_to(head, 360) & reduce(lambda a, b: a | b, named.values()))

    # the rules see the text to one character over their limit
    return let(F.substring(col(text), 1, 361), lambda head: let(F.lower(head), lambda low: judge(head, low)))


def is_stop_heading(text, heading: Column) -> Column:
    """Stop headings and acknowledgement paragraphs: that block goes, later ones stay."""
    c = col(text)
    return (heading & has_any(F.lower(c), R.STOP_HEADINGS)) | (~heading & acknowledgement(c))
