"""Positioned text boxes to reading order: noise, order, merges, trims.

A screen is one row with ``boxes ARRAY<STRUCT<text, top, left, bottom, right, heading,
clickable, package>>``; all rules work inside the row.  The pairwise reading-order test of
positioned text is not transitive, so it is replaced by a total order: visual lines first
(a new line starts where the top moves by more than 14), then continuation, left, height, top.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import col, collapse, count_of, let, one_of, starts_any, token_key, words

BOX = "struct<text:string,top:int,left:int,bottom:int,right:int,heading:boolean,clickable:boolean,package:string>"
FIELDS = ["text", "top", "left", "bottom", "right", "heading", "clickable", "package"]
# --- fixed values: labels and distances ---
BAD_LABELS = [
    "sign in", "log in", "sign up", "privacy policy", "cookie policy", "terms of service",
    "skip to content", "open menu", "close menu", "table of contents", "see all comments",
    "show more replies", "share this", "subscribe", "follow us", "advertisement", "open in app",
    "download app", "view all", "copy link", "save", "like", "repost",
]
EXACT_LABELS = [
    "back", "home", "search", "share", "menu", "more options", "settings", "copy", "paste", "done",
    "cancel", "open", "close", "reload", "next", "previous", "sign in", "log in", "sign up",
    "subscribe", "skip to content", "accessibility",
]
PREFIX_LABELS = [
    "privacy", "terms", "cookie", "advertisement", "related", "recommended", "comments", "reply",
    "follow", "notifications", "open in app", "view all", "download app", "sign up for",
    "more from",
]
LINK_BLOCKED = [
    "back", "share", "reply", "comment", "comments", "menu", "search", "home", "next", "previous",
    "open", "close", "save", "follow", "subscribe", "like", "repost",
]
TEXT_BLOCKED = LINK_BLOCKED + ["related", "recommended", "more", "view all"]
SEPARATE_UI = ["share", "reply", "comment", "menu", "search", "home", "back", "next", "previous"]
WIDGET_CLASSES = "toolbar|tabwidget|bottomnavigation|actionmenu|chip"
CONTROL_CLASSES = "button|checkbox|switch"
BOUNDARY_MARKERS = [
    "discussion about this post", "select discussion type", "post preview for",
    "start your substack", "leave a comment", "add a comment", "see all comments",
]
CHROME_TITLES = r"\.com|www\.|substack|arg min| - by "
MONTHS = r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)\b"


def letters(c) -> Column:
    return count_of(c, r"\p{L}")


def _inline(c, low: int, blocked) -> Column:
    n = F.length(c)
    return (
        n.between(low, 72)
        & ~one_of(F.lower(c), blocked)
        & words(c).between(1, 6)
        & (letters(c) >= F.greatest(F.lit(low), F.floor(n / 2)))
    )


def inline_link(c) -> Column:
    return _inline(c, 3, LINK_BLOCKED) & ((words(c) > 1) | c.rlike(r"^\p{L}"))


def inline_text(c) -> Column:
    many = c.rlike(r"(?:^|\s)\p{Lu}") | c.contains(",")
    return _inline(c, 4, TEXT_BLOCKED) & F.when(words(c) == 1, c.rlike(r"^\p{L}")).otherwise(many)


def punctuation(c) -> Column:
    return c.rlike("^[.,;:!?]+$")


def captured_title(c) -> Column:
    return F.length(c).between(6, 140) & words(c).between(2, 18) & ~c.rlike("[.?!]$") & c.rlike(r"\p{Lu}")


def noisy_box(b) -> Column:
    def judge(t):
        low, n, w = F.lower(t), F.length(t), words(t)
        text_like = F.when(b.clickable, inline_link(t)).otherwise(inline_text(t))
        return (
            low.rlike("^(?:" + "|".join(BAD_LABELS) + ")(?:$| )")
            | F.lower(b.package).contains("systemui")
            | (b.clickable & (n < 36) & (w < 6) & ~inline_link(t))
            | ((n < 18) & (w < 3) & ~b.heading & ~text_like & ~punctuation(t))
        )

    return let(collapse(b.text), judge)


def text_candidate(text, description) -> Column:
    """The text, else a description that is not url-like and not mostly signs."""
    t, d = collapse(F.coalesce(col(text), F.lit(""))), collapse(F.coalesce(col(description), F.lit("")))
    low = F.lower(d)
    usable = (
        (d != "")
        & ~low.rlike(r"^(?:https?://|www\.)|%2f|%3a")
        & (count_of(d, r"[^\p{L}\p{Nd}\s]") <= F.greatest(F.lit(4), F.floor(F.length(d) / 3)))
    )
    return F.when(t != "", t).when(usable, d)


def included(text, package, widget, clickable, heading) -> Column:
    """May a box enter the collection at all?"""
    t = col(text)
    low, n, w = F.lower(t), F.length(t), words(t)
    widget = F.lower(col(widget))
    out = (
        F.lower(col(package)).contains("systemui")
        | ((n <= 32) & one_of(low, EXACT_LABELS))
        | ((n <= 48) & starts_any(low, PREFIX_LABELS))
        | widget.rlike(WIDGET_CLASSES)
    )
    return (
        F.when(t.isNull() | (t == "") | out, False)
        .when(widget.rlike(CONTROL_CLASSES), (n >= 70) & (w >= 10))
        .when(punctuation(t), True)
        .when((n < 36) & (w < 6) & ~col(heading), F.when(col(clickable), inline_link(t)).otherwise(inline_text(t)))
        .otherwise((w >= 8) | (n >= 52) | col(heading) | captured_title(t))
    )


def line_continuation(c) -> Column:
    t = collapse(c)
    return t.rlike(r"^[,;:.)\]}]") | (t.rlike(r"^\p{Ll}") & ((F.length(t) >= 40) | (words(t) >= 7)))


def quiet_boxes(boxes) -> Column:
    """Boxes without noise, first per text key."""
    kept = F.filter(col(boxes), lambda b: ~noisy_box(b))
    keyed = F.transform(kept, lambda b, i: F.struct(token_key(b.text).alias("key"), i.alias("i"), b.alias("b")))
    return let(
        F.array_sort(F.transform(keyed, lambda k: F.struct(k.key.alias("key"), k.i.alias("i")))),
        lambda ks: let(
            F.transform(
                F.filter(ks, lambda k, i: (i == 0) | (F.get(ks, i - 1).key != k.key)), lambda k: k.i
            ),
            lambda firsts: F.transform(
                F.filter(keyed, lambda k: F.array_contains(firsts, k.i)), lambda k: k.b
            ),
        ),
    )


def reading_order(boxes) -> Column:
    """Boxes with ``line``, in reading order."""
    by_top = F.array_sort(
        F.transform(
            col(boxes),
            lambda b, i: F.struct(b.top.alias("t"), b.left.alias("l"), (b.top - b.bottom).alias("h"), i.alias("i"), b.alias("b")),
        )
    )
    start = F.struct(F.lit(None).cast("int").alias("top"), F.lit(0).alias("line"), F.array().alias("out")).cast(
        f"struct<top:int,line:int,out:array<struct<line:int,cont:int,l:int,h:int,t:int,i:int,b:{BOX}>>>"
    )

    def step(acc, x):
        line = F.when(x.t - acc.top > 14, acc.line + 1).otherwise(acc.line).cast("int")
        row = F.struct(
            line.alias("line"), line_continuation(x.b.text).cast("int").alias("cont"), x.l.alias("l"),
            (x.b.bottom - x.b.top).alias("h"), x.t.alias("t"), x.i.alias("i"), x.b.alias("b"),
        )
        return F.struct(x.t.alias("top"), line.alias("line"), F.concat(acc.out, F.array(row)).alias("out"))

    return F.array_sort(F.aggregate(by_top, start, step).out)


def in_order(boxes) -> Column:
    return F.transform(reading_order(boxes), lambda r: r.b)


def separate(c) -> Column:
    return one_of(F.lower(F.trim(c)), SEPARATE_UI)


def joins_next(p, x) -> Column:
    overlap = (x.top <= p.bottom + 12) & (x.bottom >= p.top - 12)
    container = (p.right - p.left >= 400) | (p.bottom - p.top >= 100)
    same_line = overlap & (x.left - p.right).between(-8, 160)
    t = collapse(x.text)
    nested = (
        overlap & container & (x.left >= p.left - 12) & (x.right <= p.right + 12)
        & (inline_link(t) | inline_text(t) | punctuation(t) | line_continuation(x.text))
    )
    full = overlap & container & line_continuation(x.text) & (x.left <= p.left + 24) & (x.right >= p.right - 24)
    below = (x.top - p.bottom).between(-6, 42) & (F.abs(p.left - x.left) <= 96)
    open_end = ~p.text.rlike("[.?!]$")
    return (
        ~p.heading & ~x.heading & ~separate(p.text) & ~separate(x.text)
        & (same_line | nested | full | below)
        & (open_end | ((F.length(p.text) < 110) & x.text.rlike(r"^\p{Ll}")))
    )


def joins_before(p, x) -> Column:
    overlap = (x.top <= p.bottom + 12) & (x.bottom >= p.top - 12)
    return (
        ~p.heading & ~x.heading & overlap & (p.left - x.right).between(-8, 48)
        & (inline_link(collapse(x.text)) | inline_link(collapse(p.text)))
    )


def join_text(a, b) -> Column:
    def glue(s):
        joined = (
            F.when(s.a == "", s.b)
            .when(s.b == "", s.a)
            .when(s.a.endswith("-") & s.b.rlike(r"^\p{Ll}"), F.concat(F.substr(s.a, F.lit(1), F.length(s.a) - 1), s.b))
            .when(s.a.rlike("[/—–]$"), F.concat(s.a, s.b))
            .otherwise(F.concat(s.a, F.lit(" "), s.b))
        )
        return F.trim(F.regexp_replace(collapse(joined), r" ([,.;:!?])", "$1"))

    return let(F.struct(F.trim(a).alias("a"), F.trim(b).alias("b")), glue)


def merge_boxes(boxes) -> Column:
    """Adjacent boxes merged; extents grow while merging, so this is an ordered fold."""

    def step(acc, x):
        p = F.try_element_at(acc, F.lit(-1))
        front = F.slice(acc, F.lit(1), F.size(acc) - 1)
        both = lambda f: (p[f] & x[f]).alias(f)
        after = F.struct(
            join_text(p.text, x.text).alias("text"), p.top.alias("top"), p.left.alias("left"),
            F.greatest(p.bottom, x.bottom).alias("bottom"), F.greatest(p.right, x.right).alias("right"),
            both("heading"), both("clickable"), p.package.alias("package"),
        )
        before = F.struct(
            join_text(x.text, p.text).alias("text"), F.least(p.top, x.top).alias("top"),
            F.least(p.left, x.left).alias("left"), F.greatest(p.bottom, x.bottom).alias("bottom"),
            F.greatest(p.right, x.right).alias("right"), both("heading"), both("clickable"), p.package.alias("package"),
        )
        some = F.size(acc) > 0
        return (
            F.when(some & joins_next(p, x), F.concat(front, F.array(after)))
            .when(some & joins_before(p, x), F.concat(front, F.array(before)))
            .otherwise(F.concat(acc, F.array(x)))
        )

    return F.aggregate(col(boxes), F.array().cast(f"array<{BOX}>"), step)


def substantial(b) -> Column:
    t = collapse(b.text)
    return ~b.heading & ((F.length(t) >= 120) | (words(t) >= 18))


def trim_edges(boxes) -> Column:
    """Between the first and last substantial box keep all; outside only titles and longer text."""

    def run(bs):
        marks = F.transform(bs, lambda b, i: F.when(substantial(b), i))
        first, last = F.array_min(marks), F.array_max(marks)

        def kept(b, i):
            t = collapse(b.text)
            n, w = F.length(t), words(t)
            lead = b.heading | captured_title(t) | ((n >= 40) & (w >= 6) & ~b.clickable)
            tail = ~b.clickable & ((n >= 60) | (w >= 10))
            return F.when(i < first, lead).when(i > last, tail).otherwise(True)

        trimmed = F.when(first.isNull(), bs).otherwise(F.filter(bs, kept))
        return let(trimmed, lambda x: F.when(F.size(x) > 0, x).otherwise(bs))

    return let(col(boxes), run)


def median(values) -> Column:
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def drop_off_anchor(boxes) -> Column:
    """Short text away from the column of the substantial boxes goes."""

    def run(bs):
        solid = F.filter(bs, substantial)
        left = median(F.transform(solid, lambda b: b.left))
        width = median(F.transform(solid, lambda b: F.greatest(b.right - b.left, F.lit(0))))

        def with_anchor(a):
            def kept(b, i):
                t = collapse(b.text)
                n, w = F.length(t), words(t)
                delta = F.abs(b.left - a.left)
                between = (
                    (i > 0) & (i < F.size(bs) - 1)
                    & F.coalesce(substantial(F.get(bs, i - 1)), F.lit(False))
                    & F.coalesce(substantial(F.get(bs, i + 1)), F.lit(False))
                )
                return (
                    F.when(b.heading | substantial(b), True)
                    .when(between & ~b.clickable & (w <= 8) & (n <= 52) & (delta >= 100), False)
                    .when(b.clickable & inline_link(t) & between & (delta <= 72), True)
                    .when(b.clickable & (n <= 60) & (w <= 10), False)
                    .when((delta >= 120) & (n <= 90) & (b.right - b.left <= F.floor(a.width * 0.55)), False)
                    .otherwise(True)
                )

            return F.filter(bs, kept)

        anchored = let(F.struct(left.alias("left"), width.alias("width")), with_anchor)
        return F.when((F.size(bs) < 3) | (F.size(solid) == 0), bs).otherwise(anchored)

    return let(col(boxes), run)


def screen_text(boxes) -> Column:
    """The whole chain: noise, order, merge, trims; texts only."""
    done = drop_off_anchor(trim_edges(merge_boxes(in_order(quiet_boxes(boxes)))))
    return F.filter(F.transform(done, lambda b: collapse(b.text)), lambda t: t != "")


# ----- article start and discussion cut ------------------------------------------------------
def is_meta(c) -> Column:
    return F.lower(c).rlike("^(?:by|published) ") | c.rlike(MONTHS)


def is_paragraph(c) -> Column:
    return (F.length(c) >= 120) | (words(c) >= 20)


def is_subtitle(c) -> Column:
    return F.length(c).between(20, 160) & words(c).between(4, 22) & ~is_meta(c) & ~is_paragraph(c)


def discussion_start(c) -> Column:
    low = F.lower(collapse(c))
    return low.rlike(r"^(?:comment|reply) by |^\d+\s+repl(?:y|ies)\b|" + "|".join(BOUNDARY_MARKERS))


def start_scores(texts) -> Column:
    """Title score of the first six texts; null when a text is not title-like."""
    texts = F.transform(col(texts), collapse)

    def of(ts):
        def score(t, i):
            at = lambda k: F.coalesce(F.get(ts, i + k), F.lit(""))
            key = token_key(t)
            repeated = F.exists(
                F.slice(ts, F.lit(1), i), lambda p: let(token_key(p), lambda k: (F.length(k) > F.length(key)) & k.contains(key))
            )
            pts = lambda test, n: F.when(test, n).otherwise(0)
            total = (
                30 - i * 4
                - pts(F.lower(t).rlike(CHROME_TITLES), 18)
                - pts(F.lower(t).contains(" - by "), 14)
                + pts(repeated, 28)
                + pts(is_subtitle(at(1)), 12)
                + pts(is_meta(at(1)) | is_meta(at(2)), 18)
                + pts(is_paragraph(at(1)) | is_paragraph(at(2)) | is_paragraph(at(3)), 14)
            )
            return F.when(captured_title(t), total).cast("int")

        return F.transform(F.slice(ts, 1, 6), score)

    return let(texts, of)


def article_part(texts) -> Column:
    """Texts from the best title (score of at least 55) to the first discussion marker; never empty."""
    texts = col(texts)

    def run(scores):
        best = F.array_max(scores)
        start = F.when(best >= 55, F.array_position(scores, best)).otherwise(1).cast("int")
        rest = F.slice(texts, start, F.greatest(F.size(texts), F.lit(1)))

        def cut(r):
            stop = F.array_position(F.transform(r, discussion_start), F.lit(True)).cast("int")
            kept = F.when(stop > 0, F.slice(r, F.lit(1), stop - 1)).otherwise(r)
            return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(texts))

        return let(rest, cut)

    return F.when(F.size(texts) > 0, let(start_scores(texts), run)).otherwise(texts)
