"""HTML as a table: tags become rows, nesting becomes windows.

``html_tokens`` gives one row per tag or text run.  Elements are matched per
(page, tag, level), so unclosed inline tags only lose themselves.  One exchange by
page_id serves every window and the regrouping to pages that follows.

Known limits: entities are decoded for a short list only, a heading or paragraph
ends at the next block tag, unmatched inline tags are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import rules as R
from leafmill.functions.text import col, flag, let, norm

# --- fixed values: markup ---
RAW_TAGS = ["script", "style", "noscript", "svg", "form"]
RAW_TEXT = (
    "(?is)<!--.*?-->|"
    + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in RAW_TAGS)
    + r"|<input\b[^>]*>"
)
TOKEN = r"</?[A-Za-z][^>]*>|<[!?][^>]*>|[^<]+|<"
ENTITIES = [
    ("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
    ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
]
ENDS_AT_BLOCK = ["p", "h1", "h2", "h3", "h4"]
BOUNDARY_TAGS = [t for t in R.BLOCK_TAGS if t != "br"]
PAGE_END = 2147483647
# markup of one task; its tokens in all their orders take some 170 times as much (measured: 341 MB of 2 MB)
TASK_BYTES = 2 * 1024 * 1024
TIGHT_TEXT = r"^[,.;:!?]"


def decode_entities(c) -> Column:
    c = col(c)
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def attribute(tag_text, name: str) -> Column:
    pattern = rf"""(?i)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(col(tag_text), pattern, g) for g in (1, 2, 3)])


def marker(*parts) -> Column:
    """Class-like attributes as plain words: camelCase split, lower case, signs to blanks."""
    text = F.concat_ws(" ", *parts)
    text = F.lower(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"))
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def marker_has(c, phrases) -> Column:
    return col(c).rlike("(?:^| )" + R.any_of(phrases) + "(?:$| )")


def has_class(c, names) -> Column:
    return F.lower(col(c)).rlike(r"(?:^|\s)" + R.any_of(names) + r"(?:$|\s)")


def strip_raw(html) -> Column:
    """Markup without comments and raw-text elements, inside a body element."""
    return let(
        F.regexp_replace(html, RAW_TEXT, ""),
        lambda h: F.when(h.rlike("(?i)<body"), h).otherwise(
            F.concat(F.lit("<body>"), h, F.lit("</body>"))
        ),
    )


def page_keys(pages: DataFrame) -> list[str]:
    """A page may come in parts (its markup and an embedded body); both stay in one partition."""
    return ["page_id", "part"] if "part" in pages.columns else ["page_id"]


def page_tasks(pages: DataFrame) -> int:
    """As many tasks as leave each about ``TASK_BYTES`` of markup, and one per core at least."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    size = pages.agg(F.sum(F.octet_length("html").cast("long"))).first()[0] or 0
    return max(cores, -(-size // TASK_BYTES))


def raw_tokens(pages: DataFrame, *carry: str) -> DataFrame:
    """(page_id, pos, tok): the markup split at tags.  Carried columns sit on the first token only.

    The exchange by page_id happens before the split, while a page is still one compact row;
    every later window and grouping is clustered by page_id already.  The number of its partitions
    follows the markup: left to itself the exchange makes them by the size of the compact rows,
    and each is sorted as tokens, which are many times larger.
    """
    keys = page_keys(pages)
    units = pages.select(*keys, *carry, strip_raw("html").alias("html"))
    units = units.repartition(page_tasks(pages), "page_id")
    rows = units.select(
        *keys, *carry, F.posexplode(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0))).alias("pos", "tok")
    )
    return rows.select(*keys, *[F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in carry], "pos", "tok")


def token_kinds(tokens: DataFrame) -> DataFrame:
    tag = F.lower(F.regexp_extract("tok", "^</?([A-Za-z][A-Za-z0-9:-]*)", 1))
    kind = (
        F.when(F.col("tok").rlike("^</[A-Za-z]"), "close")
        .when(
            F.col("tok").rlike("^<[A-Za-z]"),
            F.when(F.col("tag").isin(R.VOID_TAGS) | F.col("tok").endswith("/>"), "void").otherwise("open"),
        )
        .when(F.col("tok").rlike("^<[!?]"), "other")
        .otherwise("text")
    )
    return tokens.withColumn("tag", tag).withColumn("kind", kind)


def html_tokens(pages: DataFrame, *carry: str) -> DataFrame:
    """Token rows with element matching, depth, parent and live text pieces.

    end_pos   position where an opened element ends (null when it never does)
    depth     matched elements open at this token;  parent: position of the innermost one
    quote     list items and quotations open at this token
    live      0 inside navigation, footers, hidden parts and other dropped subtrees
    piece     live text, with a leading blank when one separates it from the text before
    """
    return with_parents(text_pieces(pages, *carry), page_keys(pages)).select(
        *page_keys(pages), *carry, "pos", "kind", "tag", "tok", "level", "end_pos", "depth", "parent", "live",
        "in_link", "quote", "piece",
    )


def text_pieces(pages: DataFrame, *carry: str) -> DataFrame:
    """``html_tokens`` without the parents, in page order.

    A task holds its tokens once for every order they are sorted in.  So windows of one order stand next to each other,
    and the last text before a token is the last value of the page, which needs no order of texts alone.
    """
    keys = page_keys(pages)
    page = Window.partitionBy(*keys).orderBy("pos")
    same_tag = Window.partitionBy(*keys, "tag").orderBy("pos")
    df = token_kinds(raw_tokens(pages, *carry))

    bounded = F.col("tag").isin(BOUNDARY_TAGS) & F.col("kind").isin("open", "close", "void")
    df = df.withColumn("_bound", bounded)
    bounds = Window.partitionBy(*keys, "_bound").orderBy("pos")
    df = df.withColumn("_bound_pos", F.when(F.col("_bound"), F.lead("pos").over(bounds)))

    is_open, is_close = F.col("kind") == "open", F.col("kind") == "close"
    step = F.when(is_open, 1).when(is_close, -1).otherwise(0)
    df = df.withColumn("_s", F.sum(step).over(same_tag))
    df = df.withColumn("_r", F.col("_s") - F.least(F.lit(0), F.min("_s").over(same_tag)))
    level = F.when(is_open, F.col("_r")).when(is_close, F.lag("_r", 1, 0).over(same_tag)).otherwise(0)
    df = df.withColumn("level", level.cast("int"))

    pair = Window.partitionBy(*keys, "tag", "level").orderBy("pos")
    df = df.withColumn("_next_kind", F.lead("kind").over(pair)).withColumn("_next_pos", F.lead("pos").over(pair))
    by_tag = F.when(is_open & (F.col("level") > 0) & (F.col("_next_kind") == "close"), F.col("_next_pos"))
    implicit = F.col("tag").isin(ENDS_AT_BLOCK)
    # a matched pair counts for depth; paragraphs only when their own tag ends them
    paired = F.when(implicit, F.when(F.col("_bound_pos") == by_tag, by_tag)).otherwise(by_tag)
    end_pos = F.when(
        is_open,
        F.when(implicit, F.col("_bound_pos"))
        .when(F.col("tag") == "li", F.coalesce(by_tag, F.col("_bound_pos")))
        .when(F.col("tag") == "body", F.coalesce(by_tag, F.lit(PAGE_END)))
        .otherwise(by_tag),
    )
    cls, role = attribute("tok", "class"), attribute("tok", "role")
    dropped = (
        F.col("tag").isin(R.DROPPED_TAGS + ["head"])
        | (F.lower(attribute("tok", "aria-hidden")) == "true")
        | has_class(cls, R.DROPPED_CLASSES)
        | role.isin(R.DROPPED_ROLES)
        | (attribute("tok", "id") == "discussion")
        | attribute("tok", "data-testid").contains("comments")
    )
    df = df.withColumn("end_pos", end_pos).withColumn("_paired", paired)
    df = df.withColumn("_drop", F.when(F.col("_paired").isNotNull(), flag(dropped)).otherwise(0))
    # the closing row learns from its opening row whether it is paired and whether it ends a dropped part
    df = df.withColumn("_opened", F.lag("_paired").over(pair)).withColumn("_opened_drop", F.lag("_drop").over(pair))
    ends_pair = is_close & (F.col("_opened") == F.col("pos"))
    delta = F.when(F.col("_paired").isNotNull(), 1).when(ends_pair, -1).otherwise(0)
    drop_delta = F.when(F.col("_drop") == 1, 1).when(ends_pair & (F.col("_opened_drop") == 1), -1).otherwise(0)
    link = F.when(F.col("tag") == "a", delta).otherwise(0)
    quote = F.when(F.col("tag").isin("li", "blockquote"), delta).otherwise(0)
    df = (
        df.withColumn("depth", F.sum(delta).over(page).cast("int"))
        .withColumn("live", F.when(F.sum(drop_delta).over(page) > 0, 0).otherwise(1))
        .withColumn("in_link", F.sum(link).over(page) > 0)
        .withColumn("quote", F.sum(quote).over(page).cast("int"))
    )

    decoded = decode_entities("tok")
    text = F.when((F.col("kind") == "text") & (F.col("live") == 1), norm(decoded)).otherwise("")
    df = df.withColumn("text", text)
    is_text = F.col("text") != ""
    gap_here = (
        (F.col("tag").isin(R.BLOCK_TAGS) & F.col("kind").isin("open", "close", "void"))
        | ((F.col("kind") == "text") & ~is_text)
    ).cast("int")
    df = df.withColumn("_gaps", F.sum(gap_here).over(page))
    before = page.rowsBetween(Window.unboundedPreceding, -1)

    def of_text_before(value, default):
        return F.coalesce(F.last(F.when(is_text, value), True).over(before), F.lit(default))

    gap = (
        F.col("tok").rlike(r"^(?:\s|&nbsp;)")
        | of_text_before(F.col("tok").rlike(r"(?:\s|&nbsp;)$"), True)
        | (F.col("_gaps") != of_text_before(F.col("_gaps"), 0))
    )
    piece = F.when(~is_text, "").when(
        gap & ~F.col("text").rlike(TIGHT_TEXT), F.concat(F.lit(" "), F.col("text"))
    ).otherwise(F.col("text"))
    return df.withColumn("piece", piece).select(
        *keys, *carry, "pos", "kind", "tag", "tok", "level", "end_pos", "_paired", "depth", "live", "in_link", "quote",
        "piece",
    )


def with_parents(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """``parent``: the position of the innermost matched element that is open at a token."""
    same_depth = Window.partitionBy(*keys, "depth").orderBy("pos")
    return tokens.withColumn(
        "parent", F.last(F.when(F.col("_paired").isNotNull(), F.col("pos")), True).over(same_depth)
    )


# --- fixed values: elements that make a division a container of blocks ---
INNER_BLOCKS = [
    "article", "main", "section", "nav", "aside", "ul", "ol", "p", "blockquote", "pre", "table",
    "figure", "figcaption", "footer", "header",
]


def _count(condition: Column) -> Column:
    return flag(condition)


def page_elements(pages: DataFrame, *carry: str) -> DataFrame:
    """One row per page: ``els`` (live elements with range statistics) and ``txt`` (live text pieces).

    The statistics are differences of running sums at the two ends of an element, so no
    element is joined to its content.
    """
    keys = page_keys(pages)
    page = Window.partitionBy(*keys).orderBy("pos")
    opened = (F.col("kind") == "open") & (F.col("live") == 1)
    n = F.length("piece")
    link_n = F.when(F.col("in_link") & (n > 0), F.length(F.trim("piece")) + 1).otherwise(0)
    sums = {
        "p": _count(opened & (F.col("tag") == "p")),
        "h": _count(opened & F.col("tag").isin("h1", "h2", "h3", "h4")),
        "li": _count(opened & (F.col("tag") == "li")),
        "n": n,
        "link": link_n,
        "art": _count(opened & F.col("tag").isin("article", "main")),
        "blk": _count(opened & F.col("tag").isin(INNER_BLOCKS)),
        "tx": _count(n > 0),
    }
    # in page order already; the parents need another order and come last
    tokens = text_pieces(pages, *carry)
    for name, value in sums.items():
        tokens = tokens.withColumn(f"c_{name}", F.sum(value).over(page).cast("int"))
    tokens = with_parents(tokens, keys)

    element = opened & F.col("end_pos").isNotNull()

    def attr(name):
        return F.when(element, attribute("tok", name)).otherwise("")

    tokens = tokens.select(
        *keys,
        *carry,
        "pos",
        F.struct(
            "pos", "tag", "end_pos", "parent", "in_link", "quote", "piece",
            element.alias("element"),
            attr("class").alias("cls"),
            attr("id").alias("id"),
            attr("role").alias("role"),
            attr("aria-label").alias("aria"),
            attr("data-testid").alias("testid"),
            F.when(F.col("tag") == "a", F.trim(attr("href"))).otherwise("").alias("href"),
            *[F.col(f"c_{name}") for name in sums],
        ).alias("t"),
    )
    grouped = tokens.groupBy(*keys).agg(
        F.array_sort(F.collect_list("t")).alias("toks"),
        *[F.first(c, ignorenulls=True).alias(c) for c in carry],
    )

    def stats(t):
        # a missing closing row means the element runs to the end of the page
        end = F.col("toks")[F.least(t.end_pos, F.size("toks") - 1)]
        return F.struct(
            t.pos.alias("open"), t.end_pos.alias("end"), t.tag.alias("tag"), t.cls.alias("cls"),
            t.id.alias("id"), t.role.alias("role"),
            marker(t.cls, t.id, t.role, t.aria, t.testid).alias("marker"),
            marker(t.cls, t.id, t.aria, t.testid).alias("inline_marker"),
            t.testid.alias("testid"),
            t.quote.alias("quote"),
            t.href.alias("href"),
            (end.c_p - t.c_p).alias("n_p"),
            (end.c_h - t.c_h).alias("n_h"),
            (end.c_li - t.c_li).alias("n_li"),
            (end.c_n - t.c_n).alias("raw_len"),
            (end.c_link - t.c_link).alias("raw_link"),
            (end.c_art - t.c_art).alias("n_art"),
            (end.c_blk - t.c_blk).alias("n_blk"),
            t.c_tx.alias("t_from"),
            end.c_tx.alias("t_to"),
        )

    texts = F.transform(
        F.filter("toks", lambda t: t.piece != ""),
        lambda t: F.struct(
            t.pos.alias("pos"), t.piece.alias("piece"), t.parent.alias("parent"), t.in_link.alias("link")
        ),
    )
    return grouped.select(
        *keys,
        *carry,
        F.transform(F.filter("toks", lambda t: t.element), stats).alias("els"),
        texts.alias("txt"),
    )
