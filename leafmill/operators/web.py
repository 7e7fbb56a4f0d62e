"""Main-content extraction from web pages.

``page_elements`` leaves one row per page with its live elements and text pieces.
Everything after that is an expression inside the row: noisy containers, link-density
pruning, container scores, block extraction, the competing strategies and their
scores.  The whole extraction therefore has one exchange, by page_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import arrays as A
from leafmill.functions import boilerplate as B
from leafmill.functions import rules as R
from leafmill.functions.text import (
    blank_to_null, col, dedupe_key, has_words, length_to, let, norm, one_of, starts_any, token_key, url_host, words,
)
from leafmill.operators import blocks as K
from leafmill.operators.html import attribute, decode_entities, has_class, marker_has, page_elements
from leafmill.sources.corpus import title_from_url

# --- fixed values: container and block thresholds ---
CANDIDATE_MIN_CHARS = 250
CANDIDATES_KEPT = 4
SAME_LINEAGE_RATIO = 0.8
PRUNE_DENSITY = 0.72
PRUNE_MAX_CHARS = 700
STRONG_PARAGRAPHS = 3
STRONG_CHARS = 500
JSON_LD_MIN_CHARS = 500
FALLBACK_MIN_SOURCE = 700
FALLBACK_RATIO = 0.45
CANDIDATE_TAGS = ["body", "article", "main", "section", "div"]
HEADING_TAGS = ["h1", "h2", "h3", "h4"]
# class, ancestor test, in order; a container of any of them is a site-rule container
SITE_RULES = [
    (["body", "markup"], "class", "available-content"),
    (["markup"], "class", "available-content"),
    (["body", "markup"], "testid", "post-content"),
    (["markup"], "testid", "post-content"),
    ([], "testid", "post-content"),
    (["body", "markup"], "class", "post-content"),
    (["markup"], "class", "post-content"),
    (["post-content"], "none", ""),
    (["body", "markup"], "tag", "article"),
    (["markup"], "tag", "article"),
    (["body", "markup"], "none", ""),
]
ARTICLE_BODY = r'"articleBody"\s*:\s*"((?:\\.|[^"\\])*+)"'
BODY_HTML = r'"body_html"\s*:\s*"((?:\\.|[^"\\])*+)"'
LD_JSON = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script\s*>"


# ----- element predicates -------------------------------------------------------------
def text_len(e) -> Column:
    return F.greatest(e.raw_len - 1, F.lit(0))


def link_density(e, empty: float) -> Column:
    n = text_len(e)
    return F.when(n == 0, F.lit(empty)).otherwise(F.greatest(e.raw_link - 1, F.lit(0)) / n)


def class_id(e) -> Column:
    return F.lower(F.concat(e.cls, F.lit(" "), e.id))


def likely_article(e) -> Column:
    return (
        e.tag.isin("article", "main")
        | (e.n_art > 0)
        | (
            (e.n_p >= 5)
            & (text_len(e) >= 1000)
            & (link_density(e, 0.0) < 0.35)
            & ((e.n_h >= 1) | class_id(e).rlike(R.any_of(R.ARTICLE_MARKERS)))
        )
    )


def noisy_container(e) -> Column:
    return (e.marker != "") & marker_has(e.marker, R.NOISY_CONTAINER_PHRASES) & ~likely_article(e)


def inside(x, r) -> Column:
    """Element x lies strictly inside r."""
    return (x.open > r.open) & (x.open < r.end)


def outermost(els) -> Column:
    """Elements that no earlier one contains.  ``els`` ascend by open, so the largest end so far tells."""
    return let(els, lambda es: let(A.reach_of(es), lambda index: F.filter(es, lambda e: ~A.reached(index, e.open, e.open))))


REMOVED_SUMS = {"raw_len": None, "raw_link": None, "n_p": ["p"], "n_h": HEADING_TAGS, "n_li": ["li"]}
SUMS = "struct<" + ",".join(f"{name}:int" for name in REMOVED_SUMS) + ">"


def without(els, removed) -> Column:
    """Elements outside the removed ranges, statistics lowered by what was removed inside them.

    ``removed`` are outermost ranges and so disjoint; what lies inside an element is a run of them, a difference of two
    running sums whose places are found by binary search.
    """
    removed = col(removed)

    def own(r, field, tags):
        return r[field] + (one_of(r.tag, tags).cast("int") if tags else F.lit(0))

    def add(total, r):
        return F.struct(*[(total[f] + own(r, f, tags)).alias(f) for f, tags in REMOVED_SUMS.items()])

    def lowered(index, sums):
        def adjust(e):
            def less(run):
                low, high = F.get(sums, run["from"]), F.get(sums, run["to"])
                for f in REMOVED_SUMS:
                    yield f, e[f] - (high[f] - low[f])

            def change(run):
                changed = e
                for f, value in less(run):
                    changed = changed.withField(f, value)
                return F.when(run["to"] > run["from"], changed).otherwise(e)

            return let(A.opened_between(index["opens"], e.open, e.end), change)

        survivors = F.filter(col(els), lambda e: ~A.reached(index, e.open + 1, e.open))
        return F.transform(survivors, adjust)

    nothing = F.struct(*[F.lit(0).alias(f) for f in REMOVED_SUMS]).cast(SUMS)
    sums = F.concat(F.array(nothing), A.running(removed, nothing, add, SUMS))
    done = let(A.reach_of(removed), lambda index: let(sums, lambda total: lowered(index, total)))
    return F.when(F.size(removed) == 0, col(els)).otherwise(done)


def mute(txt, removed) -> Column:
    """Text pieces inside removed ranges become empty; indexes stay valid."""

    def silent(index):
        return F.transform(
            col(txt), lambda t: t.withField("piece", F.when(A.reached(index, t.pos, t.pos), F.lit("")).otherwise(t.piece))
        )

    return F.when(F.size(col(removed)) == 0, col(txt)).otherwise(let(A.reach_of(removed), silent))


def pieces(e, txt="txt") -> Column:
    return F.slice(col(txt), e.t_from + 1, e.t_to - e.t_from)


def join_pieces(items) -> Column:
    return F.trim(F.array_join(F.transform(items, lambda t: t.piece), ""))


def inline_ui(e, txt) -> Column:
    """Share bars, action lines, site info, ads and credits inside the content."""
    own = join_pieces(F.filter(pieces(e, txt), lambda t: t.parent == e.open))
    full = join_pieces(pieces(e, txt))

    def judge(o):
        no = F.lit(False)
        interface = lambda low: (
            B.social_share(o, low)
            | B.action_utility(o, no, low)
            | B.site_info(o, low)
            | B.ad_tech(o, no, low)
            | B.media_credit(o, no, low)
        )
        utility = B.up_to(o, 260) & (o != "") & let(F.lower(o), interface)
        noisy = marker_has(e.inline_marker, R.INLINE_NOISE_PHRASES)
        return utility | (
            noisy & (B.up_to(o, 120) | let(full, lambda f: (f == "") | ~B.article_remainder(f)))
        )

    body = let(own, lambda o: F.when(o != "", o).otherwise(full))
    return ~e.tag.isin("html", "body", "article", "main") & let(body, judge)


def pruned_by_class(e) -> Column:
    return (
        has_class(e.cls, R.PRUNED_CLASSES)
        | (e.id == "discussion")
        | e.role.isin(R.DROPPED_ROLES)
        | e.testid.rlike("share|sidebar|newsletter|comments")
    )


def pruned_by_density(e) -> Column:
    n = text_len(e)
    return one_of(e.tag, R.STRUCTURAL_TAGS) & (
        (n == 0) | ((link_density(e, 0.0) > PRUNE_DENSITY) & (n < PRUNE_MAX_CHARS))
    )


def container_score(e) -> Column:
    density = link_density(e, 1.0)
    cid = class_id(e)
    return (
        e.n_p * 14.0
        + e.n_h * 8.0
        + F.least(e.n_li, F.lit(12)) * 2.0
        + F.least(text_len(e), F.lit(12000)) / 18.0
        + F.when(e.tag == "article", 90.0).when(e.tag == "main", 75.0).otherwise(0.0)
        + F.when(cid.rlike("article|content|post|story"), 40.0).otherwise(0.0)
        + F.when(cid.rlike("body|entry|markdown"), 24.0).otherwise(0.0)
        - F.when(density > 0.55, 90.0).when(density > 0.35, 35.0).otherwise(0.0)
    )


# ----- blocks -------------------------------------------------------------------------
def alnum_len(c) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{Nd}]+", ""))


def usable_text(text, tag) -> Column:
    heading = tag.startswith("h")
    quiet = lambda low: ~starts_any(low, R.NOISY_BLOCK_STARTS) & ~B.action_utility(text, F.lit(False), low)
    body = (
        ((length_to(text, 45) >= 45) | has_words(text, 8))
        & (alnum_len(text) >= F.length(text) * 0.55)
        # a beginning, and a rule for texts of 180 characters
        & let(F.lower(F.substring(text, 1, 181)), quiet)
    )
    return F.when(text == "", F.lit(False)).when(
        heading, has_words(text, 1) & ~has_words(text, 19) & length_to(text, 141).between(4, 140)
    ).otherwise(body)


def distinct_blocks(items) -> Column:
    """First block per key of its whole text; headings lose a trailing colon."""
    keyed = F.filter(
        F.transform(items, lambda b: b.withField("key", token_key(b.text))),
        lambda b: b.key != "",
    )
    return let(
        keyed,
        lambda bs: let(
            F.transform(bs, lambda b: b.key),
            lambda keys: F.transform(
                F.filter(bs, lambda b, i: F.array_position(keys, b.key) == i + 1),
                lambda b: F.struct(
                    b.pos.alias("pos"),
                    F.when(b.tag.startswith("h"), "Heading").otherwise("Paragraph").alias("type"),
                    F.when(b.tag.startswith("h"), F.regexp_replace(b.text, ":$", ""))
                    .otherwise(b.text)
                    .alias("text"),
                ),
            ),
        ),
    )


def prepare(pages: DataFrame, *carry: str) -> DataFrame:
    """Page rows with everything the strategies share.

    els2 / txt2   elements and text without noisy containers
    els3 / txt3   the same without inline interface parts
    pruned        elements to leave out inside a container
    block_els     elements that may become blocks, with their text
    """
    df = page_elements(pages, *carry)
    df = df.withColumn("_noisy", F.filter("els", noisy_container)).withColumn("noisy", outermost("_noisy"))
    df = df.withColumn("els2", without("els", "noisy")).withColumn("txt2", mute("txt", "noisy"))
    df = df.withColumn("_ui", F.filter("els2", lambda e: inline_ui(e, "txt2"))).withColumn("ui", outermost("_ui"))
    df = df.withColumn("els3", without("els2", "ui")).withColumn("txt3", mute("txt2", "ui"))
    df = df.withColumn(
        "pruned",
        F.filter(
            "els3", lambda e: ~e.tag.isin("html", "body") & (pruned_by_class(e) | pruned_by_density(e))
        ),
    )
    df = df.withColumn("_divs", F.filter("els3", lambda e: (e.tag == "div") & (text_len(e) >= 40)))
    df = df.withColumn("_opens", F.transform("_divs", lambda d: d.open))
    block = F.filter(
        "els3",
        lambda e: (one_of(e.tag, HEADING_TAGS + ["p", "pre"]) & (e.quote == 0))
        | (e.tag.isin("li", "blockquote") & (e.quote == 1))
        | (
            (e.tag == "div")
            & (e.n_blk == 0)
            & (text_len(e) >= 45)
            & ~marker_has(e.marker, R.UI_MARKER_PHRASES)
            & (link_density(e, 1.0) <= PRUNE_DENSITY)
            & let(A.opened_between(F.col("_opens"), e.open, e.end), lambda run: run["to"] == run["from"])
        ),
    )
    with_text = F.transform(block, lambda e: e.withField("text", join_pieces(pieces(e, "txt3"))))
    like_text = lambda e: (e.tag != "div") | (
        (F.length(e.text) >= 45) & (words(e.text) >= 8) & e.text.rlike(r"\p{Ll}") & e.text.rlike("[.!?,]")
    )
    df = df.withColumn("block_els", F.filter(with_text, lambda e: (e.text != "") & like_text(e)))
    return df.drop("_noisy", "_ui", "_divs", "_opens", "els", "txt")


def container_blocks(container, prune: bool = True) -> Column:
    """Usable, distinct blocks inside one container.

    Pruned ranges ascend by open: those inside the container, and those inside a block, are runs found by binary search.
    """
    items = F.filter("block_els", lambda b: (b.open > container.open) & (b.open < container.end))
    if prune:

        def kept_text(b, run, pruned):
            within = let(
                A.reach_of(F.slice(pruned, run["from"] + 1, run["to"] - run["from"])),
                lambda index: join_pieces(F.filter(pieces(b, "txt3"), lambda t: ~A.reached(index, t.pos + 1, t.pos))),
            )
            return F.when(run["to"] > run["from"], within).otherwise(b.text)

        def kept(pruned):
            return let(
                A.reach_of(pruned),
                lambda index: F.transform(
                    F.filter(items, lambda b: ~A.reached(index, b.open + 1, b.open)),
                    lambda b: F.struct(
                        b.open.alias("pos"), b.tag.alias("tag"), b.marker.alias("marker"),
                        let(A.opened_between(index["opens"], b.open, b.end), lambda run: kept_text(b, run, pruned)).alias("text"),
                    ),
                ),
            )

        items = let(F.filter("pruned", lambda p: inside(p, container)), kept)
    else:
        items = F.transform(
            items,
            lambda b: F.struct(
                b.open.alias("pos"), b.tag.alias("tag"), b.marker.alias("marker"), b.text.alias("text")
            ),
        )
    usable = F.filter(
        items, lambda b: ~marker_has(b.marker, R.UI_MARKER_PHRASES) & usable_text(b.text, b.tag)
    )
    return distinct_blocks(usable)


def candidates(df: DataFrame) -> DataFrame:
    """``ranked``: containers by score; ``chosen``: the first four that do not repeat one another."""
    found = F.filter(
        "els2", lambda e: one_of(e.tag, CANDIDATE_TAGS) & (text_len(e) >= CANDIDATE_MIN_CHARS)
    )
    rows = F.transform(
        found,
        lambda e: F.struct(
            (-container_score(e)).alias("neg_score"),
            e.open.alias("open"),
            e.end.alias("end"),
            text_len(e).alias("n"),
            e.tag.alias("tag"),
            e.cls.alias("cls"),
            e.id.alias("id"),
            e.n_p.alias("n_p"),
            e.n_h.alias("n_h"),
            link_density(e, 0.0).alias("density"),
            F.concat_ws(
                "|", e.tag, e.id, e.cls,
                dedupe_key(join_pieces(pieces(e, "txt2"))),
            ).alias("key"),
        ),
    )
    df = df.withColumn("_rows", rows).withColumn("_keys", F.transform("_rows", lambda r: r.key))
    firsts = F.filter("_rows", lambda r, i: F.array_position("_keys", r.key) == i + 1)
    df = df.withColumn("ranked", F.array_sort(firsts))
    empty = F.slice(F.col("ranked"), 1, 0)

    def related(c, e):
        lineage = ((c.open > e.open) & (c.open < e.end)) | ((e.open > c.open) & (e.open < c.end))
        return lineage & (F.least(c.n, e.n) >= F.greatest(c.n, e.n) * SAME_LINEAGE_RATIO)

    chosen = F.aggregate(
        "ranked",
        empty,
        lambda acc, c: F.when(
            (F.size(acc) < CANDIDATES_KEPT) & ~F.exists(acc, lambda e: related(c, e)),
            F.concat(acc, F.array(c)),
        ).otherwise(acc),
    )
    best = F.array_sort(
        F.transform(
            F.filter("els2", lambda e: one_of(e.tag, CANDIDATE_TAGS) & (text_len(e) > 0)),
            lambda e: F.struct(
                (-container_score(e)).alias("neg_score"), e.open.alias("open"), e.end.alias("end"),
                text_len(e).alias("n"), e.tag.alias("tag"), e.cls.alias("cls"), e.id.alias("id"),
                e.n_p.alias("n_p"), e.n_h.alias("n_h"), link_density(e, 0.0).alias("density"),
                F.lit("").alias("key"),
            ),
        )
    )
    article = F.filter(best, lambda e: (e.tag == "article") & (e.n_p >= 3) & (e.n >= 500))
    fallback = F.slice(F.concat(article, best), 1, 1)
    df = df.withColumn("chosen", chosen)
    return df.withColumn(
        "chosen", F.when(F.size("chosen") > 0, F.col("chosen")).otherwise(fallback)
    ).drop("_rows", "_keys")


# ----- title, metadata, embedded text ---------------------------------------------------
def meta_content(html, key_attr: str, key: str) -> Column:
    """content of the first meta tag with the given name or property, whatever the attribute order."""
    tags = F.regexp_extract_all(col(html), F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0))
    # the value is asked for only in tags that hold it
    hits = F.filter(tags, lambda t: F.lower(t).contains(key) & (F.lower(attribute(t, key_attr)) == key))
    return let(F.try_element_at(hits, F.lit(1)), lambda t: decode_entities(attribute(t, "content")))


def page_title(html, url) -> Column:
    """og:title, twitter:title, the title element, else the last path segment of the url."""
    title_tag = norm(decode_entities(F.regexp_extract(col(html), r"(?is)<title[^>]*>(.*?)</title", 1)))
    return F.coalesce(
        blank_to_null(meta_content(html, "property", "og:title")),
        blank_to_null(meta_content(html, "name", "twitter:title")),
        blank_to_null(title_tag),
        title_from_url(url),
    )


def usable_metadata(text, title) -> Column:
    low = F.lower(text)
    return (
        F.length(text).between(3, 220)
        & (low != F.lower(title))
        & ~starts_any(low, R.METADATA_BAD_STARTS)
    )


# --- fixed value: elements that hold a byline ---
BYLINE_ELEMENT = (
    r"""(?is)<(?:time\b[^>]*|[a-z0-9]+\b[^>]*(?:class\s*=\s*["'][^"']*(?:byline|author|dek|standfirst|subtitle)"""
    r"""|data-testid\s*=\s*["'][^"']*(?:byline|author|subtitle)|rel\s*=\s*["']author["']"""
    r"""|itemprop\s*=\s*["'](?:author|datePublished)["'])[^>]*)>([^<]*)<"""
)


def page_metadata(html, title) -> Column:
    """Author, date, description and byline-like elements: distinct, first five."""
    author = norm(meta_content(html, "name", "author"))
    date = F.coalesce(
        blank_to_null(meta_content(html, "property", "article:published_time")),
        blank_to_null(meta_content(html, "name", "article:published_time")),
        F.lit(""),
    )
    date = norm(F.substring_index(date, "T", 1))
    described = norm(
        F.coalesce(
            blank_to_null(meta_content(html, "name", "description")),
            blank_to_null(meta_content(html, "property", "og:description")),
            blank_to_null(meta_content(html, "name", "twitter:description")),
            F.lit(""),
        )
    )
    bylines = F.filter(
        F.transform(
            F.regexp_extract_all(col(html), F.lit(BYLINE_ELEMENT), F.lit(1)),
            lambda t: norm(decode_entities(t)),
        ),
        lambda t: usable_metadata(t, col(title)),
    )
    fixed = F.array(
        let(author, lambda a: F.when(usable_metadata(a, col(title)), F.concat(F.lit("By "), a))),
        let(date, lambda d: F.when(d != "", F.concat(F.lit("Published "), d))),
        let(
            described,
            lambda d: F.when(F.length(d).between(40, 220) & (F.lower(d) != F.lower(col(title))), d),
        ),
    )
    return F.array_distinct(F.concat(F.array_compact(fixed), bylines))


def json_strings(text, pattern: str) -> Column:
    """Decoded values of a JSON string field found anywhere in a text."""
    return F.array_compact(
        F.transform(
            F.regexp_extract_all(col(text), F.lit(pattern), F.lit(1)),
            lambda v: F.from_json(F.concat(F.lit('{"v":"'), v, F.lit('"}')), "v string").v,
        )
    )


def longest(values) -> Column:
    """The longest text; the first one wins a tie."""
    ranked = F.transform(
        values, lambda v, i: F.struct(F.length(v).alias("n"), (-i).alias("first"), v.alias("v"))
    )
    return F.array_max(ranked).v


def structured_body(c) -> Column:
    t = F.regexp_replace(col(c), "\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def structured_heading(text) -> Column:
    return (
        words(text).between(1, 12)
        & F.length(text).between(4, 110)
        & ~text.rlike("[.?!]$")
        & text.rlike(r"\p{Lu}")
        & ~F.lower(text).startswith("http")
    )


def structured_blocks(body) -> Column:
    """Blocks of a body text split on blank lines."""
    parts = F.transform(F.split(col(body), r"\n\s*\n+"), lambda p, i: F.struct(i.alias("pos"), norm(p).alias("text")))
    kept = F.filter(parts, lambda p: structured_heading(p.text) | usable_text(p.text, F.lit("p")))
    return F.transform(
        kept,
        lambda p: F.struct(
            p.pos.cast("int").alias("pos"),
            F.when(structured_heading(p.text), "Heading").otherwise("Paragraph").alias("type"),
            F.when(structured_heading(p.text), F.regexp_replace(p.text, ":$", "")).otherwise(p.text).alias("text"),
        ),
    )


def json_ld_body(html) -> Column:
    scripts = F.array_join(F.regexp_extract_all(col(html), F.lit(LD_JSON), F.lit(1)), "\n")
    bodies = F.filter(
        F.transform(json_strings(scripts, ARTICLE_BODY), structured_body),
        lambda b: F.length(b) >= JSON_LD_MIN_CHARS,
    )
    return longest(bodies)


def embedded_body_html(html) -> Column:
    return longest(F.filter(json_strings(html, BODY_HTML), lambda b: F.trim(b) != ""))


def is_challenge(html) -> Column:
    return F.lower(col(html)).rlike(R.any_of(R.CHALLENGE_PHRASES))


def anchor_stop(text, tag, host) -> Column:
    low = F.lower(text)
    stop = starts_any(low, R.ANCHOR_STOPS) | (
        tag.startswith("h") & (F.length(low) < 80) & low.rlike(R.any_of(R.ANCHOR_STOPS))
    )
    for name, phrases in R.ANCHOR_STOPS_BY_HOST.items():
        stop = stop | (host.contains(name) & starts_any(low, phrases))
    return stop


def title_anchored_blocks(title, url) -> Column:
    """Blocks from the first heading that matches the title; stop lines are skipped, not ends."""
    key = token_key(title)
    items = F.transform(
        "block_els", lambda b: F.struct(b.open.alias("pos"), b.tag.alias("tag"), b.text.alias("text"))
    )

    def pick(bs):
        anchors = F.transform(
            bs,
            lambda b: b.tag.startswith("h")
            & let(token_key(b.text), lambda k: k.contains(key) | key.contains(k)),
        )
        start = F.array_position(anchors, F.lit(True)).cast("int")
        run = F.when(start > 0, F.slice(bs, start, F.size(bs))).otherwise(F.slice(bs, 1, 0))
        return distinct_blocks(
            F.filter(
                run,
                lambda b: ~anchor_stop(b.text, b.tag, url_host(url))
                & (b.tag.startswith("h") | usable_text(b.text, b.tag)),
            )
        )

    return F.when(key != "", let(items, pick)).otherwise(F.array().cast(K.BLOCKS))


# ----- strategies -----------------------------------------------------------------------
def count_type(blocks, type_) -> Column:
    return F.size(F.filter(blocks, lambda b: b.type == type_))


def block_chars(blocks, type_=None) -> Column:
    kept = blocks if type_ is None else F.filter(blocks, lambda b: b.type == type_)
    return F.aggregate(kept, F.lit(0), lambda a, b: a + F.length(b.text))


def block_set_score(blocks) -> Column:
    """Quality of a block list; null for an empty one."""

    def points(b):
        return let(F.length(b.text), lambda n: sized(b, n))

    def sized(b, n):
        heading = b.type == "Heading"
        tail = heading & F.lower(b.text).rlike(R.any_of(R.TAIL_HEADING_WORDS))
        return (
            F.when(heading, F.lit(24)).otherwise(n + 180)
            - F.when(~heading & (n < 80), 120).otherwise(0)
            - F.when(n < 24, 220).otherwise(0)
            - F.when(let(norm(b.text), lambda t: B.is_boilerplate(t, heading)), 320).otherwise(0)
            - F.when(tail, 260).otherwise(0)
        )

    def total(bs):
        extra = F.greatest(count_type(bs, "Heading") - count_type(bs, "Paragraph"), F.lit(0)) * 45
        return F.aggregate(bs, F.lit(0), lambda a, b: a + points(b)) - extra

    return let(blocks, lambda bs: F.when(F.size(bs) > 0, total(bs)).cast("double"))


def usable_site_set(blocks) -> Column:
    p, pc = count_type(blocks, "Paragraph"), block_chars(blocks, "Paragraph")
    return (
        ((p >= 3) & (pc >= 240)) | ((p >= 2) & (pc >= 120)) | ((p >= 1) & (pc >= 80))
        | (block_chars(blocks) >= 160)
    )


def site_rule_blocks() -> Column:
    """Blocks of the best container that one of the site rules selects."""

    def matches(e, rule):
        classes, kind, value = rule
        own = F.lit(True)
        for c in classes:
            own = own & has_class(e.cls, [c])
        if kind == "testid" and not classes:
            return own & e.testid.contains(value)
        if kind == "none":
            return own
        test = {
            "class": lambda a: has_class(a.cls, [value]),
            "testid": lambda a: a.testid.contains(value),
            "tag": lambda a: a.tag == value,
        }[kind]
        return own & F.exists("els2", lambda a: inside(e, a) & test(a))

    def any_rule(e):
        hit = F.lit(False)
        for rule in SITE_RULES:
            hit = hit | matches(e, rule)
        return hit

    hint = lambda e: e.cls.rlike("(?i)markup|post-content") | e.testid.contains("post-content")
    found = F.filter(F.filter("els2", hint), any_rule)
    sets = F.transform(
        found,
        lambda e, i: let(
            container_blocks(e, prune=False),
            lambda bs: F.struct(
                F.coalesce(block_set_score(bs), F.lit(-1e18)).alias("score"), (-i).alias("first"), bs.alias("blocks")
            ),
        ),
    )
    return F.coalesce(F.array_max(sets).blocks, F.array().cast(K.BLOCKS))


def prune_text(container) -> Column:
    """Whole text of a pruned container."""
    texts = F.filter("txt3", lambda t: (t.pos > container.open) & (t.pos < container.end))
    pruned = F.filter("pruned", lambda p: inside(p, container))
    return let(A.reach_of(pruned), lambda index: join_pieces(F.filter(texts, lambda t: ~A.reached(index, t.pos + 1, t.pos))))


def sentence_blocks(source) -> Column:
    parts = F.transform(F.split(source, r"(?<=[.!?])\s+"), lambda s, i: F.struct(i.alias("pos"), norm(s).alias("text")))
    usable = F.filter(parts, lambda p: usable_text(p.text, F.lit("p")))
    return F.transform(
        usable,
        lambda p: F.struct(
            p.pos.cast("int").alias("pos"), F.lit("Paragraph").alias("type"), p.text.alias("text")
        ),
    )


def tidy(blocks, ignored) -> Column:
    return K.fold_duplicates(K.strip_and_filter(blocks), col(ignored))


def needs_fallback(blocks, source) -> Column:
    n = F.length(source)
    return F.when(n == 0, F.size(blocks) == 0).otherwise(
        (F.size(blocks) == 0)
        | (
            (n >= FALLBACK_MIN_SOURCE)
            & ((count_type(blocks, "Paragraph") < 3) | (block_chars(blocks) < n * FALLBACK_RATIO))
        )
    )


def with_page_fields(pages: DataFrame) -> DataFrame:
    """Title, metadata and embedded texts, taken from the raw markup before it is split."""
    return (
        pages.withColumn("title", page_title("html", "url"))
        .withColumn("metadata", page_metadata("html", "title"))
        .withColumn("json_ld", json_ld_body("html"))
    )


def with_parts(pages: DataFrame) -> DataFrame:
    """Part 0 is the page, part 1 an embedded body; only part 0 carries the page fields."""
    parts = F.array(
        F.struct(F.lit(0).alias("part"), F.col("html").alias("html")),
        F.struct(F.lit(1).alias("part"), embedded_body_html("html").alias("html")),
    )
    fields = ["url", "title", "metadata", "json_ld"]
    rows = with_page_fields(pages).select("page_id", *fields, F.inline(parts))
    return rows.filter(F.col("html").isNotNull()).select(
        "page_id", "part", *[F.when(F.col("part") == 0, F.col(f)).alias(f) for f in fields], "html"
    )


def strategies(pages: DataFrame) -> DataFrame:
    """Page rows with ``sets``: every competing block list (name, rank, raw, cleaned blocks, score)."""
    df = prepare(with_parts(pages), "url", "title", "metadata", "json_ld")
    body = F.try_element_at(F.filter("els2", lambda e: e.tag == "body"), F.lit(1))
    own = F.when((F.col("part") == 1) & body.isNotNull(), container_blocks(body, prune=False))
    one_page = Window.partitionBy("page_id")
    df = df.withColumn("embedded", F.max(own).over(one_page)).filter(F.col("part") == 0)
    df = candidates(df)
    ignored = F.filter(
        F.concat(F.array(F.col("title")), F.col("metadata")), lambda t: F.trim(t) != ""
    )
    df = df.withColumn(
        "ignored", F.filter(F.transform(ignored, dedupe_key), lambda k: k != "")
    ).withColumn("_site_blocks", site_rule_blocks())
    # a page of a known layout may hold its text only in the embedded body
    df = df.withColumn(
        "site_blocks",
        F.when(usable_site_set(F.col("_site_blocks")), F.col("_site_blocks")).otherwise(
            F.coalesce(F.col("embedded"), F.col("_site_blocks"))
        ),
    )

    def named(name, rank, blocks):
        return F.struct(name.alias("name"), rank.alias("rank"), blocks.alias("raw"))

    raw = F.concat(
        F.array(named(F.lit("site_rule"), F.lit(0), F.col("site_blocks"))),
        F.transform(
            "chosen",
            lambda c, i: named(
                F.concat(F.lit("candidate_"), (i + 1).cast("string")), (i + 1).cast("int"), container_blocks(c)
            ),
        ),
        F.array(
            named(F.lit("title_anchored"), F.lit(6), title_anchored_blocks("title", "url")),
            named(
                F.lit("json_ld"),
                F.lit(7),
                F.when(F.col("json_ld").isNotNull(), structured_blocks("json_ld")).otherwise(
                    F.array().cast(K.BLOCKS)
                ),
            ),
            named(
                F.lit("embedded_body"), F.lit(8), F.coalesce(F.col("embedded"), F.array().cast(K.BLOCKS))
            ),
        ),
    )
    df = df.withColumn("_raw", raw)
    scored = F.transform(
        F.transform("_raw", lambda s: s.withField("blocks", tidy(s.raw, "ignored"))),
        lambda s: s.withField(
            "score", block_set_score(F.when(s["name"] == "site_rule", s.raw).otherwise(s.blocks))
        ),
    )
    df = df.withColumn("_scored", scored)
    strong = lambda s: (count_type(s.blocks, "Paragraph") >= STRONG_PARAGRAPHS) & (
        block_chars(s.blocks) >= STRONG_CHARS
    )
    eligible = lambda s: F.when(s["name"] == "site_rule", usable_site_set(s.raw)).when(
        s["name"].startswith("candidate"), F.size(s.blocks) > 0
    ).otherwise(strong(s))
    df = df.withColumn("sets", F.filter("_scored", eligible))
    return df.drop("_raw", "_scored", "_site_blocks")


def choose(df: DataFrame) -> DataFrame:
    """Winning strategy per page: a usable site rule, else the best score (first added wins a tie)."""
    site = F.filter("sets", lambda s: s["name"] == "site_rule")
    best = F.array_max(
        F.transform(
            F.filter("sets", lambda s: s["name"] != "site_rule"),
            lambda s: F.struct(
                s.score.alias("score"), (-s.rank).alias("first"), s["name"].alias("name"), s.blocks.alias("blocks")
            ),
        )
    )
    df = df.withColumn("_best", best).withColumn("_site", F.try_element_at(site, F.lit(1)))
    from_site = F.col("_site").isNotNull()
    df = df.withColumn(
        "strategy",
        F.when(from_site, "site_rule").otherwise(F.coalesce(F.col("_best.name"), F.lit("empty"))),
    ).withColumn(
        "picked",
        F.when(from_site, F.col("_site.blocks")).otherwise(
            F.coalesce(F.col("_best.blocks"), F.array().cast(K.BLOCKS))
        ),
    )
    source = F.when(F.size("chosen") > 0, prune_text(F.col("chosen")[0])).otherwise("")
    return df.withColumn("source_text", source).drop("_best", "_site")


def extract_pages(pages: DataFrame) -> DataFrame:
    """One document row per page: title, metadata, blocks, strategy and counts."""
    df = choose(strategies(pages))
    df = df.withColumn(
        "fallback",
        (F.col("strategy") != "site_rule") & needs_fallback(F.col("picked"), F.col("source_text")),
    )
    df = df.withColumn(
        "raw_blocks",
        F.when(F.col("fallback"), tidy(sentence_blocks(F.col("source_text")), "ignored")).otherwise(
            F.col("picked")
        ),
    )
    df = df.withColumn("strategy", F.when(F.col("fallback"), "sentence_fallback").otherwise(F.col("strategy")))
    final = F.when(F.col("strategy") == "site_rule", F.col("raw_blocks")).otherwise(
        tidy("raw_blocks", "ignored")
    )
    df = df.withColumn("blocks", final)
    return df.select(
        "page_id",
        "url",
        "title",
        "metadata",
        "strategy",
        "fallback",
        "sets",
        "ranked",
        "raw_blocks",
        "blocks",
        count_type(F.col("blocks"), "Paragraph").alias("n_paragraphs"),
        count_type(F.col("blocks"), "Heading").alias("n_headings"),
        block_chars(F.col("blocks")).alias("n_chars"),
    )


# ----- links ----------------------------------------------------------------------------
def absolute_url(base, href) -> Column:
    """href resolved against the page url: full, protocol-relative, rooted, query, fragment or relative."""
    base, href = col(base), col(href)
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    scheme = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    clean = F.regexp_extract(base, "^[^?#]*", 0)
    folder = F.regexp_extract(clean, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]+.*/)", 1)
    folder = F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder)
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(clean, href))
        .otherwise(F.concat(folder, href))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, label, href): live links with a label, distinct per page."""
    df = page_elements(pages, "url")
    links = F.transform(
        F.filter("els", lambda e: e.tag == "a"),
        lambda e: F.struct(e.open.alias("pos"), join_pieces(pieces(e)).alias("label"), e.href.alias("href")),
    )
    named = F.filter(links, lambda x: (x.label != "") & (x.href != ""))
    return K.explode_rows(df, named, "page_id", "url").groupBy(
        "page_id", "label", absolute_url("url", "href").alias("href")
    ).agg(F.min("pos").alias("pos"))
