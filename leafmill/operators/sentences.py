"""Sentences, citations, sections and extracts over document blocks.

Input documents carry ``blocks ARRAY<STRUCT<pos, type, text>>``; every operator is an
expression inside the row, so none of them shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import col, collapse, let
from leafmill.operators.blocks import explode_rows

# --- fixed values: sentence boundaries, citations, sections ---
MAX_SENTENCE = 260
SHIELD = "․"
REFERENCE_HEADINGS = [
    "references", "reference list", "bibliography", "works cited", "citations",
    "references and notes", "notes and references", "literature cited",
]
# the dot stands first: what is before it is looked at only where there is one, not at every character
SHIELD_STEPS = [
    r"\.(?<=(?<![\p{L}\d])(?:[A-Z][.․]){1,12}[A-Z]\.)(?=(?:[A-Z][.․])*+(?![\p{L}\d]))",
    r"\.(?<=(?<![\p{L}\d])[A-Z]\.)(?=(?:[A-Z][.․])++(?![\p{L}\d]))",
    r"(?i)\.(?<=(?<![\p{L}\d])e\.)(?=g\.(?![\p{L}\d]))",
    r"(?i)\.(?<=(?<![\p{L}\d])i\.)(?=e\.(?![\p{L}\d]))",
    r"(?i)\.(?<=(?<![\p{L}\d])(?:e․g|i․e|etc|mr|mrs|ms|dr|prof|sr|jr|vs|no)\.)(?![\p{L}\d])",
]
YEAR = r"\b(?:19|20)\d{2}[a-z]?\b"
AUTHOR_YEAR = (
    r"\b[A-Z][A-Za-z'`\-]+(?:\s+(?:and|&)\s+[A-Z][A-Za-z'`\-]+)?(?:\s+et al\.?)?(?:,\s*|\s+)(?:19|20)\d{2}[a-z]?\b"
)
SUPERSCRIPTS = r"[¹²³⁰⁴-⁹](?<=[\p{L}\]).,;:!?][¹²³⁰⁴-⁹])[¹²³⁰⁴-⁹]*"
REFERENCE_ID = r"[\p{L}\d+]*\d[\p{L}\d+]*"
BRACKET_LIST = rf"\[\s*{REFERENCE_ID}(?:\s*[-,;–—]\s*{REFERENCE_ID})*\s*\]"
NUMBER_LIST = r"\(\s*\d{1,3}(?:\s*[-,;–—]\s*\d{1,3})*\s*\)"
CITATION_PARENS = (
    rf"\((?=[^()]*{YEAR})(?:(?=[^()]*(?i:et al))|(?=\s*(?i:see |cf |cf\. |e\.g\. |i\.e\. |compare |contra ))"
    rf"|(?=[^()]*;)|(?=[^()]*{AUTHOR_YEAR})|(?=[^()]*{YEAR}[^()]*{YEAR}))[^()]*\)"
)
INLINE_AUTHOR_YEAR = (
    r"\b[A-Z][A-Za-z'`\-]+(?:\s+(?:and|&)\s+[A-Z][A-Za-z'`\-]+)?(?:\s+et al\.)?,\s*(?:19|20)\d{2}[a-z]?\b"
)
INLINE_PARENS = (
    rf"\((?=[^()]*{YEAR})(?:(?=[^()]*(?i:et al))|(?=[^()]*;)|(?=[^()]*{INLINE_AUTHOR_YEAR})"
    rf"|(?=[^()]*{YEAR}[^()]*{YEAR}))[^()]*\)"
)
INLINE_NUMBERS = r"\[\s*\d+(?:\s*[-,;–—]\s*\d+)*\s*\]"
CONCLUSION_WORDS = ["conclusion", "discussion", "final remarks", "closing"]
# first rule wins where two match at one place
ABBREVIATIONS = [
    (r"mr\.", "Mister"), (r"mrs\.", "Misses"), (r"ms\.", "Miss"), (r"dr\.", "Doctor"),
    (r"prof\.", "Professor"), (r"u\.s\.(?:a\.)?", "United States"), (r"u\.k\.", "United Kingdom"),
    (r"e\.u\.", "European Union"), (r"u\.n\.", "United Nations"), (r"e\.g\.", "for example"),
    (r"i\.e\.", "that is"), (r"etc\.", "et cetera"), (r"ph\.d\.", "P H D"), (r"m\.d\.", "M D"),
]
ACRONYM = r"(?:[A-Z]\.){2,}"

SPANS = "struct<at:int,out:array<struct<s:int,e:int>>>"


def shield(c) -> Column:
    """Dots of abbreviations and dotted acronyms become a look-alike; length is unchanged."""
    c = col(c)
    for pattern in SHIELD_STEPS:
        c = F.regexp_replace(c, pattern, SHIELD)
    return c


def spans(text: Column, stops: str, base: Column) -> Column:
    """(s, e) offsets of the non-blank runs that end at a stop character."""
    parts = F.regexp_extract_all(text, F.lit(f"[^{stops}]+[{stops}]?|[{stops}]"), F.lit(0))

    def step(acc, p):
        lead = F.length(p) - F.length(F.ltrim(p))
        kept = (F.trim(p) != "") & ~p.rlike(f"^[{stops}]$")
        here = F.struct(
            (acc.at + lead).cast("int").alias("s"), (acc.at + F.length(F.rtrim(p))).cast("int").alias("e")
        )
        return F.struct(
            (acc.at + F.length(p)).cast("int").alias("at"),
            F.when(kept, F.concat(acc.out, F.array(here))).otherwise(acc.out).alias("out"),
        )

    start = F.struct(base.cast("int").alias("at"), F.array().alias("out")).cast(SPANS)
    return F.aggregate(parts, start, step).out


def slice_of(text, s) -> Column:
    return F.substr(text, s.s + 1, s.e - s.s)


def chunked(text: Column, s: Column) -> Column:
    """Fixed-length parts of one span, trimmed; the end never passes the span."""
    starts = F.sequence(s.s, s.e - 1, F.lit(MAX_SENTENCE))

    def part(at):
        body = F.trim(F.substr(text, at + 1, F.least(F.lit(MAX_SENTENCE), s.e - at)))
        return F.struct(
            at.cast("int").alias("s"), F.least(at + F.length(body), s.e).cast("int").alias("e"), body.alias("text")
        )

    return F.filter(F.transform(starts, part), lambda p: p.text != "")


def whole(text: Column, s: Column) -> Column:
    return F.array(F.struct(s.s.alias("s"), s.e.alias("e"), slice_of(text, s).alias("text")))


def sentence_slices(text) -> Column:
    """Sentences of one paragraph as (s, e, text); long ones split at clauses, then by length."""

    def split_long(t, s):
        def by_clause(clauses):
            return F.when(F.size(clauses) <= 1, chunked(t, s)).otherwise(
                F.flatten(
                    F.transform(
                        clauses,
                        lambda c: F.when(c.e - c.s > MAX_SENTENCE, chunked(t, c)).otherwise(whole(t, c)),
                    )
                )
            )

        return F.when(
            s.e - s.s > MAX_SENTENCE, let(spans(slice_of(t, s), ",;:", s.s), by_clause)
        ).otherwise(whole(t, s))

    return let(
        collapse(text),
        lambda t: F.flatten(F.transform(spans(shield(t), ".!?", F.lit(0)), lambda s: split_long(t, s))),
    )


def sentences_only(text) -> Column:
    """Sentences before any length split."""
    return let(
        collapse(text),
        lambda t: F.transform(
            spans(shield(t), ".!?", F.lit(0)),
            lambda s: F.struct(s.s.alias("s"), s.e.alias("e"), slice_of(t, s).alias("text")),
        ),
    )


def strip_citations(c) -> Column:
    """Remove superscript, bracketed, numeric and author-year citations; empty when no letter is left."""
    t = F.regexp_replace(col(c), SUPERSCRIPTS, "")
    t = F.regexp_replace(t, BRACKET_LIST, " ")
    t = F.regexp_replace(t, NUMBER_LIST, " ")
    t = F.regexp_replace(t, CITATION_PARENS, " ")
    t = F.regexp_replace(t, r"\s+([,.;:!?])", "$1")
    t = F.regexp_replace(t, r"([,.;:!?])(?:\s*[,.;:!?])+", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"\(\s*\)", ""), r"\[\s*\]", "")
    t = F.trim(F.regexp_replace(t, r"\s{2,}", " "))
    return let(t, lambda x: F.when(x.rlike(r"[\p{L}\p{Nd}]"), x).otherwise(""))


def is_reference_heading(c) -> Column:
    t = F.regexp_replace(F.lower(col(c)), r"^[0-9ivxlcdm.\-\s]+", "")
    return collapse(F.regexp_replace(t, r"[^a-z\s]", " ")).isin(REFERENCE_HEADINGS)


def before_back_matter(blocks) -> Column:
    """Blocks in front of the first references heading; headings and paragraphs after it go."""
    blocks = col(blocks)
    marks = F.transform(blocks, lambda b: (b.type == "Heading") & is_reference_heading(b.text))
    cut = F.array_position(marks, F.lit(True))
    return F.when(cut > 0, F.slice(blocks, F.lit(1), (cut - 1).cast("int"))).otherwise(blocks)


def segments(blocks) -> Column:
    """Reading segments (block, s, e, text): headings whole with a full stop, paragraphs by sentence."""

    def of_block(b):
        heading = F.array(
            F.struct(
                b.pos.cast("int").alias("block"), F.lit(0).alias("s"), F.length(b.text).alias("e"),
                F.concat(b.text, F.lit(".")).alias("text"),
            )
        )
        body = F.filter(
            F.transform(
                sentence_slices(b.text),
                lambda s: F.struct(
                    b.pos.cast("int").alias("block"), s.s.alias("s"), s.e.alias("e"), strip_citations(s.text).alias("text")
                ),
            ),
            lambda s: s.text != "",
        )
        empty = F.slice(heading, 1, 0)
        return (
            F.when((b.type == "Heading") & (F.trim(b.text) != ""), heading)
            .when(b.type == "Paragraph", body)
            .otherwise(empty)
        )

    return F.flatten(F.transform(before_back_matter(blocks), of_block))


def citation_spans(text) -> Column:
    """Distinct (s, e) of numeric brackets and year parentheticals, e exclusive, by start."""

    def positions(t, pattern):
        # lengths of the text between matches give the offsets
        marked = F.regexp_extract_all(t, F.lit(rf"(?s)(?:{pattern})|.+?(?={pattern}|$)"), F.lit(0))
        start = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(SPANS)

        def step(acc, p):
            hit = p.rlike(rf"^(?:{pattern})$")
            here = F.struct(acc.at.alias("s"), (acc.at + F.length(p)).cast("int").alias("e"))
            return F.struct(
                (acc.at + F.length(p)).cast("int").alias("at"),
                F.when(hit, F.concat(acc.out, F.array(here))).otherwise(acc.out).alias("out"),
            )

        return F.aggregate(marked, start, step).out

    return let(
        col(text),
        lambda t: F.when(
            t.rlike(r"[\[(]"),
            F.array_sort(F.array_distinct(F.concat(positions(t, INLINE_NUMBERS), positions(t, INLINE_PARENS)))),
        ).otherwise(F.array().cast("array<struct<s:int,e:int>>")),
    )


def section_of(blocks, title, chars: int | None = None) -> Column:
    """Blocks with ``section``: the last heading at or before the block, else the title; whole, or the first ``chars``
    characters if a number is given."""
    name = lambda text: F.substring(collapse(text), 1, chars) if chars else collapse(text)
    start = F.struct(
        name(title).alias("now"), F.array().alias("out")
    ).cast("struct<now:string,out:array<struct<pos:int,type:string,section:string>>>")

    def step(acc, b):
        now = F.when(b.type == "Heading", name(b.text)).otherwise(acc.now)
        return F.struct(
            now.alias("now"),
            F.concat(
                acc.out, F.array(F.struct(b.pos.alias("pos"), b.type.alias("type"), now.alias("section")))
            ).alias("out"),
        )

    return F.aggregate(col(blocks), start, step).out


def is_conclusion(c) -> Column:
    t = collapse(F.regexp_replace(F.lower(col(c)), r"[^a-z\s]", " "))
    return t.rlike("|".join(CONCLUSION_WORDS))


def skim_extract(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, label, text): opening, lead-ins, headings, key passages and the closing."""
    # section number, conclusion flag and paragraph rank come from one pass over the blocks
    start = F.struct(
        F.lit(0).alias("section"), F.lit(False).alias("ending"), F.lit(0).alias("rank"), F.lit(0).alias("n"),
        F.array().alias("out"),
    ).cast(
        "struct<section:int,ending:boolean,rank:int,n:int,"
        "out:array<struct<pos:int,type:string,text:string,section:int,ending:boolean,rank:int,n:int>>>"
    )

    def step(acc, b):
        heading, para = b.type == "Heading", b.type == "Paragraph"
        section = F.when(heading, acc.section + 1).otherwise(acc.section).cast("int")
        ending = F.when(heading, is_conclusion(b.text)).otherwise(acc.ending)
        rank = F.when(heading, 0).when(para, acc.rank + 1).otherwise(acc.rank).cast("int")
        n = F.when(para, acc.n + 1).otherwise(acc.n).cast("int")
        row = F.struct(
            b.pos.alias("pos"), b.type.alias("type"), b.text.alias("text"), section.alias("section"),
            ending.alias("ending"), rank.alias("rank"), n.alias("n"),
        )
        return F.struct(
            section.alias("section"), ending.alias("ending"), rank.alias("rank"), n.alias("n"),
            F.concat(acc.out, F.array(row)).alias("out"),
        )

    df = df.withColumn("_run", F.aggregate("blocks", start, step))

    def label(b):
        heading, para = b.type == "Heading", b.type == "Paragraph"
        total, any_heading = F.col("_run.n"), F.col("_run.section") > 0
        closing = para & (b.n == total)
        flat = F.when(para & (b.n == 1), "Opening").when(para & (b.n <= 4), "Key passage").when(closing, "Closing")
        deep = (
            F.when(heading, "Heading")
            .when(para & (b.section == 0) & (b.n == 1), "Opening")
            .when(para & (b.section == 0) & (b.n == 2), "Lead-in")
            .when(para & (b.section > 0) & (b.rank == 1), "Key passage")
            .when(para & (b.section > 0) & (b.rank == 2) & b.ending, "Closing")
            .when(closing, "Closing")
        )
        return F.when(any_heading, deep).otherwise(flat)

    rows = F.filter(
        F.transform(
            "_run.out", lambda b: F.struct(b.pos.alias("pos"), label(b).alias("label"), b.text.alias("text"))
        ),
        lambda r: r.label.isNotNull(),
    )
    return explode_rows(df, rows, *keys)


def summary_source(blocks) -> Column:
    """Paragraphs joined by newlines, the first one after a heading prefixed with it."""
    start = F.struct(F.lit(None).cast("string").alias("head"), F.array().alias("out")).cast(
        "struct<head:string,out:array<string>>"
    )

    def step(acc, b):
        t = collapse(b.text)
        line = F.when(acc.head.isNotNull(), F.concat(F.lit("["), acc.head, F.lit("] "), t)).otherwise(t)
        heading, para = (b.type == "Heading") & (t != ""), (b.type == "Paragraph") & (t != "")
        return F.struct(
            F.when(heading, t).when(para, F.lit(None)).otherwise(acc.head).alias("head"),
            F.when(para, F.concat(acc.out, F.array(line))).otherwise(acc.out).alias("out"),
        )

    return F.trim(F.array_join(F.aggregate(col(blocks), start, step).out, "\n"))


# ----- abbreviations --------------------------------------------------------------------
def _guarded(pattern: str) -> str:
    return rf"(?<![\p{{L}}\d]){pattern}(?![\p{{L}}\d])"


ANY_ABBREVIATION = (
    _guarded("(?i:" + "|".join(p for p, _ in ABBREVIATIONS) + ")") + "|" + _guarded(ACRONYM)
)


def spoken_form(token) -> Column:
    """How an abbreviation is read; other dotted acronyms are spelled out."""
    out = None
    for pattern, spoken in ABBREVIATIONS:
        test = token.rlike(f"(?i)^{pattern}$")
        out = F.when(test, spoken) if out is None else out.when(test, spoken)
    letters = F.regexp_replace(token, r"[^\p{L}\p{Nd}]", "")
    return out.otherwise(F.trim(F.regexp_replace(letters, "(.)", "$1 ")))


def offset_map(text) -> Column:
    """Runs (spoken_s, spoken_e, s, e, replaced, piece) of the expanded text, in order."""
    parts = F.regexp_extract_all(
        col(text), F.lit(rf"(?s)(?:{ANY_ABBREVIATION})|.+?(?=(?:{ANY_ABBREVIATION})|$)"), F.lit(0)
    )
    run = "struct<spoken_s:int,spoken_e:int,s:int,e:int,replaced:boolean,piece:string>"
    start = F.struct(F.lit(0).alias("sp"), F.lit(0).alias("at"), F.array().alias("out")).cast(
        f"struct<sp:int,at:int,out:array<{run}>>"
    )

    def step(acc, p):
        hit = p.rlike(rf"^(?:(?i:{'|'.join(a for a, _ in ABBREVIATIONS)})|{ACRONYM})$")
        piece = F.when(hit, spoken_form(p)).otherwise(p)
        sp = (acc.sp + F.length(piece)).cast("int")
        at = (acc.at + F.length(p)).cast("int")
        here = F.struct(
            acc.sp.alias("spoken_s"), sp.alias("spoken_e"), acc.at.alias("s"), at.alias("e"),
            hit.alias("replaced"), piece.alias("piece"),
        )
        return F.struct(sp.alias("sp"), at.alias("at"), F.concat(acc.out, F.array(here)).alias("out"))

    return F.aggregate(parts, start, step).out


def spoken_text(runs) -> Column:
    return F.array_join(F.transform(runs, lambda r: r.piece), "")


def to_original(runs, offset, prefer_end: bool = False) -> Column:
    """Offset in the expanded text back to the original: linear in plain runs, proportional in replaced ones."""
    offset = F.greatest(col(offset), F.lit(0))
    hit = F.filter(col(runs), lambda r: (offset >= r.spoken_s) & (offset <= r.spoken_e))
    run = F.coalesce(F.try_element_at(hit, F.lit(1)), F.try_element_at(col(runs), F.lit(-1)))

    def back(r):
        linear = r.s + F.greatest(offset - r.spoken_s, F.lit(0))
        ratio = (offset - r.spoken_s) / F.greatest(r.spoken_e - r.spoken_s, F.lit(1))
        scaled = ratio * F.greatest(r.e - r.s, F.lit(1))
        projected = r.s + (F.ceil(scaled) if prefer_end else F.floor(scaled)).cast("int")
        at = F.when(r.replaced, projected).otherwise(linear)
        return F.least(F.greatest(at, r.s), r.e)

    return let(run, back)


# ----- authors, listing text -------------------------------------------------------------
# --- fixed values: words that no author line has ---
AUTHOR_STOP_WORDS = [
    "@", "university", "institute", "department", "school of", "faculty", "laboratory",
    "center for", "centre for", "published", "doi", "arxiv", "preprint", "abstract", "keywords",
    "copyright",
]


def first_author(lines) -> Column:
    """First metadata line that yields an author: 'by X', else a line that starts with a personal name."""

    def first_part(t):
        parts = F.transform(
            F.split(F.regexp_replace(t, r"(?i)\bet al\.\b", ""), r"(?i)\s*(?:,|;|\band\b|&)\s*"), F.trim
        )
        return F.try_element_at(F.filter(parts, lambda p: p != ""), F.lit(1))

    def personal(n):
        ws = F.transform(F.split(n, r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;]+|[.,;]+$", ""))
        return (
            F.length(n).between(4, 60)
            & ~n.rlike("[@:]")
            & F.size(ws).between(2, 5)
            & F.forall(ws, lambda w: w.rlike(r"^\p{Lu}"))
        )

    def of_line(t):
        byline = t.rlike("(?i)^by .+$")
        named = let(first_part(t), lambda n: F.when(personal(n), n))
        blocked = F.lower(t).rlike("|".join(AUTHOR_STOP_WORDS))
        return F.when(byline, first_part(F.regexp_replace(t, r"(?i)^by\s+", ""))).when(~blocked, named)

    found = F.filter(F.transform(F.transform(col(lines), collapse), of_line), lambda a: a.isNotNull())
    return F.try_element_at(found, F.lit(1))


def listing_text(blocks, title, source, chars: int | None = None) -> Column:
    """First paragraph, else the first heading that is not the title, else a name for the source.

    That is: a fixed one for captured text and device content, host and last path segment of a web address, the last
    path segment of a file or any other label.  ``chars`` cuts the text if a number is given.
    """
    from leafmill.functions.text import url_path

    blocks = col(blocks)
    para = F.try_element_at(F.filter(blocks, lambda b: b.type == "Paragraph"), F.lit(1)).text
    head = F.try_element_at(
        F.filter(blocks, lambda b: (b.type == "Heading") & (F.lower(b.text) != F.lower(col(title)))), F.lit(1)
    ).text
    segment = F.regexp_extract(url_path(source), r"([^/]+)/?$", 1)
    host = F.try_parse_url(col(source), F.lit("HOST"))
    web = F.concat(
        F.coalesce(host, F.lit("Web paper")),
        F.when(
            (segment != "") & (F.lower(segment) != F.lower(col(title))), F.concat(F.lit(" • "), segment)
        ).otherwise(""),
    )
    plain = F.substring_index(col(source), "/", -1)
    file = F.coalesce(F.try_url_decode(segment), segment)
    local = F.lit("Local PDF file")
    fallback = (
        F.when(col(source).startswith("captured-text:"), F.lit("Captured text"))
        .when(col(source).rlike("^https?://"), web)
        .when(col(source).startswith("content://"), local)
        .when(col(source).startswith("file://"), F.coalesce(F.nullif(file, F.lit("")), local))
        .otherwise(F.when(F.trim(plain) != "", plain).otherwise(local))
    )
    text = F.coalesce(F.nullif(collapse(para), F.lit("")), F.nullif(collapse(head), F.lit("")), fallback)
    return F.substring(text, 1, chars) if chars else text


# ----- url mentions ----------------------------------------------------------------------
FULL_URL = r"""(?i)https?://[^\s<>"'()]+"""
BARE_DOMAIN = r"""(?i)\b(?:[a-z0-9-]+\.)+[a-z]{2,}(?:/[^\s<>"']*)?"""


def url_mentions(c) -> Column:
    """Full urls without trailing punctuation; only if there is none, bare domains with https in front."""

    def tidy(u):
        return F.regexp_replace(u, r"[.,;:!?)\]}]+$", "")

    full = F.transform(F.regexp_extract_all(col(c), F.lit(FULL_URL), F.lit(0)), tidy)
    bare = F.transform(
        F.regexp_extract_all(col(c), F.lit(BARE_DOMAIN), F.lit(0)),
        lambda u: F.concat(F.lit("https://"), tidy(u)),
    )
    return let(full, lambda f: F.when(F.size(f) > 0, f).otherwise(bare))


