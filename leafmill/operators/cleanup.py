"""Model clean-up batches: eligibility, packing, prompts, validation, application, diagnostics.

The model itself is a caller's function (``run_cleaner``).  Chunks and their validation
stay inside the document or chunk row; only applying rewrites and the roll-ups exchange
data, on fine keys or after partial aggregation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.rules import any_of
from leafmill.functions.text import col, collapse, contains_any, count_of, let, n_contained, strings
from leafmill.operators.blocks import explode_rows

# --- fixed values: clean-up profiles, tokens, lists ---
PROMPT_VERSION = 11
SUMMARY_PROMPT_VERSION = 2
BREAK = "<PARAGRAPH_BREAK>"
DROP = "<DROP_PARAGRAPH>"


@dataclass(frozen=True)
class Profile:
    """Limits of one kind of document; shares are in hundredths."""

    name: str
    min_chars: int
    max_chars: int
    chunk_chars: int
    chunk_paragraphs: int
    min_ratio: float
    max_ratio: float
    min_paragraph_ratio: float
    max_paragraph_ratio: float
    keep_tokens: int
    keep_paragraph_tokens: int
    keep_content: int
    allow_drop: bool


WEB = Profile("WEB", 16, 2200, 1100, 3, 0.38, 1.20, 0.42, 1.25, 54, 50, 68, True)
PDF = Profile("PDF", 24, 2600, 1300, 3, 0.40, 1.12, 0.45, 1.15, 56, 52, 70, False)
PROFILES = {"WEB": WEB, "PDF": PDF}

CODE_MARKS = ["```", "</", "/>", " = ", "{", "}"]
# one of these signs is in every code mark, one of these runs is every mathematical one: most texts are read by the hint only
CODE_HINT = "[`<=>{}]"
MATH_HINT = " [=+×÷∈≤≥-] |→"
MATH_MARKS = [" = ", " + ", " - ", " × ", " ÷ ", " ∈ ", " ≤ ", " ≥ ", "→"]
SUSPICIOUS = ["```", "# ", "here is the cleaned text", "- "]
IGNORED_IMPORTANT = [
    "share", "comments", "comment", "print", "email", "copy", "link", "facebook", "twitter",
    "linkedin", "reddit", "whatsapp", "telegram", "safeframe", "container", "advertisement",
    "adchoices", "related", "the", "this", "that", "these", "those",
]
IGNORED_PROTECTED = [
    "a", "an", "and", "as", "at", "be", "but", "by", "for", "from", "if", "in", "into", "is", "it",
    "its", "of", "on", "or", "so", "than", "that", "the", "their", "there", "these", "this",
    "those", "to", "was", "we", "were", "while", "with", "you", "your", "after", "before",
    "during", "when", "where", "why", "how", "however", "meanwhile", "although", "because",
    "since", "today", "tomorrow", "yesterday", "share", "comments", "comment", "print", "email",
    "copy", "link", "facebook", "twitter", "linkedin", "reddit", "whatsapp", "telegram",
    "safeframe", "container", "related", "latest", "read", "more", "photo", "photos", "image",
    "images", "credit", "credits", "caption", "captions", "source", "sources", "advertisement",
    "adchoices", "newsletter", "subscribe",
]
STOP_WORDS = [
    "the", "and", "that", "with", "from", "this", "have", "were", "their", "there", "about",
    "into", "after", "before", "while", "when", "where", "which", "would", "could", "should",
    "because", "these", "those", "your", "article", "button", "share", "comment", "comments",
    "photo", "credit", "related", "links", "safeframe", "container", "print", "email", "facebook",
    "twitter", "linkedin", "reddit", "whatsapp", "telegram", "newsletter", "subscribe",
    "copyright", "reserved", "publisher", "footer", "boilerplate", "promo", "promoted", "advert",
    "advertisement", "sponsored", "label",
]
MARKERS = {
    "WEB": [
        "share", "comments", "all rights reserved", "related links", "photo credit", "copyright",
        "follow us",
    ],
    "PDF": ["arxiv:", "accepted for", "page ", "copyright", "all rights reserved"],
}
WORD_RUN = r"\d[\d,.:/%-]*\d|[\p{L}\p{N}_]+"
IMPORTANT = r"^(?:[A-Z][a-z]+|[A-Z]{2,}|\d[\d,.:/%-]*)$"
# a run of WORD_RUN of two characters or more that is IMPORTANT; other runs and what is between them are passed over
WHOLE_RUN = r"\d[\d,.:/%-]*\d|(?:[A-Z][a-z]++|[A-Z]{2,}+)(?![\p{L}\p{N}_])"
IMPORTANT_RUN = rf"\G(?:(?!{WHOLE_RUN})[\p{{L}}\p{{N}}_]++|[^\p{{L}}\p{{N}}_])*+({WHOLE_RUN})"
NAME_RUN = r"[\p{L}\p{N}_'’.\-]+"
# a run of NAME_RUN with a capital in it, as every PROTECTED word has
CAPITAL_RUN = r"(?<![\p{L}\p{N}_'’.\-])[\p{L}\p{N}_'’.\-&&[^A-Z]]*+[A-Z][\p{L}\p{N}_'’.\-]*+"
PROTECTED = (
    r"^(?:[A-Z][\p{L}\p{N}'’.\-]{2,}|[\p{L}\p{N}'’.\-]*[A-Z][\p{Ll}\p{N}'’.\-]+[A-Z][\p{L}\p{N}'’.\-]*)$"
)
CONTENT_RUN = r"[\p{L}\p{N}][\p{L}\p{N}'’\-]*[\p{L}\p{N}]"
# of three characters or more
LONG_RUN = r"[\p{L}\p{N}][\p{L}\p{N}'’\-]+[\p{L}\p{N}]"
CITATION_LIST = r"\s*\d{1,3}\s*(?:[,–;\-]\s*\d{1,3}\s*)*"
CITATION_MARK = (
    r"\[\s*\d{1,3}(?:\s*[,–;\-]\s*\d{1,3})*\]|\(\s*\d{1,3}(?:\s*[,–;\-]\s*\d{1,3})*\)|[¹²³⁰-⁹]+"
)
ARXIV_LINE = r"(?i)\barxiv:\d{4}\.\d{4,5}(?:v\d+)?\s+\[[^\]]+\]\s+\d{1,2}\s+[a-z]{3}\s+\d{4}\b"
HEADER_RUN = r"\b\d+\s+[A-Z][A-Z]+(?:\s+[A-Z][A-Z]+){1,12}\b"
REASONS = [
    "empty_output", "paragraph_count_mismatch", "paragraph_drop_not_allowed",
    "blank_combined_output", "length_ratio_out_of_range", "suspicious_formatting",
    "important_token_loss", "blank_paragraph", "paragraph_length_out_of_range",
    "paragraph_token_loss", "paragraph_content_loss", "unexpected_duplication",
]
MODEL_FAILURE = "model_failure"


def paragraph(c) -> Column:
    return collapse(c)


def eligible(c, profile: Profile) -> Column:
    c = col(c)
    plain = lambda n: F.length(F.regexp_replace(c, r"[^\p{L}\p{Nd}]+", "")) >= n * 0.45
    ok = (
        ~(c.rlike(CODE_HINT) & contains_any(c, CODE_MARKS))
        & let(F.length(c), lambda n: n.between(profile.min_chars, profile.max_chars) & plain(n))
    )
    if profile.name == "PDF":
        ok = (
            ok
            & ~c.rlike(r"(?i)^(?:figure|table|algorithm|appendix)\s+\d")
            & ~c.rlike(r"^\s*(?:\[\d+\]|\d+\.)\s+[A-Z]")
            & ~(c.rlike(MATH_HINT) & (n_contained(c, MATH_MARKS) >= 3))
        )
    return ok


def with_eligibility(blocks, profile: Profile) -> Column:
    """Blocks as (type, text, ok): text normalised, ok for eligible paragraphs."""
    items = F.transform(
        col(blocks), lambda b: F.struct(b.type.alias("type"), paragraph(b.text).alias("text"))
    )
    return F.transform(
        items, lambda b: b.withField("ok", (b.type == "Paragraph") & eligible(b.text, profile))
    )


CHUNK = "struct<idx:array<int>,paras:array<string>>"


def pack(items, max_paragraphs: int, max_chars: int) -> Column:
    """Greedy packing of consecutive eligible paragraphs; any limits.

    A chunk closes at a block that is not eligible, at ``max_paragraphs``, or when the next
    paragraph would pass ``max_chars``.
    """
    start = F.struct(
        F.array().alias("idx"), F.array().alias("paras"), F.lit(0).alias("chars"), F.array().alias("out")
    ).cast(f"struct<idx:array<int>,paras:array<string>,chars:int,out:array<{CHUNK}>>")
    numbered = F.transform(items, lambda b, i: b.withField("i", i.cast("int")))

    def closed(acc):
        chunk = F.struct(acc.idx.alias("idx"), acc.paras.alias("paras"))
        return F.when(F.size(acc.idx) > 0, F.concat(acc.out, F.array(chunk))).otherwise(acc.out)

    def step(acc, b):
        n = F.length(b.text)
        full = (F.size(acc.idx) > 0) & ((F.size(acc.idx) >= max_paragraphs) | (acc.chars + n > max_chars))
        one_i, one_p = F.array(b.i), F.array(b.text)
        fresh = F.struct(
            one_i.alias("idx"), one_p.alias("paras"), n.cast("int").alias("chars"), closed(acc).alias("out")
        )
        grown = F.struct(
            F.concat(acc.idx, one_i).alias("idx"), F.concat(acc.paras, one_p).alias("paras"),
            (acc.chars + n).cast("int").alias("chars"), acc.out.alias("out"),
        )
        emptied = F.struct(
            F.slice(acc.idx, 1, 0).alias("idx"), F.slice(acc.paras, 1, 0).alias("paras"),
            F.lit(0).alias("chars"), closed(acc).alias("out"),
        )
        return F.when(~b.ok, emptied).when(full, fresh).otherwise(grown)

    return let(F.aggregate(numbered, start, step), closed)


def cleanup_chunks(docs: DataFrame, profile: Profile, blocks: str = "blocks") -> DataFrame:
    """One row per chunk: doc_id, chunk, idx, paras, before, after (read-only context)."""
    df = docs.withColumn("_items", with_eligibility(blocks, profile))

    def context(i):
        b = F.get("_items", i)
        return F.when(b.ok, b.text)

    rows = F.transform(
        pack(F.col("_items"), profile.chunk_paragraphs, profile.chunk_chars),
        lambda c, n: F.struct(
            n.cast("int").alias("chunk"), c.idx.alias("idx"), c.paras.alias("paras"),
            context(c.idx[0] - 1).alias("before"),
            context(F.element_at(c.idx, -1) + 1).alias("after"),
        ),
    )
    keys = [c for c in ("doc_id", "source", "lang") if c in docs.columns]
    return explode_rows(df, rows, *keys).withColumn("profile", F.lit(profile.name))


# ----- prompts and responses ---------------------------------------------------------------
INSTRUCTIONS = {
    "WEB": "Clean each paragraph of a web article: repair spacing, remove share lines and page chrome, keep every fact and name. "
    f"Write {DROP} for a paragraph that is only page chrome.",
    "PDF": "Clean each paragraph of a paged document: join broken words, remove page headers and citation marks, keep every statement.",
}


def cleanup_prompt(profile: Profile) -> Column:
    """Prompt of a chunk row: instructions, context, numbered target paragraphs."""
    numbered = F.transform(
        "paras", lambda p, i: F.concat(F.lit("Paragraph "), (i + 1).cast("string"), F.lit(": "), p)
    )
    return F.concat_ws(
        "\n",
        F.lit(INSTRUCTIONS[profile.name]),
        F.concat(F.lit("Return "), F.size("paras").cast("string"), F.lit(f" paragraphs separated by {BREAK}.")),
        F.when(F.col("before").isNotNull(), F.concat(F.lit("Text before (do not change): "), F.col("before"))),
        F.when(F.col("after").isNotNull(), F.concat(F.lit("Text after (do not change): "), F.col("after"))),
        F.array_join(numbered, "\n"),
    )


def summary_prompt(title, source_text, kind="article") -> Column:
    return F.concat_ws(
        "\n",
        F.lit(f"Summarise this {kind} from its text only, in one short overview and three bullet points."),
        F.lit("Overview:\nKey points:"),
        F.concat(F.lit("Title: "), col(title)),
        F.lit("Text:"),
        col(source_text),
    )


def split_response(response, expected, token: str = BREAK) -> Column:
    """Paragraphs of a response: by the break token, else by blank lines, only if the count fits."""
    t = F.replace(F.replace(col(response), F.lit("\r\n"), F.lit("\n")), F.lit("```"), F.lit(""))

    def parts(text, pattern):
        return F.filter(F.transform(F.split(text, pattern), paragraph), lambda p: p != "")

    def choose(text):
        by_token, by_blank = parts(text, token), parts(text, r"\n\s*\n+")
        none = F.slice(F.array(F.lit("")), 1, 0)
        return F.when(F.size(by_token) == expected, by_token).when(F.size(by_blank) == expected, by_blank).otherwise(none)

    return let(F.regexp_replace(t, r"^\s+|\s+$", ""), choose)


def run_cleaner(chunks: DataFrame, cleaner: Callable, pandas: bool = False) -> DataFrame:
    """Apply a caller's cleaner to chunk rows; adds ``cleaned`` and ``failure``.

    cleaner   a Column function (paras) -> array column, or with ``pandas=True`` a function
              (paras, before, after, profile) -> list of paragraphs, called per row inside
              Arrow batches.  A failing call only marks its own row.
    """
    if not pandas:
        return chunks.withColumn("cleaned", cleaner(F.col("paras"))).withColumn(
            "failure", F.lit(None).cast("string")
        )

    def batches(frames):
        for frame in frames:
            cleaned, failures = [], []
            for row in frame.itertuples(index=False):
                try:
                    cleaned.append(list(cleaner(list(row.paras), row.before, row.after, row.profile)))
                    failures.append(None)
                except Exception as error:  # noqa: BLE001 - any model error is data here
                    cleaned.append([])
                    failures.append(failure_digest(error))
            yield frame.assign(cleaned=cleaned, failure=failures)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInPandas(batches, f"{schema}, cleaned array<string>, failure string")


def failure_digest(error: BaseException) -> str:
    """'Type: message | caused by Root: message', whole."""

    def line(e):
        message = " ".join(str(e).split())
        return f"{type(e).__name__}: {message}" if message else type(e).__name__

    root = error
    while root.__cause__ is not None:
        root = root.__cause__
    parts = [line(error)]
    if root is not error and line(root) != parts[0]:
        parts.append(line(root))
    return " | caused by ".join(parts).rstrip()


def digest_column(kind, message, root_kind, root_message) -> Column:
    """The same digest from table columns."""

    def line(k, m):
        text = collapse(m)
        return F.when(F.coalesce(text, F.lit("")) != "", F.concat(col(k), F.lit(": "), text)).otherwise(col(k))

    outer, root = line(kind, message), line(root_kind, root_message)
    return F.rtrim(F.concat_ws(" | caused by ", outer, F.when(root != outer, root)))


# ----- tokens and similarity ---------------------------------------------------------------
def runs(c, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))


def important_tokens(c) -> Column:
    """All distinct names, acronyms and numbers of the text."""
    kept = F.filter(
        runs(c, IMPORTANT_RUN, 1), lambda t: t.rlike(IMPORTANT) & ~F.lower(t).isin(IGNORED_IMPORTANT)
    )
    return F.array_distinct(kept)


def protected_tokens(c) -> Column:
    """All distinct capitalised or mixed-case words of the text that are not on the list of ignored ones."""
    bare = F.transform(runs(c, CAPITAL_RUN), lambda t: F.regexp_replace(t, r"^['’.\-]+|['’.\-]+$", ""))
    kept = F.filter(
        bare,
        lambda t: (F.length(t) >= 3) & t.rlike(PROTECTED) & ~F.lower(t).isin(IGNORED_PROTECTED),
    )
    return F.array_distinct(kept)


def content_tokens(c) -> Column:
    """Distinct words of three characters or more without stop words."""
    return F.array_distinct(F.filter(runs(F.lower(col(c)), LONG_RUN), lambda t: ~t.isin(STOP_WORDS)))


def similarity(a, b) -> Column:
    """Jaccard similarity of two token sets, 0 when one is empty."""

    def share(s):
        union = F.size(F.array_union(s.a, s.b))
        return F.when((F.size(s.a) == 0) | (F.size(s.b) == 0), F.lit(0.0)).otherwise(
            F.size(F.array_intersect(s.a, s.b)) / union
        )

    return let(F.struct(a.alias("a"), b.alias("b")), share)


def strip_citation_marks(c) -> Column:
    t = _replaced(c, "-", r"(\p{L})-\s+(\p{L})", "$1$2")
    t = _replaced(t, "[", rf"\[{CITATION_LIST}\]", " ")
    t = _replaced(t, "(", rf"\({CITATION_LIST}\)", " ")
    return collapse(F.regexp_replace(t, "[¹²³⁰-⁹]+", " "))


def _replaced(c, sign: str, pattern: str, new: str) -> Column:
    """``pattern`` replaced in texts that hold its ``sign``; others are not read by it."""
    return let(c, lambda t: F.when(t.contains(sign), F.regexp_replace(t, pattern, new)).otherwise(t))


def validation_text(c, profile: Profile) -> Column:
    if profile.name == "WEB":
        return col(c)
    t = _replaced(strip_citation_marks(c), "[", ARXIV_LINE, " ")
    headed = lambda x: F.when(x.rlike(r"\d\s+[A-Z]{2}"), F.regexp_replace(x, HEADER_RUN, " ")).otherwise(x)
    return collapse(let(t, headed))


def validation_pair(before, after, profile: Profile) -> Column:
    """struct(a, b): the validation texts; that of a text that stayed the same is made once."""
    return let(
        validation_text(before, profile),
        lambda a: F.struct(a.alias("a"), F.when(after == before, a).otherwise(validation_text(after, profile)).alias("b")),
    )


def _ratio_out(new, old, low: float, high: float) -> Column:
    base = F.greatest(F.length(old), F.lit(1))
    return let(F.length(new) / base, lambda ratio: (ratio < low) | (ratio > high))


def _lost(before, after, share: int) -> Column:
    # bound: the tokens would be looked for in the text at every use
    return let(
        before, lambda b: (F.size(b) > 0) & (F.size(F.array_intersect(b, after)) * 100 < F.size(b) * share)
    )


def pair_reason(before, after, profile: Profile) -> Column:
    """Rank in ``REASONS`` of the first failed paragraph test, null when the pair is fine."""

    def judge(p):
        lost = _lost(important_tokens(p.a), important_tokens(p.b), profile.keep_paragraph_tokens)
        if profile.name == "WEB":
            lost = lost | (F.size(F.array_except(protected_tokens(p.a), protected_tokens(p.b))) > 0)
        return (
            F.when(p.b == "", REASONS.index("blank_paragraph"))
            .when(
                _ratio_out(p.b, p.a, profile.min_paragraph_ratio, profile.max_paragraph_ratio),
                REASONS.index("paragraph_length_out_of_range"),
            )
            # a text that stayed the same has lost nothing
            .when(p.a == p.b, None)
            .when(lost, REASONS.index("paragraph_token_loss"))
            .when(
                _lost(content_tokens(p.a), content_tokens(p.b), profile.keep_content),
                REASONS.index("paragraph_content_loss"),
            )
        )

    pair = let(paragraph(after), lambda new: validation_pair(before, new, profile))
    return F.when(after != DROP, let(pair, judge))


def duplicated(paras, cleaned) -> Column:
    """A neighbour pair that became alike: similarity of 0.82 or more and 0.20 above the original."""

    def original(i):
        return similarity(content_tokens(F.get(paras, i - 1)), content_tokens(F.get(paras, i)))

    def pairs(b):
        return F.exists(
            F.sequence(F.lit(1), F.size(b) - 1),
            lambda i: (F.get(cleaned, i) != DROP)
            & (F.get(cleaned, i - 1) != DROP)
            # the original is asked only where the new neighbours are alike
            & let(similarity(F.get(b, i - 1), F.get(b, i)), lambda s: (s >= 0.82) & (s > original(i) + 0.20)),
        )

    return F.when(
        (F.size(cleaned) >= 2) & (paras != cleaned), let(F.transform(cleaned, content_tokens), pairs)
    ).otherwise(F.lit(False))


def rejection_reason(profile: Profile, paras="paras", cleaned="cleaned") -> Column:
    """First failed test of a chunk, in order; null when the rewrite is accepted."""
    paras, cleaned = col(paras), col(cleaned)
    before = F.array_join(paras, "\n\n")
    after = F.array_join(F.transform(cleaned, lambda p: F.when(p == DROP, "").otherwise(p)), "\n\n")

    def whole(texts):
        pair = validation_pair(texts["before"], texts["after"], profile)
        return let(pair, lambda p: F.struct(texts["after"].alias("text"), p["a"].alias("a"), p["b"].alias("b")))

    def judge_whole(w):
        return (
            F.when(~w.text.rlike(r"\S"), REASONS.index("blank_combined_output"))
            .when(_ratio_out(w.b, w.a, profile.min_ratio, profile.max_ratio), REASONS.index("length_ratio_out_of_range"))
            .when(
                contains_any(w.text, [s for s in SUSPICIOUS if s.upper() == s])
                | w.text.rlike("(?i)" + any_of([s for s in SUSPICIOUS if s.upper() != s])),
                REASONS.index("suspicious_formatting"),
            )
            .when(
                (w.a != w.b) & _lost(important_tokens(w.a), important_tokens(w.b), profile.keep_tokens),
                REASONS.index("important_token_loss"),
            )
        )

    # pairs behind the first that fails are not judged
    by_pair = F.aggregate(
        F.arrays_zip(paras.alias("a"), cleaned.alias("b")), F.lit(None).cast("int"),
        lambda found, z: F.when(found.isNotNull(), found).otherwise(pair_reason(z["a"], z["b"], profile)),
    )
    rank = F.coalesce(
        F.when((F.size(paras) == 0) | (F.size(cleaned) == 0), REASONS.index("empty_output"))
        .when(F.size(paras) != F.size(cleaned), REASONS.index("paragraph_count_mismatch")),
        F.when(
            F.lit(not profile.allow_drop) & F.array_contains(cleaned, DROP),
            REASONS.index("paragraph_drop_not_allowed"),
        ),
        let(let(F.struct(before.alias("before"), after.alias("after")), whole), judge_whole),
        by_pair,
        F.when(duplicated(paras, cleaned), REASONS.index("unexpected_duplication")),
    )
    return F.get(strings(REASONS), rank)


def validated(rows: DataFrame, profile: Profile) -> DataFrame:
    """Chunk rows with ``reason``: null for accepted, model_failure first."""
    reason = F.when(F.col("failure").isNotNull(), MODEL_FAILURE).otherwise(rejection_reason(profile))
    return rows.withColumn("reason", reason)


def change_kinds(before, after, profile: Profile) -> Column:
    """What changed between two paragraphs, as a list of kinds."""
    before, after = col(before), col(after)
    squeeze = lambda c: F.regexp_replace(c, r"\s+", "")
    markers = MARKERS[profile.name]
    first = F.array_compact(
        F.array(
            F.when((before != after) & (squeeze(before) == squeeze(after)), "whitespace_cleanup"),
            # what holds no sign of the thing can not have more of it
            F.when(
                before.contains("-") & (count_of(before, r"\p{L}-\s+\p{L}") > count_of(after, r"\p{L}-\s+\p{L}")), "dehyphenation"
            ),
            F.when(
                before.rlike(r"[\[(¹²³⁰-⁹]") & (count_of(before, CITATION_MARK) > count_of(after, CITATION_MARK)),
                "citation_cleanup",
            ),
            F.when(
                n_contained(F.lower(before), markers) > n_contained(F.lower(after), markers), "boilerplate_removal"
            ),
        )
    )
    alike = similarity(
        content_tokens(validation_text(before, profile)), content_tokens(validation_text(after, profile))
    )

    def finish(s):
        extra = (
            F.when(s.alike < 0.76, "substantial_rewrite")
            .when((before != after) & ((F.size(s.first) == 0) | (s.alike < 0.96)), "minor_rewrite")
            .when(F.size(s.first) == 0, "minor_rewrite")
        )
        return F.array_compact(F.concat(s.first, F.array(extra)))

    return F.when(F.trim(after) == "", F.array(F.lit("paragraph_drop"))).otherwise(
        let(F.struct(first.alias("first"), alike.alias("alike")), finish)
    )


# ----- application and diagnostics ---------------------------------------------------------
def rewrites(chunks: DataFrame) -> DataFrame:
    """Accepted rewrites as (doc_id, block, new_text); the drop mark becomes empty text."""
    pairs = F.when(
        F.col("reason").isNull(),
        F.transform(
            F.arrays_zip(F.col("idx").alias("block"), F.col("cleaned").alias("new_text")),
            lambda z: F.struct(
                z["block"].alias("block"),
                F.when(paragraph(z["new_text"]) == DROP, "").otherwise(paragraph(z["new_text"])).alias("new_text"),
            ),
        ),
    )
    return explode_rows(chunks, pairs, "doc_id")


def numbered_blocks(docs: DataFrame, blocks: str = "blocks") -> DataFrame:
    """(doc_id, block, type, text) with the block's index in the document."""
    rows = F.transform(
        blocks, lambda b, i: F.struct(i.cast("int").alias("block"), b.type.alias("type"), b.text.alias("text"))
    )
    return explode_rows(docs, rows, "doc_id")


def apply_rewrites(blocks: DataFrame, accepted: DataFrame) -> DataFrame:
    """Blocks with the accepted text where there is one; the key (doc_id, block) has no hot values."""
    return blocks.join(accepted, ["doc_id", "block"], "left").select(
        "doc_id", "block", "type", F.coalesce("new_text", "text").alias("text"),
        F.coalesce(F.col("new_text") != F.col("text"), F.lit(False)).alias("changed"),
    )


def diff_rows(before: DataFrame, after: DataFrame, reported: DataFrame) -> DataFrame:
    """Changed paragraphs per document: the reported pairs (first per block) where a document has any,
    else a positional comparison of its paragraph blocks."""
    stored = (
        reported.filter("before is not null and after is not null")
        .groupBy("doc_id", "block")
        .agg(F.min(F.struct("chunk", "before", "after")).alias("r"))
        .select("doc_id", "block", "r.before", "r.after")
    )
    a = before.filter("type = 'Paragraph'").select("doc_id", "block", F.col("text").alias("before"))
    b = after.filter("type = 'Paragraph'").select("doc_id", "block", F.col("text").alias("after"))
    compared = a.join(b, ["doc_id", "block"]).filter(F.col("before") != F.col("after"))
    without_report = compared.join(stored.select("doc_id").distinct(), "doc_id", "left_anti")
    return stored.unionByName(without_report)


def run_diagnostics(chunks: DataFrame, *keys: str) -> DataFrame:
    """Counts per key over chunk rows with ``reason``; partial aggregation before the exchange."""
    accepted = F.col("reason").isNull()
    finals = F.transform("cleaned", lambda p: F.when(p == DROP, "").otherwise(paragraph(p)))
    pairs = F.arrays_zip(F.col("paras").alias("a"), finals.alias("b"))
    changed = F.when(accepted, F.size(F.filter(pairs, lambda z: z["a"] != z["b"]))).otherwise(0)
    dropped = F.when(accepted, F.size(F.filter(finals, lambda p: p == ""))).otherwise(0)
    chars = lambda items: F.aggregate(items, F.lit(0), lambda a, p: a + F.length(p))
    return chunks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.sum(F.size("paras")).alias("eligible"),
        F.sum(accepted.cast("int")).alias("accepted"),
        F.sum((~accepted).cast("int")).alias("rejected"),
        F.sum(changed).alias("changed"),
        F.sum(dropped).alias("dropped"),
        F.sum(chars(F.col("paras"))).alias("chars_before"),
        F.sum(F.when(accepted, chars(finals)).otherwise(chars(F.col("paras")))).alias("chars_after"),
    )


def counted_keys(keys) -> Column:
    """[(key, count)] of an array of keys, largest first, key as the tie break."""
    counts = F.transform(
        F.array_distinct(keys), lambda k: F.struct((-F.size(F.filter(keys, lambda x: x == k))).alias("less"), k.alias("key"))
    )
    return F.transform(F.array_sort(counts), lambda c: F.struct(c["key"].alias("key"), (-c["less"]).alias("count")))


def chunk_reports(chunks: DataFrame, profile: Profile) -> DataFrame:
    """(doc_id, chunk, report): what became of each validated chunk, with a report of each changed paragraph in it.

    A rejected or failed chunk keeps its text: it has no cleaned length and no paragraph reports.
    """
    accepted = F.col("reason").isNull()
    finals = F.transform("cleaned", lambda p: F.when(p == DROP, "").otherwise(paragraph(p)))
    pairs = F.arrays_zip(F.col("idx").alias("i"), F.col("paras").alias("a"), finals.alias("b"))
    moved = F.when(accepted, F.filter(pairs, lambda z: z["a"] != z["b"])).otherwise(F.slice(pairs, 1, 0))
    chars = lambda items: F.aggregate(items, F.lit(0), lambda a, p: a + F.length(p))
    reports = F.transform(
        "moved",
        lambda z: F.struct(
            z["i"].alias("blockIndex"), change_kinds(z["a"], z["b"], profile).alias("changeKinds"),
            z["a"].alias("beforeText"), z["b"].alias("afterText"),
        ),
    )
    status = F.when(~accepted, "Rejected").when(F.size("moved") > 0, "AcceptedChanged").otherwise("AcceptedUnchanged")
    report = F.struct(
        F.element_at("idx", 1).alias("firstBlockIndex"), F.element_at("idx", -1).alias("lastBlockIndex"), status.alias("status"),
        F.col("reason").alias("rejectionReason"), F.col("failure").alias("failureSummary"),
        F.size("paras").alias("targetParagraphCount"), F.coalesce(F.length("before"), F.lit(0)).alias("contextBeforeChars"),
        F.coalesce(F.length("after"), F.lit(0)).alias("contextAfterChars"), chars(F.col("paras")).alias("originalChars"),
        F.when(accepted, chars(finals)).alias("cleanedChars"), F.size("moved").alias("changedParagraphs"),
        F.size(F.filter("moved", lambda z: z["b"] == "")).alias("droppedParagraphs"), reports.alias("paragraphReports"),
    )
    return chunks.withColumn("moved", moved).select("doc_id", "chunk", report.alias("report"))


def run_reports(chunks: DataFrame, profile: Profile, model: str, version: int, backend: str | None = None) -> DataFrame:
    """(doc_id, diagnostics): the nested record of a clean-up run, paragraphs in chunks in documents, in order.

    The lists hold the chunks of one document, which was one row before.
    """
    rows = chunk_reports(chunks, profile)
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "report"))).alias("sorted"))
    listed = listed.select("doc_id", F.transform("sorted", lambda c: c["report"]).alias("reports"))
    total = lambda of: F.aggregate("reports", F.lit(0), lambda a, r: a + of(r))
    rejected = F.filter("reports", lambda r: r["status"] == "Rejected")
    kinds = F.flatten(F.transform(F.flatten(F.col("reports.paragraphReports")), lambda p: p["changeKinds"]))
    diagnostics = F.struct(
        F.lit(model).alias("modelId"), F.lit(version).alias("promptVersion"), F.lit(backend).cast("string").alias("executionBackendLabel"),
        total(lambda r: r["targetParagraphCount"]).alias("eligibleParagraphs"), F.size("reports").alias("totalChunks"),
        F.size("reports").alias("attemptedChunks"), (F.size("reports") - F.size(rejected)).alias("acceptedChunks"),
        F.size(rejected).alias("rejectedChunks"), total(lambda r: r["changedParagraphs"]).alias("changedParagraphs"),
        total(lambda r: r["droppedParagraphs"]).alias("droppedParagraphs"), total(lambda r: r["originalChars"]).alias("eligibleCharsBefore"),
        total(lambda r: F.coalesce(r["cleanedChars"], r["originalChars"])).alias("eligibleCharsAfter"),
        counted_keys(kinds).alias("changeKindCounts"),
        counted_keys(F.transform(rejected, lambda r: r["rejectionReason"])).alias("rejectionReasonCounts"),
        F.col("reports").alias("chunkReports"),
    )
    return listed.select("doc_id", diagnostics.alias("diagnostics"))


def ranked_counts(rows: DataFrame, key: str, nulls: bool = True) -> DataFrame:
    """Count by key, largest first, key as the tie break; without ``nulls`` rows without a key are left out.

    They are left out by the count: a filter on a computed key is pushed below the counting and computes the key twice.
    """
    counted = rows.groupBy(key).agg(F.count(F.lit(1) if nulls else key).alias("n"))
    return (counted if nulls else counted.filter("n > 0")).orderBy(F.desc("n"), key)


def content_signature(source, blocks) -> Column:
    """SHA-256 of the source label and every block's type and text, zero-terminated."""
    parts = F.transform(
        col(blocks), lambda b: F.concat(b.type, F.lit("\x00"), b.text, F.lit("\x00"))
    )
    return F.sha2(F.concat(col(source), F.array_join(parts, "")), 256)


def text_signature(c) -> Column:
    return F.sha2(col(c), 256)


def pending(docs: DataFrame, done: DataFrame, model: str, version: int, signature: bool = False) -> DataFrame:
    """Documents without a current result.

    Current is the same model and prompt version, with ``signature`` also the same source text;
    a result of a newer prompt version is left alone whatever the model.
    """
    same = (F.col("model") == model) & (F.col("version") == version)
    if signature:
        return docs.join(done.filter(same).select("doc_id", "signature"), ["doc_id", "signature"], "left_anti")
    return docs.join(done.filter(same | (F.col("version") > version)).select("doc_id"), "doc_id", "left_anti")
