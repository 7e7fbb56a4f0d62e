"""Line rules for paged text: artifacts, headers, titles, metadata, prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.rules import any_of
from leafmill.functions.text import (
    col, collapse, contains_any, count_of, has_any, has_chars, has_words, length_to, let, signature, words,
)

# --- fixed values: line rules ---
TRAILING_HYPHENS = "(\\p{L})[\u0002­‐‑⁠﻿]+\\s*$"
# the odd character stands first, so the letter before it is looked for only where there is one
ARTIFACT = "[\u0000-\u001f\u007f­​‌‍⁠﻿]"
INLINE_ARTIFACTS = rf"{ARTIFACT}(?<=\p{{L}}{ARTIFACT}){ARTIFACT}*(?=\p{{L}})"
GARBAGE = "[�•‣⁃∙■-◿]"
INLINE_GARBAGE = rf"{GARBAGE}(?<=\p{{L}}{GARBAGE}){GARBAGE}*(?=\p{{L}})"
CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
ZERO_WIDTH = "[​‌‍⁠﻿]"
# every character that ``repair`` looks for
ODD_CHARS = f"[\u0002­‐‑⁠﻿{ARTIFACT[1:-1]}{GARBAGE[1:-1]}{CONTROL_CHARS[1:-1]}{ZERO_WIDTH[1:-1]}]"
# a character outside of these ranges, which hold none of the odd ones and are asked for faster
UNUSUAL = "[^ -~\u00a0-\u00ac\u00ae-\u1fff]"
HYPHENATED_PREFIXES = [
    "anti", "co", "cross", "de", "inter", "intra", "macro", "meta", "micro", "mid", "multi", "neo",
    "non", "over", "post", "pre", "pro", "pseudo", "re", "semi", "self", "sub", "super", "trans",
    "ultra", "under",
]
METADATA_WORDS = [
    "author", "university", "institute", "department", "school of", "faculty of", "laboratory",
    "center for", "centre for", "research group", "google", "deepmind", "microsoft", "openai",
    "correspond", "equal contribution", "supplementary", "keywords", "doi", "arxiv", "preprint",
    "submitted", "under review", "licensed under", "copyright", "accepted", "conference",
    "journal", "proceedings",
]
AUTHOR_LINE_STOPS = [
    "university", "institute", "department", "school", "college", "center", "centre",
    "laboratory", "abstract", "introduction", "arxiv",
]
TITLE_STOPS = [
    "abstract", "summary", "introduction", "keywords", "department", "university", "institute",
    "school", "college", "center", "centre", "laboratory", "conference", "proceedings", "journal",
    "arxiv", "doi",
]
LIKELY_TITLE_STOPS = [
    "abstract", "introduction", "keywords", "department", "university", "institute", "conference",
    "proceedings", "arxiv", "doi",
]
FOOTNOTE_WORDS = [
    "note", "correspond", "@", "equal contribution", "supplementary", "acknowledg", "fund",
    "available at",
]
AFFILIATION_WORDS = [
    "university", "institute", "department", "school of", "faculty", "laboratory", "center for",
    "centre for", "google", "deepmind", "microsoft", "openai", "correspond", "equal contribution",
    "college", "hospital",
]
ARXIV_HEADER = r"(?i)arxiv:\d{4}\.\d{4,5}(?:v\d+)?\s+\[[^\]]+\]\s+\d{1,2}\s+[a-z]{3}\s+\d{4}"
NAME_LIST = (
    r"^[A-Z][A-Za-z.'-]+(?:\s+[A-Z][A-Za-z.'-]+){1,5}"
    r"(?:\s*,\s*[A-Z][A-Za-z.'-]+(?:\s+[A-Z][A-Za-z.'-]+){1,5})*$"
)
AFFILIATION_START = (
    r"(?i)^[A-Za-z ,.&'-]+(?:university|institute|department|laboratory|school|college|center|centre)\b"
)
# of these only AFFILIATION_START decides, the others are in METADATA_WORDS
AFFILIATION_HINTS = ["school", "college", "center", "centre"]
# two to twelve words; stops at the thirteenth
FEW_WORDS = r"^\s*+\S++(?:\s++\S++){1,11}+\s*+\z"
# a word in small letters other than "and", which may have marks inside, is in no list of names
SMALL_WORD = r"(?:^|\s)(?!a)\p{Ll}"
# a list has a comma or an "and", marks inside or not
LISTED = r"(?i)[,&]|a[\d*†‡§∗()]*n[\d*†‡§∗()]*d"
NAME_WORD = r"^(?:\p{Lu}{2,20}|\p{Lu}\p{Ll}{1,19})$"
TRANSCRIPT_MARKS = [
    "action required:", "filename:", "last_modified:", "source_ip=", "dest_ip=",
    "list_server_files(", "copy_server_file(", "transfer_server_files(", "run_shell_command(",
    "add_server_delete_queue(", ".safetensors", "employee_directory.csv", "server 10.0.",
]
SPEAKERS = ["user:", "assistant:", "tool call:", "tool output:"]


def repair(c) -> Column:
    """Extraction artifacts: odd hyphens at the end, control and bullet garbage inside words."""


    def clean(line):
        t = F.regexp_replace(line, TRAILING_HYPHENS, "$1-")
        t = F.regexp_replace(F.regexp_replace(t, INLINE_ARTIFACTS, ""), INLINE_GARBAGE, "")
        return F.regexp_replace(F.regexp_replace(t, CONTROL_CHARS, ""), ZERO_WIDTH, "")

    return let(c, lambda line: F.when(line.rlike(UNUSUAL) & line.rlike(ODD_CHARS), clean(line)).otherwise(line))


def letters(c) -> Column:
    return count_of(c, r"\p{L}")


def has_letters(c, n: int) -> Column:
    return has_chars(c, n, r"\p{L}", r"\P{L}")


def all_caps(c) -> Column:
    return col(c) == F.upper(col(c))


def prose(c) -> Column:
    c = col(c)
    lower_words = lambda n: has_words(c, n, r"\p{Ll}")
    return (length_to(c, 45) >= 45) & lower_words(4) & (c.rlike("[.?!]") | lower_words(6))


def boundary(c) -> Column:
    return col(c).rlike(r"(?i)^(?:abstract|summary|(?:[1i]\.?\s+)?introduction)$")


def heading(c) -> Column:
    c = col(c)
    n = words(c)
    capital = count_of(c, r"(?:^|\s)\p{Lu}")
    return (
        (c != "")
        & (length_to(c, 91) <= 90)
        & ~c.rlike("[.?!:;]$")
        & ~has_words(c, 13)
        & (
            c.rlike(r"^[0-9IVX.]+\s+[A-Z]")
            # of twelve words or fewer, four without a capital are too many: most lines need no count
            | (~has_words(c, 4, r"[^\s\p{Lu}]") & (capital >= n * 0.7))
            | (all_caps(c) & has_letters(c, 2))
        )
    )


def name_segments(c) -> Column:
    return F.filter(
        F.transform(F.split(col(c), r"(?i)\s*,\s*|\s+(?:and|&)\s+"), F.trim), lambda s: s != ""
    )


def name_words(segment) -> Column:
    """Words of a segment reduced to their letters; blank words dropped."""
    ws = F.filter(F.split(segment, r"\s+"), lambda w: w != "")
    return F.transform(ws, lambda w: F.regexp_replace(w, r"[^\p{L}]", ""))


def author_line(c) -> Column:
    """At least two personal names, at least two of them with two or more words."""
    c = col(c)
    clean = F.regexp_replace(collapse(c), r"(?<=\p{L})[\d*†‡§∗]+", "")
    clean = collapse(F.regexp_replace(clean, r"(?<=\p{L})\((?:\d+|[*†‡§∗]+)\)", ""))

    def judge(t):
        segments = F.transform(name_segments(t), name_words)
        return let(
            segments,
            lambda ss: (F.size(ss) >= 2)
            & F.forall(
                ss, lambda ws: F.size(ws).between(1, 4) & F.forall(ws, lambda w: w.rlike(NAME_WORD))
            )
            & (F.size(F.filter(ss, lambda ws: F.size(ws) >= 2)) >= 2),
        )

    def gate(t):
        return (
            F.length(t).between(8, 160)
            & ~t.rlike(r"[@\p{Nd}]|\.$")
            & t.rlike(r"(?i),|\s(?:and|&)\s")
            & ~has_any(F.lower(t), AUTHOR_LINE_STOPS)
        )

    # marks go only from behind letters, so ``clean`` has as many words as ``c``, which costs far less to ask
    return F.when(
        ~c.rlike(SMALL_WORD) & c.rlike(LISTED) & c.rlike(FEW_WORDS), let(clean, lambda t: F.when(gate(t), judge(t)).otherwise(F.lit(False)))
    ).otherwise(F.lit(False))


def metadata(c, title=None) -> Column:
    c = col(c)


    def worded(low):
        return (
            contains_any(low, METADATA_WORDS)
            | low.rlike(r"^(?:received|published|revised|accepted)\b")
            | (contains_any(low, AFFILIATION_HINTS) & c.rlike(AFFILIATION_START))
        )

    found = (
        c.contains("@")
        # bound: each of the words would make the lower-case text anew
        | let(F.lower(c), worded)
        | c.rlike(r"^\d+(?:\s*,\s*\d+)*$")
        | (c.rlike(NAME_LIST) & ~all_caps(c))
        | author_line(c)
    )
    if title is not None:
        found = found & (signature(c) != signature(title))
    return (c != "") & found


def running_candidate(c) -> Column:
    c = col(c)
    return (
        length_to(c, 61).between(2, 60)
        & ~c.rlike(r"^\d+$|[.!?]$|@")
        & ~has_words(c, 11)
        & ~has_chars(c, 5, r"[^\p{L}\p{Nd}\s]", r"[\p{L}\p{Nd}\s]")
        & has_letters(c, 2)
    )


def pattern_line(c, first_page) -> Column:
    """Bare numbers, 'page N of M', preprint banners and, after the first page, numbered headers."""
    c = col(c)
    rest = F.trim(F.regexp_replace(c, r"^\d+\s+", ""))
    numbered = c.rlike(r"^\d+\s+\S") & (
        author_line(rest) | (all_caps(rest) & ~rest.endswith(".") & has_letters(rest, 8))
    )
    return (
        (c.contains("[") & c.rlike(ARXIV_HEADER))
        | c.rlike(r"^\d+$")
        | c.rlike(r"(?i)^page\s+\d+(?:\s+of\s+\d+)?$")
        | (~first_page & numbered)
    )


def abstract_body(c) -> Column:
    """Text after a leading 'Abstract:' if it is prose of at least 40 characters, else null."""
    body = F.trim(F.regexp_extract(col(c), r"(?is)^(?:abstract|summary)\s*[:.\-–—]?\s+(.+)$", 1))
    return F.when(col(c).rlike(r"(?i)^(?:abstract|summary)") & (F.length(body) >= 40) & prose(body), body)


def footnote_start(c) -> Column:
    c = col(c)
    sure = c.contains("@") | c.rlike(r"^(?:(?i:footnote)|[*†‡§]\s+.+$|\d{1,2}[A-Z])")
    listed = c.rlike(r"^\d{1,2}[.)]?\s+.+$") & (length_to(c, 161) <= 160) & ~heading(c) & ~boundary(c)
    return (c != "") & (sure | listed)


def standalone_footnote(c) -> Column:
    return footnote_start(c) & has_any(F.lower(col(c)), FOOTNOTE_WORDS)


def front_title_line(c) -> Column:
    c = col(c)
    return (
        length_to(c, 181).between(12, 180)
        & ~c.rlike(r"[@\p{Nd}]")
        & ~has_any(F.lower(c), TITLE_STOPS)
        & ~prose(c)
        & has_letters(c, 10)
    )


def likely_title_line(c) -> Column:
    c = col(c)
    return (
        length_to(c, 181).between(12, 180)
        & ~c.rlike(r"@|^\d+(?:\s*,\s*\d+)*$")
        & ~has_any(F.lower(c), LIKELY_TITLE_STOPS)
        & has_letters(c, 10)
    )


def transcript_blob(c) -> Column:
    return let(F.lower(col(c)), lambda low: _transcript(col(c), low))


def _transcript(c, low) -> Column:
    from leafmill.functions.text import n_contained

    address = c.rlike(r"\b\d{1,3}(?:\.\d{1,3}){3}\b")
    assigned = c.rlike(r'(?i)\b[a-z_]+\s*=\s*["(]')

    def judge(n):
        return (n >= 2) | ((n >= 1) & address) | (c.startswith("[...]") & ((n >= 1) | assigned))

    hint = contains_any(low, TRANSCRIPT_MARKS) | c.startswith("[...]")
    return F.when(hint, let(n_contained(low, TRANSCRIPT_MARKS), judge)).otherwise(F.lit(False))


def figure_start(c) -> Column:
    c = col(c)
    return let(
        F.lower(c),
        lambda low: low.rlike(r"^(?:\([a-z]\)\s+|(?:figure|fig\.|table)\s+\d+[:.]|" + any_of(SPEAKERS) + ")")
        | low.contains("figure 1:")
        | _transcript(c, low),
    )


def figure_continues(c, starts: Column | None = None) -> Column:
    """``starts``: the known answer of ``figure_start``."""
    more = lambda low: low.rlike(r"^\([ab]\)") | contains_any(low, ["follow-up q&a", "model exfiltration"])
    return (figure_start(c) if starts is None else starts) | let(F.lower(col(c)), more)


def tabular(c) -> Column:
    c = col(c)
    toks = F.split(c, r"\s+")
    numeric = F.size(
        F.filter(
            toks,
            lambda t: F.regexp_replace(t, r"^[,;:()]+|[,;:()]+$", "").rlike(r"^[-–—]?\d+(?:\.\d+)?%?$")
            | t.isin("-", "–", "—"),
        )
    )
    digits = count_of(c, r"\p{Nd}")

    def judge(n):
        return ((n >= 8) & (digits >= letters(c))) | ((n >= 6) & c.contains("0.0") & (digits >= 12))

    gate = (length_to(c, 24) >= 24) & has_chars(c, 6, r"\p{Nd}", r"\P{Nd}") & has_words(c, 10) & ~prose(c)
    return F.when(gate, let(numeric, judge)).otherwise(F.lit(False))


def join_lines(left: Column, right: Column) -> Column:
    """Append a line to a paragraph with the hyphen rules."""
    fragment = F.regexp_extract(left, r"(?<![\p{L}\p{Nd}])([\p{L}\p{Nd}]*+)-$", 1)
    start = F.regexp_extract(right, r"[\p{L}\p{Nd}]", 0)
    prefix = F.lower(fragment).rlike("^" + any_of(HYPHENATED_PREFIXES) + "$")
    caps = fragment.rlike(r"\p{L}") & ~fragment.rlike(r"\p{Ll}")
    keep = (fragment != "") & (start.rlike(r"[\p{Lu}\p{Nd}]") | prefix | caps)
    drop = (fragment != "") & start.rlike(r"\p{Ll}") & fragment.rlike(r"\p{Ll}") & ~prefix
    cut = F.substr(left, F.lit(1), F.length(left) - 1)
    return (
        F.when(right == "", left)
        .when(left == "", right)
        .when(
            left.endswith("-") & (start != ""),
            F.when(keep, F.concat(left, right)).when(drop, F.concat(cut, right)).otherwise(
                F.concat(left, F.lit(" "), right)
            ),
        )
        .otherwise(F.concat(left, F.lit(" "), right))
    )


def assemble(lines) -> Column:
    """One paragraph from its lines."""
    return collapse(
        F.aggregate(
            F.transform(col(lines), lambda x: F.trim(repair(x))), F.lit(""), lambda acc, x: join_lines(acc, x)
        )
    )


# a word begins with a letter, so trimming quotes never empties one: the first four matches are the first four words
FIRST_WORDS = r"^(?:[^A-Za-z]*[A-Za-z][^\s,.;:!?)]*){1,4}"


def body_sentence(c) -> Column:
    """Starts like a sentence: a capital word, then at least two lower-case ones among the first four."""
    ws = F.filter(
        F.transform(
            F.regexp_extract_all(
                F.regexp_extract(col(c), FIRST_WORDS, 0), F.lit(r"[A-Za-z][^\s,.;:!?)]*"), F.lit(0)
            ),
            lambda w: F.regexp_replace(w, r"""^["'“”(\[]+|["'“”(\[]+$""", ""),
        ),
        lambda w: w != "",
    )
    first = F.slice(ws, 1, 4)
    return let(
        first,
        lambda f: (F.size(f) >= 2)
        & F.coalesce(F.try_element_at(f, F.lit(1)).rlike(r"^\p{Lu}"), F.lit(False))
        & F.coalesce(F.try_element_at(f, F.lit(2)).rlike(r"^\p{Ll}"), F.lit(False))
        & (F.size(F.filter(f, lambda w, i: (i > 0) & w.rlike(r"^\p{Ll}"))) >= 2),
    )


def metadata_prefix(c, title) -> Column:
    c = col(c)
    trimmed = F.regexp_replace(c, r"(^|\s)[,;:.()]+", "$1")
    listed = (
        c.contains(",")
        & (words(c) <= 30)
        & (count_of(trimmed, r"(?:^|\s)\p{Lu}") >= 3)
        & (count_of(trimmed, r"(?:^|\s)\p{Ll}") <= 12)
        & (count_of(c, r"(?i)\b(?:and|&|y)\b") <= 4)
        & ~c.rlike("[.!?]")
    )
    return (signature(c) == signature(title)) | metadata(c, title) | has_any(F.lower(c), AFFILIATION_WORDS) | listed


def split_prefix(c, title) -> Column:
    """struct(prefix, body) at the first word where a metadata-like prefix ends and prose starts, else null."""
    c = col(c)
    # only the first 36 words can end a prefix; the rest of the text is cut off by position
    ws = F.slice(F.split(c, " ", 38), 1, 37)

    def at(ws_, i):
        head = F.array_join(F.slice(ws_, F.lit(1), i), " ")
        return let(
            head,
            lambda h: F.struct(
                F.regexp_replace(F.trim(h), r"^[,;:\-–—]+|[,;:\-–—]+$", "").alias("prefix"),
                F.regexp_replace(F.substr(c, F.length(h) + 2), r"^[ ,;:\-–—]+", "").alias("body"),
            ),
        )

    def fits(s):
        # cheap tests on the short prefix first; the one that reads the whole body comes last
        return (
            F.length(s.prefix).between(12, 320)
            & (length_to(s.body, 45) >= 45)
            & s.body.rlike(r"^[^A-Za-z]*[A-Z]")
            & body_sentence(s.body)
            & ~prose(s.prefix)
            & metadata_prefix(s.prefix, title)
            & prose(s.body)
        )

    def search(ws_):
        ends = F.sequence(F.lit(2), F.least(F.size(ws_), F.lit(36)) - 1)
        # a body begins with a capital, so the rest of the text is copied only behind words that may be in front of one
        ends = F.filter(ends, lambda i: ~F.get(ws_, i).rlike("^[^A-Za-z]*[a-z]"))
        return F.try_element_at(F.filter(F.transform(ends, lambda i: at(ws_, i)), fits), F.lit(1))

    gate = (length_to(c, 80) >= 80) & has_words(c, 8)
    return F.when(gate, let(ws, search))
