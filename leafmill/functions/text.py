"""Column functions shared by every operator: normalisers, keys, counts, URL parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.rules import any_of


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def let(value, fn) -> Column:
    """Bind ``value`` once and use it many times in ``fn``.

    The value becomes a lambda variable, so nested rules do not copy the whole expression at every
    use.  It is the start of a fold over nothing: ``transform`` would copy each result in depth,
    which in a step of a longer fold is the whole state, its texts included, once per step.
    """
    return F.aggregate(F.array().cast("array<int>"), col(value), lambda acc, _: acc, fn)


def trim_ws(c) -> Column:
    """Trim every ASCII white-space character, not only blanks."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


# white space that is not one blank between words
UNEVEN = r"[\t\n\x0B\f\r]|  "


def flat(c) -> Column:
    """One blank for each run of white space; a text that has only single blanks is not built anew."""
    return let(c, lambda t: F.when(t.rlike(UNEVEN), F.regexp_replace(t, r"\s+", " ")).otherwise(t))


def collapse(c) -> Column:
    return F.trim(flat(c))


def norm(c) -> Column:
    """Block text: NBSP and soft hyphen to blank, one blank between words, none before , . ; : ! ?"""
    blank = F.replace(F.replace(col(c), F.lit(" "), F.lit(" ")), F.lit("­"), F.lit(" "))
    close = lambda t: F.when(t.rlike(r" [,.;:!?]"), F.regexp_replace(t, r" ([,.;:!?])", "$1")).otherwise(t)
    return F.trim(let(flat(blank), close))


def dedupe_key(c) -> Column:
    """Key of a block: lower-case ASCII letters and digits, collapsed after stripping."""
    return collapse(F.regexp_replace(F.lower(norm(c)), r"[^a-z0-9 ]", ""))


def token_key(c) -> Column:
    """Key of a title or source: collapsed before stripping, so stripped signs leave gaps."""
    return F.trim(
        F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"\s+", " "), r"[^a-z0-9 ]", "")
    )


def signature(c) -> Column:
    """Line signature: lower case, digits masked, collapsed."""
    return collapse(let(F.lower(col(c)), lambda t: F.when(t.rlike(r"\d"), F.regexp_replace(t, r"\d+", "#")).otherwise(t)))


def words(c) -> Column:
    """Number of white-space separated words."""
    return F.regexp_count(col(c), F.lit(r"\S+"))


def count_of(c, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern))


def length_to(c, n: int) -> Column:
    """Code points, counted to ``n`` only: enough for a comparison with less."""
    return F.length(F.substring(col(c), 1, n))


def has_words(c, n: int, start: str = r"\S") -> Column:
    """Whether ``n`` white-space separated words or more begin with ``start`` (one character).

    Counted in the pattern, which reads the text once at most and makes no list of its words.
    """
    return col(c).rlike(rf"^\s*+(?:(?:(?!{start})\S++\s++)*+{start}\S*+\s*+){{{n}}}")


def has_chars(c, n: int, chars: str, others: str) -> Column:
    """Whether ``n`` characters or more are of the class ``chars``; ``others`` is the class of all the others."""
    return col(c).rlike(rf"^(?:{others}*+{chars}){{{n}}}")


def ends_sentence(c) -> Column:
    return col(c).rlike(r"[.!?]$")


def between(c, low: int, high: int) -> Column:
    return col(c).between(low, high)


def starts_any(c, phrases) -> Column:
    return col(c).rlike("^" + any_of(phrases))


def has_any(c, phrases) -> Column:
    return col(c).rlike(any_of(phrases))


def contains_any(c, phrases) -> Column:
    """Like ``has_any``; in a long text, plain searches are faster than an alternation tried at every character."""
    return reduce(lambda a, b: a | b, [col(c).contains(p) for p in phrases])


def n_contained(c, phrases) -> Column:
    """How many of the phrases occur in the text."""
    return F.size(F.filter(strings(phrases), lambda p: col(c).contains(p)))


def strings(values) -> Column:
    """Constant array of strings, built from one SQL literal."""
    quoted = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return F.expr(f"array({quoted})")


def one_of(c, values) -> Column:
    return col(c).rlike("^" + any_of(values) + "$")


def blank_to_null(c) -> Column:
    return F.nullif(trim_ws(c), F.lit(""))


def flag(condition) -> Column:
    """Boolean as 0/1, null counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def url_host(c) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(col(c), F.lit("HOST")), F.lit("")))


def url_path(c) -> Column:
    return F.coalesce(F.try_parse_url(col(c), F.lit("PATH")), F.lit(""))


def epoch_ms(c) -> Column:
    """Milliseconds since 1970 of a TIMESTAMP_NTZ, whatever the session time zone."""
    name = c if isinstance(c, str) else c
    return F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), col(name))
