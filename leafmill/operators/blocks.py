"""Block cleaning: boilerplate, stop headings, leading title, merges and duplicates.

A document travels as one row with ``blocks ARRAY<STRUCT<pos, type, text>>``.
All rules that look at neighbours work inside that row, so cleaning a corpus is
a narrow job: no shuffle, whatever the number of documents.  ``explode_blocks``
gives the row-per-block table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import boilerplate as B
from leafmill.functions import plain
from leafmill.functions.text import col, dedupe_key, let, norm, token_key

BLOCKS = "array<struct<pos:int,type:string,text:string>>"
# --- fixed values: merge and duplicate limits ---
MERGE_MAX_CHARS = 420
CONTAINMENT_MIN_CHARS = 40


def line_blocks(docs: DataFrame, text="text") -> DataFrame:
    """Every non-blank line of a text column as a block; short label-like lines are headings."""
    lines = F.transform(
        F.split(col(text), "\n"),
        lambda line, i: F.struct(i.cast("int").alias("pos"), norm(line).alias("text")),
    )
    typed = F.transform(
        F.filter(lines, lambda b: b.text != ""),
        lambda b: F.struct(
            b.pos.alias("pos"),
            F.when(plain.is_heading(b.text), "Heading").otherwise("Paragraph").alias("type"),
            b.text.alias("text"),
        ),
    )
    return docs.withColumn("blocks", typed)


def explode_rows(df: DataFrame, items, *keys) -> DataFrame:
    """One row per array element, keys kept.

    An outer generator plus a null test: an inner one would make the optimizer infer a
    size test on the array and push it through the projections that build the array, which
    computes every document twice.
    """
    rows = df.select(*keys, F.inline_outer(items))
    first_field = rows.columns[len(keys)]
    return rows.filter(F.col(first_field).isNotNull())


def explode_blocks(df: DataFrame, *keys: str, blocks: str = "blocks") -> DataFrame:
    return explode_rows(df, blocks, *keys)


def map_text(blocks, fn) -> Column:
    return F.transform(
        col(blocks),
        lambda b: F.struct(b.pos.alias("pos"), b.type.alias("type"), fn(b.text).alias("text")),
    )


def keep(blocks, test) -> Column:
    return F.filter(col(blocks), test)


def strip_and_filter(blocks) -> Column:
    """Normalise, strip footers, then drop blank, boilerplate and stop blocks."""
    cleaned = map_text(blocks, lambda t: B.stripped(norm(t)))
    heading = lambda b: b.type == "Heading"
    return F.filter(
        cleaned,
        lambda b: (b.text != "")
        & ~B.is_boilerplate(b.text, heading(b))
        & ~B.is_stop_heading(b.text, heading(b)),
    )


def drop_leading(blocks, title, metadata: Column | None = None) -> Column:
    """Until the first kept block, drop blocks that repeat the title or a metadata line."""
    ignored = F.array(dedupe_key(title))
    if metadata is not None:
        ignored = F.concat(ignored, F.transform(metadata, dedupe_key))
    ignored = F.filter(ignored, lambda k: k != "")


    def cut(keys):
        # how many blocks lead; below zero once the first block that stays is met: the keys of later ones are not made
        def step(n, b):
            repeats = F.array_contains(keys, dedupe_key(b.text))
            return F.when(n < 0, n).when(F.coalesce(repeats, F.lit(True)), n + 1).otherwise(-n - 1)

        def kept(n):
            return F.when(n < 0, F.slice(col(blocks), -n, F.size(col(blocks)))).otherwise(F.slice(col(blocks), 1, 0))

        return let(F.aggregate(col(blocks), F.lit(0), step), kept)

    return let(ignored, cut)


def continues(left: Column, right: Column) -> Column:
    return (
        right.rlike("^[\\p{Ll}\\p{Nd}\"'(]")
        & ~left.rlike("[.!?]$")
        & (left != "")
        & (F.length(left) <= MERGE_MAX_CHARS)
        & (F.length(right) <= MERGE_MAX_CHARS)
    )


def joined(left: Column, right: Column) -> Column:
    return F.when(
        left.endswith("-"), F.concat(F.substr(left, F.lit(1), F.length(left) - 1), right)
    ).otherwise(F.concat(left, F.lit(" "), right))


def _set_last(items: Column, new: Column) -> Column:
    return F.concat(F.slice(items, F.lit(1), F.size(items) - 1), F.array(new))


def merge_continuations(blocks) -> Column:
    """Adjacent paragraphs merge while the left one is unfinished and the right one continues it.

    The left side is the text merged so far, so this is a fold over one document's blocks.
    """

    def step(acc, b):
        last = F.try_element_at(acc, F.lit(-1))
        merge = (
            (F.size(acc) > 0)
            & (last.type == "Paragraph")
            & (b.type == "Paragraph")
            & continues(last.text, b.text)
        )
        merged = F.struct(
            last.pos.alias("pos"), last.type.alias("type"), joined(last.text, b.text).alias("text")
        )
        return F.when(merge, _set_last(acc, merged)).otherwise(F.concat(acc, F.array(b)))

    return F.aggregate(col(blocks), F.array().cast(BLOCKS), step)


def keyed(blocks) -> Column:
    """(key, pos, type, text) sorted by key then position; the base of exact dedupe."""
    return F.array_sort(
        F.transform(
            col(blocks),
            lambda b: F.struct(
                dedupe_key(b.text).alias("key"),
                b.pos.alias("pos"),
                b.type.alias("type"),
                b.text.alias("text"),
            ),
        )
    )


def drop_exact_duplicates(df: DataFrame, blocks: str = "blocks") -> DataFrame:
    """First block per key survives; blocks with a blank key go.  n log n per document."""
    df = df.withColumn("_keyed", keyed(blocks))
    firsts = F.filter(
        "_keyed",
        lambda b, i: (b.key != "")
        & ((i == 0) | (F.col("_keyed")[F.greatest(i - 1, F.lit(0))].key != b.key)),
    )
    restored = F.array_sort(
        F.transform(
            firsts, lambda b: F.struct(b.pos.alias("pos"), b.type.alias("type"), b.text.alias("text"))
        )
    )
    return df.withColumn(blocks, restored).drop("_keyed")


FOLD = (
    "struct<started:boolean,seen:array<string>,"
    "kept:array<struct<pos:int,type:string,text:string,key:string>>>"
)


def _contains(outer: Column, inner: Column) -> Column:
    # keys are ASCII: their bytes are their characters, and a longer one is in no shorter one
    n = F.octet_length(inner)
    return (n >= CONTAINMENT_MIN_CHARS) & (n <= F.octet_length(outer)) & outer.contains(inner)


def fold_duplicates(blocks, ignored: Column | None = None, merge: bool = True) -> Column:
    """The order-dependent tail of block cleaning as one ordered fold.

    Input blocks are already stripped and filtered.  For each block, in order:
    leading title or metadata repeat, merge into the previous paragraph, replace a
    previous block it extends, containment duplicate, exact duplicate, append.
    """
    items = F.transform(
        col(blocks),
        lambda b: F.struct(
            b.pos.alias("pos"),
            b.type.alias("type"),
            b.text.alias("text"),
            dedupe_key(b.text).alias("key"),
        ),
    )
    items = F.filter(items, lambda b: b.key != "")

    def entry(pos, type_, text, key):
        return F.struct(pos.alias("pos"), type_.alias("type"), text.alias("text"), key.alias("key"))

    def state(started, seen, kept):
        return F.struct(started.alias("started"), seen.alias("seen"), kept.alias("kept"))

    def step(acc, b):
        last = F.try_element_at(acc.kept, F.lit(-1))
        has_last = F.size(acc.kept) > 0
        leading = (
            ~acc.started & F.array_contains(ignored, b.key)
            if ignored is not None
            else F.lit(False)
        )
        merges = (
            has_last & (last.type == "Paragraph") & (b.type == "Paragraph") & continues(last.text, b.text)
            if merge
            else F.lit(False)
        )
        replaces = (
            has_last
            & (last.type == b.type)
            & (F.octet_length(b.key) > F.octet_length(last.key))
            & _contains(b.key, last.key)
        )
        duplicate = F.exists(
            acc.kept,
            lambda e: (e.type == b.type)
            & (e.key != "")
            & ((e.key == b.key) | _contains(e.key, b.key) | _contains(b.key, e.key)),
        )
        text_joined = joined(last.text, b.text)
        final = F.when(b.type == "Heading", F.regexp_replace(b.text, ":$", "")).otherwise(b.text)
        return (
            F.when(leading, acc)
            .when(
                merges,
                state(
                    F.lit(True),
                    acc.seen,
                    _set_last(acc.kept, entry(last.pos, last.type, text_joined, dedupe_key(text_joined))),
                ),
            )
            .when(
                replaces,
                state(F.lit(True), acc.seen, _set_last(acc.kept, entry(last.pos, last.type, b.text, b.key))),
            )
            .when(duplicate | F.array_contains(acc.seen, b.key), acc)
            .otherwise(
                state(
                    F.lit(True),
                    F.concat(acc.seen, F.array(b.key)),
                    F.concat(acc.kept, F.array(entry(b.pos, b.type, final, b.key))),
                )
            )
        )

    start = F.struct(
        F.lit(False).alias("started"), F.array().alias("seen"), F.array().alias("kept")
    ).cast(FOLD)
    done = F.aggregate(items, start, step)
    return F.transform(
        done.kept,
        lambda b: F.struct(b.pos.alias("pos"), b.type.alias("type"), b.text.alias("text")),
    )


def clean_blocks(df: DataFrame, title="title", metadata: Column | None = None, blocks="blocks") -> DataFrame:
    """Whole block cleanup of documents: filters first (cheap, stateless), then one fold."""
    ignored = F.array(dedupe_key(title))
    if metadata is not None:
        ignored = F.concat(ignored, F.transform(metadata, dedupe_key))
    df = df.withColumn("_ignored", F.filter(ignored, lambda k: k != "")).withColumn(
        "_filtered", strip_and_filter(blocks)
    )
    return df.withColumn(blocks, fold_duplicates("_filtered", F.col("_ignored"))).drop(
        "_ignored", "_filtered"
    )


def peel_plain_text(df: DataFrame, text="text", given_title="given_title", fallback="Captured text") -> DataFrame:
    """Plain text to (title, metadata, blocks): title peel, at most three leading metadata lines."""
    given = F.nullif(F.trim(F.regexp_replace(col(given_title), r"\s+", " ")), F.lit(""))
    df = df.withColumn("_paras", plain.paragraphs(text)).withColumn("_given", given)
    first = F.try_element_at(F.col("_paras"), F.lit(1))
    repeats = token_key(first) == token_key(F.col("_given"))
    takes_first = F.coalesce(
        F.when(F.col("_given").isNotNull(), repeats).otherwise(plain.is_title(first)), F.lit(False)
    )
    df = df.withColumn("_take", takes_first).withColumn(
        "title",
        F.coalesce(F.col("_given"), F.when(F.col("_take"), first), F.lit(fallback)),
    )
    df = df.withColumn(
        "_rest", F.when(F.col("_take"), F.slice("_paras", 2, F.size("_paras"))).otherwise(F.col("_paras"))
    )
    stop = F.array_position(F.transform(F.slice("_rest", 1, 3), plain.is_metadata), F.lit(False))
    n_meta = F.when(stop > 0, stop - 1).otherwise(F.least(F.size("_rest"), F.lit(3))).cast("int")
    df = df.withColumn("_n", n_meta)
    body = F.transform(
        F.slice("_rest", F.col("_n") + 1, F.greatest(F.size("_rest"), F.lit(1))),
        lambda p, i: F.struct(
            i.cast("int").alias("pos"),
            F.when(plain.is_heading(p), "Heading").otherwise("Paragraph").alias("type"),
            F.when(plain.is_heading(p), F.regexp_replace(p, ":$", "")).otherwise(p).alias("text"),
        ),
    )
    whole = F.array_join("_paras", "\n\n")
    only = F.array(
        F.struct(
            F.lit(0).alias("pos"),
            F.lit("Paragraph").alias("type"),
            F.when(whole != "", whole).otherwise(F.lit(fallback)).alias("text"),
        )
    )
    df = df.withColumn("metadata", F.slice("_rest", 1, F.col("_n"))).withColumn("_body", body)
    return df.withColumn(
        "blocks", F.when(F.size("_body") > 0, F.col("_body")).otherwise(only)
    ).drop("_paras", "_given", "_take", "_rest", "_n", "_body")
