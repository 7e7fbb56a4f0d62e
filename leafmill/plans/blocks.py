"""Queries over document lines: block cleaning and plain text."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import boilerplate as B
from leafmill.functions import plain
from leafmill.functions.text import dedupe_key, norm, signature, token_key
from leafmill.operators import blocks as K
from leafmill.plans import inputs as I
from leafmill.sources.corpus import read_documents


def block_normalised(spark, sf):
    docs = read_documents(spark, sf)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return lines.select(
        "doc_id",
        "pos",
        norm("raw").alias("text"),
        dedupe_key("raw").alias("dedupe_key"),
        token_key("raw").alias("token_key"),
        signature("raw").alias("signature"),
    )


def block_footer_strip(spark, sf):
    df = I.noisy_blocks(spark, sf)
    rows = K.explode_blocks(df, "doc_id")
    return rows.select("doc_id", "pos", B.stripped("text").alias("text"))


def block_boilerplate_rules(spark, sf):
    rows = K.explode_blocks(I.noisy_blocks(spark, sf), "doc_id")
    flags = B.boilerplate_rules("text", F.col("type") == "Heading")
    return rows.select(
        "doc_id", "pos", "type", *[c.cast("int").alias(n) for n, c in flags.items()]
    )


def block_stop_headings(spark, sf):
    rows = K.explode_blocks(I.noisy_blocks(spark, sf), "doc_id")
    return rows.filter(~B.is_stop_heading("text", F.col("type") == "Heading")).select(
        "doc_id", "pos", "type", "text"
    )


def block_leading_title(spark, sf):
    df = I.noisy_blocks(spark, sf)
    return K.explode_blocks(df.withColumn("blocks", K.drop_leading("blocks", "title")), "doc_id").select(
        "doc_id", "pos", "text"
    )


def block_merge(spark, sf):
    df = I.noisy_blocks(spark, sf)
    return K.explode_blocks(df.withColumn("blocks", K.merge_continuations("blocks")), "doc_id")


def block_exact_dedupe(spark, sf):
    return K.explode_blocks(K.drop_exact_duplicates(I.noisy_blocks(spark, sf)), "doc_id")


def block_containment_dedupe(spark, sf):
    df = I.noisy_blocks(spark, sf)
    return K.explode_blocks(
        df.withColumn("blocks", K.fold_duplicates("blocks", merge=False)), "doc_id"
    )


def block_cleanup(spark, sf):
    return K.explode_blocks(K.clean_blocks(I.noisy_blocks(spark, sf)), "doc_id")


def plain_paragraphs(spark, sf):
    docs = read_documents(spark, sf)
    return docs.select(
        "doc_id", F.posexplode(plain.paragraphs(I.wrapped_text(F.col("text")))).alias("pos", "text")
    )


def plain_peel(spark, sf):
    docs = read_documents(spark, sf)
    given = I.given_title(F.col("doc_id"), F.col("text"), F.col("source"))
    # label line, two list-like lines, then the text; every line is its own paragraph
    head = F.concat(
        F.lit("Notes From "), F.initcap("source"), F.lit("\nBy The Desk, University\nOne Two; Three Four\n")
    )
    body = F.when(F.col("doc_id") % 2 == 0, F.concat(head, "text")).otherwise(F.col("text"))
    df = docs.withColumn("given_title", given).withColumn("text", F.replace(body, F.lit("\n"), F.lit("\n\n")))
    done = K.peel_plain_text(df)
    return done.select(
        "doc_id",
        "title",
        F.array_join("metadata", "|").alias("metadata"),
        F.size("blocks").alias("n_blocks"),
        F.size(F.filter("blocks", lambda b: b.type == "Heading")).alias("n_headings"),
        F.array_join(F.transform("blocks", lambda b: b.text), "|").alias("body"),
    )


def plain_headings(spark, sf):
    rows = K.explode_blocks(I.noisy_blocks(spark, sf), "doc_id")
    return rows.select(
        "doc_id",
        "pos",
        F.when(F.col("type") == "Heading", F.regexp_replace("text", ":$", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        "type",
    )


QUERIES = {
    "b01_block_normalised": block_normalised,
    "b02_footer_strip": block_footer_strip,
    "b03_boilerplate_rules": block_boilerplate_rules,
    "b04_stop_headings": block_stop_headings,
    "b05_leading_title": block_leading_title,
    "b06_continuation_merge": block_merge,
    "b07_exact_dedupe": block_exact_dedupe,
    "b08_containment_dedupe": block_containment_dedupe,
    "b09_block_cleanup": block_cleanup,
    "b10_plain_paragraphs": plain_paragraphs,
    "b11_plain_peel": plain_peel,
    "b12_plain_headings": plain_headings,
}
