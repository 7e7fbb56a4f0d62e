"""Queries over sentences, citations, sections and reading progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import progress as P
from leafmill.operators import sentences as S
from leafmill.operators import web as W
from leafmill.operators.blocks import explode_blocks, explode_rows
from leafmill.plans.inputs import cited_blocks, positions, rich_pages
from leafmill.sources.corpus import read_documents, read_table


def sentence_table(spark, sf):
    rows = explode_blocks(cited_blocks(spark, sf), "doc_id").filter("type = 'Paragraph'")
    return explode_rows(rows, S.sentences_only("text"), "doc_id", "pos")


def oversize_split(spark, sf):
    # label lines and their followers joined, so that long sentences exist
    docs = read_documents(spark, sf).withColumn("text", F.regexp_replace("text", r"[.!?\n]+", " "))
    return explode_rows(docs, S.sentence_slices("text"), "doc_id")


def citations_stripped(spark, sf):
    rows = explode_blocks(cited_blocks(spark, sf), "doc_id")
    return rows.select("doc_id", "pos", S.strip_citations("text").alias("text"))


def citation_ranges(spark, sf):
    rows = explode_blocks(cited_blocks(spark, sf), "doc_id")
    return explode_rows(rows, S.citation_spans("text"), "doc_id", "pos")


def back_matter_cut(spark, sf):
    df = cited_blocks(spark, sf).withColumn("blocks", S.before_back_matter("blocks"))
    return explode_blocks(df, "doc_id")


def abbreviations(spark, sf):
    rows = explode_blocks(cited_blocks(spark, sf), "doc_id")
    return rows.select("doc_id", "pos", S.spoken_text(S.offset_map("text")).alias("spoken"))


def offset_mapping(spark, sf):
    rows = explode_blocks(cited_blocks(spark, sf), "doc_id").withColumn("runs", S.offset_map("text"))
    offset = (F.col("doc_id") * 13 + F.col("pos") * 7) % 120
    rows = rows.withColumn("offset", offset.cast("int"))
    return rows.select(
        "doc_id", "pos", "offset",
        S.to_original("runs", "offset").alias("start_at"),
        S.to_original("runs", "offset", prefer_end=True).alias("end_at"),
    )


def sections(spark, sf):
    df = cited_blocks(spark, sf)
    return explode_rows(df, S.section_of("blocks", "title"), "doc_id")


def skim(spark, sf):
    return S.skim_extract(cited_blocks(spark, sf), "doc_id")


def authors(spark, sf):
    df = rich_pages(spark, sf).withColumn("title", W.page_title("html", "url"))
    return df.select("page_id", S.first_author(W.page_metadata("html", "title")).alias("author"))


def listing(spark, sf):
    df = cited_blocks(spark, sf)
    # every third document keeps only its headings, every third of those none at all
    kept = F.filter("blocks", lambda b: (F.col("doc_id") % 3 != 0) | ((b.type == "Heading") & (F.col("doc_id") % 9 != 0)))
    # the labels of those without any are of five kinds
    heads = ["https://www.example.com/read/", "captured-text:", "content://a/b/", "file:///home/papers/", "papers/"]
    kind = F.floor(F.col("doc_id") / 9) % len(heads) + 1
    label = F.concat(F.element_at(F.array(*[F.lit(h) for h in heads]), kind.cast("int")), F.col("source"))
    df = df.withColumn("kept", kept).withColumn("label", label)
    return df.select("doc_id", S.listing_text("kept", "title", "label").alias("summary"))


def summary_sources(spark, sf):
    return cited_blocks(spark, sf).select("doc_id", S.summary_source("blocks").alias("source_text"))


def url_mentions(spark, sf):
    rows = explode_blocks(cited_blocks(spark, sf), "doc_id")
    return rows.select("doc_id", "pos", F.posexplode(S.url_mentions("text")).alias("n", "url"))


def best_urls(spark, sf):
    rows = url_mentions(spark, sf).filter("url rlike '^https?://[^/]+'")
    score = F.when(F.col("url").contains("example.org"), 20).otherwise(10)
    return rows.groupBy("doc_id").agg(
        F.max(F.struct(score.alias("score"), F.length("url").alias("n"), F.col("url"))).alias("best")
    ).select("doc_id", "best.url", F.when(F.lower("best.url").endswith(".pdf"), F.col("best.url")).alias("pdf_url"))


def cumulative_units(spark, sf):
    df = P.measured(cited_blocks(spark, sf))
    rows = F.transform(
        "segs",
        lambda g: F.struct(g.seg.alias("seg"), g.block.alias("block"), g.u0.alias("u0"), g.u1.alias("u1"), g.w0.alias("w0"), g.w1.alias("w1")),
    )
    return explode_rows(df, rows, "doc_id")


def progress(spark, sf):
    df = P.located(cited_blocks(spark, sf), positions(spark, sf))
    return df.select("event_id", "doc_id", F.round(P.progress_fraction(df), 6).alias("fraction"))


def seeks(spark, sf):
    wanted = positions(spark, sf).withColumn("fraction", F.col("k") / 100.0)
    df = P.seek(cited_blocks(spark, sf), wanted)
    inner = F.least(F.greatest(F.col("target") - F.col("seg.u0"), F.lit(0)), F.col("seg.n"))
    return df.select("event_id", "target", F.col("seg.seg").alias("seg"), inner.alias("inner"))


def remaining_time(spark, sf):
    df = P.located(cited_blocks(spark, sf), positions(spark, sf))
    speed = 0.5 + (F.col("k") % 4) * 0.5
    df = df.withColumn("seconds", P.remaining_seconds(speed))
    percent = F.floor(P.progress_fraction(df) * 100).cast("int")
    label = F.concat(percent.cast("string"), F.lit("% · "), P.time_label("seconds"))
    return df.select("event_id", "seconds", label.alias("label"))


def position_segments(spark, sf):
    df = P.located(cited_blocks(spark, sf), positions(spark, sf))
    return df.select(
        "event_id",
        F.col("seg.seg").alias("seg"),
        "inner",
        P.segment_or_first().seg.alias("seg_or_first"),
        P.segment_in_block().seg.alias("seg_in_block"),
    )


QUERIES = {
    "n01_sentence_table": sentence_table,
    "n02_oversize_split": oversize_split,
    "n03_citations_stripped": citations_stripped,
    "n04_citation_ranges": citation_ranges,
    "n05_back_matter_cut": back_matter_cut,
    "n06_abbreviations": abbreviations,
    "n07_offset_mapping": offset_mapping,
    "n08_sections": sections,
    "n09_skim": skim,
    "n10_authors": authors,
    "n11_listing": listing,
    "n12_summary_sources": summary_sources,
    "n14_url_mentions": url_mentions,
    "n15_best_urls": best_urls,
    "a01_cumulative_units": cumulative_units,
    "a02_progress": progress,
    "a03_seeks": seeks,
    "a04_remaining_time": remaining_time,
    "a05_position_segments": position_segments,
}
