"""Queries over positioned boxes and generated summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leafmill.operators import layout as L
from leafmill.operators import summaries as S
from leafmill.operators.blocks import explode_rows
from leafmill.plans.inputs import noisy_documents
from leafmill.session import checkpoint_root
from leafmill.sources import store
from leafmill.sources.corpus import read_table


def screens(spark, sf):
    """Each noisy document as a screen: one box per line, positions by formula."""
    docs = noisy_documents(spark, sf)
    box = lambda t, i: F.struct(
        F.trim(t).alias("text"),
        (i * 40 + i % 3).cast("int").alias("top"),
        F.when(i % 5 == 4, 160).otherwise(40).alias("left"),
        (i * 40 + i % 3 + 32).cast("int").alias("bottom"),
        (F.when(i % 5 == 4, 160).otherwise(40) + F.least(F.length(F.trim(t)) * 8, F.lit(980))).cast("int").alias("right"),
        (i == 0).alias("heading"),
        (i % 7 == 3).alias("clickable"),
        F.when(i % 29 == 28, "com.android.systemui").otherwise("org.example.browser").alias("package"),
    )
    boxes = F.transform(F.split("text", "\n"), box)
    return docs.select("doc_id", boxes.cast(f"array<{L.BOX}>").alias("boxes"))


def box_table(spark, sf):
    """All boxes written as tab-separated lines and read back; boxes without text do not come back."""
    path = f"{checkpoint_root(spark)}/boxes-{uuid.uuid4().hex}"
    rows = screens(spark, sf).select(F.explode("boxes").alias("b")).select(
        "b.text", "b.top", "b.left", "b.bottom", "b.right", F.col("b.heading").alias("isHeading"), F.col("b.clickable").alias("isClickable")
    )
    store.write_boxes(rows, path)
    return store.read_boxes(spark, path).select(
        "text", "top", "left", "bottom", "right", F.col("isHeading").cast("int").alias("heading"), F.col("isClickable").cast("int").alias("clickable")
    )


def noise(spark, sf):
    df = screens(spark, sf)
    rows = F.transform("boxes", lambda b, i: F.struct(i.cast("int").alias("pos"), L.noisy_box(b).cast("int").alias("noisy")))
    return explode_rows(df, rows, "doc_id")


def include(spark, sf):
    df = screens(spark, sf)
    flat = explode_rows(df.withColumn("b", F.transform("boxes", lambda b, i: F.struct(i.cast("int").alias("pos"), b.alias("box")))), "b", "doc_id")
    text = F.when(F.col("pos") % 6 == 5, F.lit("")).otherwise(F.col("box.text"))
    described = F.concat(F.lit("Picture of "), F.col("box.text"))
    widget = F.when(F.col("pos") % 11 == 10, "android.widget.Button").when(F.col("pos") % 13 == 12, "ToolbarView").otherwise("TextView")
    flat = flat.withColumn("text", L.text_candidate(text, described))
    ok = L.included("text", "box.package", widget, "box.clickable", "box.heading")
    return flat.select("doc_id", "pos", "text", ok.cast("int").alias("included"))


def order(spark, sf):
    rows = F.transform(
        L.reading_order("boxes"), lambda r, i: F.struct(i.cast("int").alias("rank"), r.line.alias("line"), r.b.top.alias("top"), r.b.left.alias("left"))
    )
    return explode_rows(screens(spark, sf), rows, "doc_id")


def merged(spark, sf):
    df = screens(spark, sf).withColumn("m", L.merge_boxes(L.in_order(L.quiet_boxes("boxes"))))
    rows = F.transform("m", lambda b, i: F.struct(i.cast("int").alias("rank"), b.text.alias("text"), b.bottom.alias("bottom"), b.right.alias("right")))
    return explode_rows(df, rows, "doc_id")


def edges(spark, sf):
    df = screens(spark, sf).withColumn("m", L.trim_edges("boxes"))
    return explode_rows(df, F.transform("m", lambda b: F.struct(b.top.alias("top"), b.text.alias("text"))), "doc_id")


def off_anchor(spark, sf):
    df = screens(spark, sf).withColumn("m", L.drop_off_anchor("boxes"))
    return explode_rows(df, F.transform("m", lambda b: F.struct(b.top.alias("top"), b.text.alias("text"))), "doc_id")


def screen_texts(spark, sf):
    df = screens(spark, sf)
    rows = F.transform(L.screen_text("boxes"), lambda t, i: F.struct(i.cast("int").alias("pos"), t.alias("text")))
    return explode_rows(df, rows, "doc_id")


def article_parts(spark, sf):
    docs = noisy_documents(spark, sf)
    texts = F.concat(
        F.array(F.concat(F.lit("www.example.com - by "), F.col("source")), F.concat(F.lit("The Report Of "), F.initcap("source")), F.lit("By Jane Field, 3 Mar")),
        F.split("text", "\n"),
        F.array(F.lit("3 replies to this"), F.lit("A reply text that comes after the article.")),
    )
    df = docs.withColumn("texts", F.transform(texts, lambda t: F.trim(t)))
    rows = F.transform(L.article_part("texts"), lambda t, i: F.struct(i.cast("int").alias("pos"), t.alias("text")))
    return explode_rows(df, rows, "doc_id")


def summary_lines(spark, sf):
    turns = read_table(spark, sf, "conversations").filter("role = 'assistant'")
    # first line as overview, the others as bullets in three styles
    lines = F.split("text", "\n")
    style = F.col("turn") % 3
    body = F.array_join(
        F.transform(
            F.slice(lines, F.lit(2), F.size(lines)),
            lambda x, i: F.concat(F.when(style == 0, "\n- ").when((style == 1) & (i % 2 == 0), "\n1. ").when(style == 1, "\n").otherwise(" • "), x),
        ),
        "",
    )
    text = F.concat(F.lit("```text\nOverview: "), lines[0], F.lit(" Key points:"), body, F.lit("```"))
    df = turns.withColumn("lines", S.summary_lines(text))
    rows = F.transform("lines", lambda r, i: F.struct(i.cast("int").alias("pos"), r.kind.alias("kind"), r.text.alias("text")))
    return explode_rows(df, rows, "conv_id", "turn")


QUERIES = {
    "s04_box_table": box_table,
    "l01_box_noise": noise,
    "l02_box_include": include,
    "l03_reading_order": order,
    "l04_box_merge": merged,
    "l05_edge_trim": edges,
    "l06_off_anchor": off_anchor,
    "l06_screen_texts": screen_texts,
    "l07_article_parts": article_parts,
    "n13_summary_lines": summary_lines,
}
