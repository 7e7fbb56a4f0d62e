"""Queries over paged text."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import paged as L
from leafmill.functions.text import signature
from leafmill.operators import paged as P
from leafmill.operators.blocks import explode_rows
from leafmill.plans.inputs import PAGE_SIZE, paged_documents
from leafmill.sources.corpus import page_lines, read_documents, read_table


def page_line_table(spark, sf):
    return page_lines(read_documents(spark, sf))


def _lines(spark, sf):
    docs = paged_documents(spark, sf)
    return docs.select(
        "doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "raw")
    ).withColumn("text", F.trim(L.repair("raw")))


def _pages(spark, sf):
    return P.to_pages(paged_documents(spark, sf), PAGE_SIZE)


def _clean(spark, sf):
    return P.clean_lines(_pages(spark, sf).withColumn("title", F.col("given_title")))


def line_repair(spark, sf):
    return _lines(spark, sf).select("doc_id", "pos", "text")


def running_lines(spark, sf):
    rows = _pages(spark, sf).withColumn(
        "sigs", F.transform(F.filter(F.flatten("pages"), L.running_candidate), signature)
    )
    times = F.when(F.size("pages") <= 2, 2).otherwise(3)
    return rows.select("doc_id", F.explode_outer(P.repeated(F.col("sigs"), times)).alias("sig")).filter(
        "sig is not null"
    )


def corpus_running_lines(spark, sf):
    return P.corpus_running_lines(_lines(spark, sf), "source", 3)


def front_protection(spark, sf):
    df = _pages(spark, sf)
    return df.select("doc_id", F.explode_outer(P.protected(F.col("pages")[0])).alias("sig")).filter("sig is not null")


def pattern_lines(spark, sf):
    return _lines(spark, sf).select(
        "doc_id", "pos", L.pattern_line("text", F.col("pos") < PAGE_SIZE).cast("int").alias("dropped")
    )


def page_footnotes(spark, sf):
    df = _pages(spark, sf)
    rows = F.transform(
        "pages",
        lambda p, i: F.struct(i.cast("int").alias("page"), P.page_parts(p).note.alias("note")),
    )
    return explode_rows(df, rows, "doc_id").filter("note is not null")


def titles(spark, sf):
    return _pages(spark, sf).select("doc_id", P.infer_title("pages", "given_title").alias("title"))


def line_types(spark, sf):
    return _lines(spark, sf).select(
        "doc_id",
        "pos",
        L.boundary("text").cast("int").alias("boundary"),
        L.heading("text").cast("int").alias("heading"),
        L.metadata("text").cast("int").alias("metadata"),
        L.prose("text").cast("int").alias("prose"),
        L.author_line("text").cast("int").alias("author"),
        L.footnote_start("text").cast("int").alias("footnote"),
    )


def _folded(spark, sf):
    df = _clean(spark, sf)
    return df.withColumn("fold", P.front_and_body(F.col("lines"), "title"))


def front_matter(spark, sf):
    df = _folded(spark, sf)
    rows = F.transform("fold.meta", lambda b, i: F.struct(i.alias("pos"), b.type.alias("type"), b.text.alias("text")))
    return explode_rows(df, rows, "doc_id")


def assembled(spark, sf):
    """Lines between blank or finished lines joined with the hyphen rules."""
    df = paged_documents(spark, sf).withColumn(
        "runs", F.split(F.regexp_replace("text", r"([.!?])\n", "$1\n\n"), "\n\n")
    )
    rows = F.transform("runs", lambda r, i: F.struct(i.alias("pos"), L.assemble(F.split(r, "\n")).alias("text")))
    return explode_rows(df, rows, "doc_id")


def prefix_splits(spark, sf):
    rows = _lines(spark, sf).withColumn(
        "text", F.concat(F.lit("Harbour University, Department of Rivers, Jane Field "), F.col("text"))
    )
    split = L.split_prefix("text", F.lit("A Title"))
    return explode_rows(rows, F.array_compact(F.array(split)), "doc_id", "pos")


def _moved(spark, sf):
    df = _folded(spark, sf)
    df = df.withColumn("meta", F.col("fold.meta")).withColumn("body", F.col("fold.body")).drop("fold")
    return P.move_front_matter(df)


def front_matter_move(spark, sf):
    df = _moved(spark, sf)
    return df.select(
        "doc_id", F.size("meta").alias("n_meta"), F.size("body").alias("n_body"),
        F.get("body", F.lit(0)).text.alias("first_text"),
    )


def abstracts(spark, sf):
    df = P.take_abstract(_moved(spark, sf))
    return df.select(
        "doc_id", "abstract_case", F.size("meta").alias("n_meta"), F.size("body").alias("n_body"),
        F.try_element_at("meta", F.lit(-1)).text.alias("last_meta"),
    )


def _talk(spark, sf):
    """Conversations as documents: every line of every turn is a block; the first line of a turn may name its speaker."""
    mark = F.when(F.col("turn") % 3 == 1, F.concat("role", F.lit(": "))).when(F.col("turn") % 3 == 2, "(a) ").otherwise("")
    kind = F.when(F.col("turn") % 5 == 4, "Heading").otherwise("Paragraph")
    lines = F.transform(F.split("text", "\n"), lambda t, i: P.block(kind, F.when(i == 0, F.concat(mark, t)).otherwise(t)))
    turns = read_table(spark, sf, "conversations").select("conv_id", F.struct("turn", lines.alias("lines")).alias("b"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("b")).alias("turns")).withColumn(
        "body", F.flatten(F.transform("turns", lambda t: t.lines))
    )


def figure_sections(spark, sf):
    df = _talk(spark, sf).withColumn("runs", P.figure_runs(F.col("body")))
    rows = F.concat(
        F.transform("runs.kept", lambda b, i: F.struct(F.lit("kept").alias("part"), i.alias("pos"), b.text.alias("text"))),
        F.transform("runs.notes", lambda n, i: F.struct(F.lit("note").alias("part"), i.alias("pos"), n.alias("text"))),
    )
    return explode_rows(df, rows, "conv_id")


def tabular_lines(spark, sf):
    return _lines(spark, sf).select("doc_id", "pos", L.tabular("text").cast("int").alias("tabular"))


def short_merge(spark, sf):
    df = _pages(spark, sf).withColumn(
        "body",
        F.transform(
            F.filter(F.flatten("pages"), lambda x: x != ""),
            lambda x: P.block(F.when(L.heading(x), "Heading").otherwise("Paragraph"), x),
        ),
    )
    rows = F.transform(
        P.merge_short(F.col("body")), lambda b, i: F.struct(i.alias("pos"), b.type.alias("type"), b.text.alias("text"))
    )
    return explode_rows(df, rows, "doc_id")


def _formatted(spark, sf):
    return P.format_pages(_pages(spark, sf))


def formatted(spark, sf):
    df = _formatted(spark, sf)
    text = lambda c: F.array_join(F.transform(c, lambda b: b.text), "|")
    return df.select(
        "doc_id", "title", text("meta").alias("metadata"), text("body").alias("content"),
        F.array_join("notes", "|").alias("footnotes"),
    )


def _candidates(spark, sf):
    """Two readings of one document: as given, and with lines cut at every sentence."""
    docs = paged_documents(spark, sf)
    second = docs.withColumn("text", F.regexp_replace("text", r"([.!?]) ", "$1\n"))
    both = docs.withColumn("engine", F.lit("first")).unionByName(second.withColumn("engine", F.lit("second")))
    df = P.format_pages(P.to_pages(both, PAGE_SIZE))
    return df.select("doc_id", "engine", P.selection_score("meta", "body", "notes").alias("score"))


def candidate_scores(spark, sf):
    return _candidates(spark, sf)


def best_candidates(spark, sf):
    # the engine that is not 'first' wins a tie
    best = F.max_by("engine", F.struct("score", (F.col("engine") != "first").alias("tie")))
    return _candidates(spark, sf).groupBy("doc_id").agg(best.alias("engine"), F.max("score").alias("score"))


QUERIES = {
    "s03_page_lines": page_line_table,
    "p01_line_repair": line_repair,
    "p02_running_lines": running_lines,
    "p02_corpus_running_lines": corpus_running_lines,
    "p03_front_protection": front_protection,
    "p04_pattern_lines": pattern_lines,
    "p05_page_footnotes": page_footnotes,
    "p06_titles": titles,
    "p07_line_types": line_types,
    "p08_front_matter": front_matter,
    "p09_assembled": assembled,
    "p10_prefix_splits": prefix_splits,
    "p11_front_matter_move": front_matter_move,
    "p12_abstracts": abstracts,
    "p13_figure_sections": figure_sections,
    "p14_tabular_lines": tabular_lines,
    "p15_short_merge": short_merge,
    "p16_formatted": formatted,
    "p17_candidate_scores": candidate_scores,
    "p18_best_candidates": best_candidates,
}
