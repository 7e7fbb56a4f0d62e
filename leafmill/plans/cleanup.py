"""Queries over model clean-up batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from leafmill.operators import cleanup as C
from leafmill.operators import sentences as S
from leafmill.operators.blocks import explode_blocks, explode_rows
from leafmill.session import written
from leafmill.sources.store import from_json_line, to_json_line
from leafmill.plans.inputs import cited_blocks, model_paragraphs


def _both(make):
    return reduce(lambda a, b: a.unionByName(b), [make(p) for p in C.PROFILES.values()])


def _paragraphs(spark, sf):
    rows = explode_blocks(cited_blocks(spark, sf), "doc_id").filter("type = 'Paragraph'")
    return rows.withColumn("text", C.paragraph("text"))


def eligibility(spark, sf):
    return _paragraphs(spark, sf).select(
        "doc_id", "pos", *[C.eligible("text", p).cast("int").alias(n.lower()) for n, p in C.PROFILES.items()]
    )


def _chunks(spark, sf, profile):
    return C.cleanup_chunks(cited_blocks(spark, sf), profile)


def chunk_packing(spark, sf):
    return _both(lambda p: _chunks(spark, sf, p)).select(
        "profile", "doc_id", "chunk", F.array_join(F.transform("idx", lambda i: i.cast("string")), ",").alias("idx"),
        F.array_join("paras", "|").alias("paras"),
    )


def chunk_context(spark, sf):
    return _both(lambda p: _chunks(spark, sf, p)).select("profile", "doc_id", "chunk", "before", "after")


def prompts(spark, sf):
    return _both(lambda p: _chunks(spark, sf, p).select("profile", "doc_id", "chunk", C.cleanup_prompt(p).alias("prompt")))


def summary_prompts(spark, sf):
    return cited_blocks(spark, sf).select(
        "doc_id", C.summary_prompt("title", S.summary_source("blocks")).alias("prompt")
    )


def response_split(spark, sf):
    rows = _both(lambda p: _chunks(spark, sf, p))
    sep = F.when(F.col("chunk") % 3 == 0, C.BREAK).when(F.col("chunk") % 3 == 1, "\r\n \n").otherwise("\n")
    response = F.concat(F.lit("```\n"), F.concat_ws("", F.transform("paras", lambda p, i: F.when(i == 0, p).otherwise(F.concat(sep, p)))), F.lit("```"))
    got = C.split_response(response, F.size("paras"))
    return rows.select("profile", "doc_id", "chunk", F.size(got).alias("n"), F.array_join(got, "|").alias("text"))


def token_sets(spark, sf):
    join = lambda a: F.array_join(F.array_sort(a), " ")
    return _paragraphs(spark, sf).select(
        "doc_id", "pos", join(C.important_tokens("text")).alias("important"),
        join(C.protected_tokens("text")).alias("protected"), join(C.content_tokens("text")).alias("content"),
    )


def neighbour_similarity(spark, sf):
    rows = F.transform(
        F.filter("blocks", lambda b: b.type == "Paragraph"),
        lambda b: F.struct(b.pos.alias("pos"), C.content_tokens(b.text).alias("t")),
    )
    df = cited_blocks(spark, sf).withColumn("ps", rows)
    pairs = F.filter(
        F.transform(
            "ps",
            lambda p, i: F.struct(
                p.pos.alias("pos"), F.when(i > 0, F.round(C.similarity(F.get("ps", i - 1).t, p.t), 6)).alias("similarity")
            ),
        ),
        lambda r: r.similarity.isNotNull(),
    )
    return explode_blocks(df.withColumn("pairs", pairs), "doc_id", blocks="pairs")


def _rewritten(spark, sf, profile):
    rows = _chunks(spark, sf, profile).withColumn(
        "cleaned", model_paragraphs(F.col("doc_id"), F.col("chunk"), F.col("paras"))
    )
    failure = F.when((F.col("doc_id") * 5 + F.col("chunk")) % 13 == 12, F.lit("TimeoutError: model took too long"))
    return C.validated(rows.withColumn("failure", failure), profile)


def validation(spark, sf):
    return _both(lambda p: _rewritten(spark, sf, p)).select("profile", "doc_id", "chunk", "reason")


def duplication(spark, sf):
    rows = _both(lambda p: _rewritten(spark, sf, p))
    same = F.size("paras") == F.size("cleaned")
    return rows.select(
        "profile", "doc_id", "chunk",
        F.when(same, C.duplicated(F.col("paras"), F.col("cleaned"))).otherwise(F.lit(False)).cast("int").alias("duplicated"),
    )


def _changed_pairs(rows):
    pairs = F.when(
        F.col("reason").isNull(),
        F.transform(
            F.arrays_zip(F.col("idx").alias("block"), F.col("paras").alias("before"), F.col("cleaned").alias("after")),
            lambda z: F.struct(
                z["block"].alias("block"), z["before"].alias("before"),
                F.when(z["after"] == C.DROP, "").otherwise(C.paragraph(z["after"])).alias("after"),
            ),
        ),
    )
    return explode_rows(rows, pairs, "profile", "doc_id", "chunk").filter("before <> after")


def _pairs(spark, sf, profile):
    return _changed_pairs(_rewritten(spark, sf, profile))


def change_kind_rows(spark, sf):
    return _both(
        lambda p: _pairs(spark, sf, p).select(
            "profile", "doc_id", "block", F.array_join(C.change_kinds("before", "after", p), ",").alias("kinds")
        )
    )


def applied(spark, sf):
    blocks = C.numbered_blocks(cited_blocks(spark, sf))

    def of(p):
        done = C.apply_rewrites(blocks, C.rewrites(_rewritten(spark, sf, p)))
        return done.select(F.lit(p.name).alias("profile"), "doc_id", "block", "type", "text", F.col("changed").cast("int").alias("changed"))

    return _both(of)


def diagnostics(spark, sf):
    return C.run_diagnostics(_both(lambda p: _rewritten(spark, sf, p)), "profile", "doc_id")


def run_reports(spark, sf):
    """Nested run records as JSON lines and back; the figures of a document are sums over its chunks' reports."""
    runs = _both(lambda p: C.run_reports(_rewritten(spark, sf, p), p, "cleaner", 1).withColumn("profile", F.lit(p.name)))
    lines = runs.select("profile", "doc_id", to_json_line(F.struct("diagnostics")).alias("line"))
    back = lines.withColumn("d", from_json_line("line").getField("diagnostics"))
    reports = F.col("d.chunkReports")
    total = lambda of: F.aggregate(reports, F.lit(0), lambda a, r: a + of(r)).cast("long")
    accepted = lambda r: (r["status"] != "Rejected").cast("int")
    return back.select(
        "profile", "doc_id", F.size(reports).cast("long").alias("chunks"), total(lambda r: r["targetParagraphCount"]).alias("eligible"),
        total(accepted).alias("accepted"), total(lambda r: 1 - accepted(r)).alias("rejected"),
        total(lambda r: F.size(r["paragraphReports"])).alias("changed"),
        total(lambda r: F.size(F.filter(r["paragraphReports"], lambda p: p["afterText"] == ""))).alias("dropped"),
        total(lambda r: r["originalChars"]).alias("chars_before"),
        total(lambda r: F.coalesce(r["cleanedChars"], r["originalChars"])).alias("chars_after"),
    )


def diagnostics_rollup(spark, sf):
    rows = _both(lambda p: _rewritten(spark, sf, p))
    per_doc = C.run_diagnostics(rows, "profile", "doc_id", "source").withColumn(
        "size_class", F.when(F.col("chunks") > 5, "long").otherwise("short")
    )
    return per_doc.rollup("source", "size_class").agg(
        F.sum("chunks").alias("chunks"), F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")
    )


def rejection_counts(spark, sf):
    return C.ranked_counts(_both(lambda p: _rewritten(spark, sf, p)), "reason", nulls=False)


def diffs(spark, sf):
    blocks = C.numbered_blocks(cited_blocks(spark, sf)).withColumn("text", C.paragraph("text"))
    # validation is the costly step and three branches of each profile need its result: it is done once
    chunks = _both(lambda p: _rewritten(spark, sf, p))
    chunks = written(chunks.select("profile", "doc_id", "chunk", "idx", "paras", "cleaned", "reason"), "validated-chunks")

    def of(p):
        rows = chunks.filter(F.col("profile") == p.name)
        after = C.apply_rewrites(blocks, C.rewrites(rows))
        # stored reports exist for every second document only
        reported = _changed_pairs(rows).withColumn("before", F.when(F.col("doc_id") % 2 == 0, F.col("before")))
        return C.diff_rows(blocks, after, reported).withColumn("profile", F.lit(p.name))

    return _both(of)


def _done(spark, sf):
    docs = cited_blocks(spark, sf)
    return docs.select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, "model-a").otherwise("model-b").alias("model"),
        (F.lit(C.PROMPT_VERSION) - 1 + F.col("doc_id") % 4).cast("int").alias("version"),
        F.when(F.col("doc_id") % 5 == 0, "stale").otherwise(C.text_signature(S.summary_source("blocks"))).alias("signature"),
    )


def skip_current(spark, sf):
    docs = cited_blocks(spark, sf).select("doc_id", C.text_signature(S.summary_source("blocks")).alias("signature"))
    done = _done(spark, sf)
    rewrite = C.pending(docs.select("doc_id"), done, "model-a", C.PROMPT_VERSION).withColumn("task", F.lit("rewrite"))
    summary = C.pending(docs, done, "model-a", C.PROMPT_VERSION, signature=True).select(
        "doc_id", F.lit("summary").alias("task")
    )
    return rewrite.unionByName(summary)


def signatures(spark, sf):
    return cited_blocks(spark, sf).select(
        "doc_id", C.content_signature("source", "blocks").alias("content"),
        C.text_signature(S.summary_source("blocks")).alias("summary_source"), C.text_signature("source").alias("cache_key"),
    )


def failure_counts(spark, sf):
    rows = _both(lambda p: _chunks(spark, sf, p))
    kind = F.when(F.col("chunk") % 2 == 0, "TimeoutError").otherwise("ValueError")
    message = F.concat(F.lit(" no  answer for "), F.col("source"))
    root = F.when(F.col("doc_id") % 3 == 0, "OSError").otherwise(kind)
    digest = C.digest_column(kind, message, root, F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(message))
    return C.ranked_counts(rows.withColumn("digest", digest), "digest")


QUERIES = {
    "c01_eligibility": eligibility,
    "c02_chunk_packing": chunk_packing,
    "c03_chunk_context": chunk_context,
    "c04_prompts": prompts,
    "c04_summary_prompts": summary_prompts,
    "c05_response_split": response_split,
    "c06_token_sets": token_sets,
    "c07_neighbour_similarity": neighbour_similarity,
    "c08_validation": validation,
    "c09_duplication": duplication,
    "c10_change_kinds": change_kind_rows,
    "c11_applied": applied,
    "c12_diagnostics": diagnostics,
    "c12_diagnostics_rollup": diagnostics_rollup,
    "c12_run_reports": run_reports,
    "c13_rejection_counts": rejection_counts,
    "c14_diffs": diffs,
    "c16_skip_current": skip_current,
    "c17_signatures": signatures,
    "c18_failure_counts": failure_counts,
}
