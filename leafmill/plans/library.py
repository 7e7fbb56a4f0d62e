"""Queries over library tables.  The tables are derived from events and pages by fixed rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions.text import epoch_ms, url_host
from leafmill.operators import changes as C
from leafmill.operators import library as J
from leafmill.operators import sentences as S
from leafmill.operators import web as W
from leafmill.operators.blocks import explode_rows, line_blocks
from leafmill.operators.cleanup import numbered_blocks
from leafmill.plans.inputs import cited_blocks, positions, rich_pages
from leafmill.session import written
from leafmill.sources.corpus import document_kind, read_documents, read_pages, read_table, session_is_pdf, split_oversize


def acts(spark, sf):
    """Events with the page they are about and the label under which the page was opened.

    Written once: a query uses it for every kind of event.
    """
    pages = read_table(spark, sf, "pages").select("page_id", "url")
    k = F.get_json_object("props", "$.k").cast("int")
    ev = read_table(spark, sf, "events").withColumn("k", k).withColumn("at", epoch_ms("ts"))
    n_pages = pages.select(F.count(F.lit(1))).scalar()
    ev = ev.withColumn("page_id", (F.col("event_id") * 7 + F.col("k")) % n_pages)
    base = F.regexp_replace(F.regexp_extract("url", "^[^?#]*", 0), "/+$", "")
    label = (
        F.when(F.col("page_id") % 6 == 0, F.concat(base, F.lit(".pdf")))
        .when(F.col("event_id") % 3 == 1, F.concat(base, F.lit("?utm="), F.col("k").cast("string")))
        .when(F.col("event_id") % 3 == 2, F.concat(base, F.lit("/")))
        .otherwise(base)
    )
    rows = ev.join(pages, "page_id").withColumn("source_label", label)
    rows = rows.select(
        "event_id", "user_id", "event_type", "at", "k", "page_id", "source_label", document_kind("source_label").alias("kind"),
        F.concat(F.lit("Page "), (F.col("page_id") % 40).cast("string")).alias("title"),
        F.concat(F.lit("About "), (F.col("page_id") % 25).cast("string")).alias("summary"),
        (F.floor("value") % 200).cast("int").alias("offset"), (F.col("k") % 10).alias("block"),
    )
    return written(rows, "acts")


def opens(a):
    return a.filter("event_type = 'view'").select(
        "event_id", "user_id", "title", "summary", "kind", "source_label", F.col("at").alias("opened_at")
    )


def bookmarks(a):
    rows = a.filter("event_type = 'click'")
    return rows.select(
        "event_id", "user_id", "title",
        F.concat(F.lit("https://example.org/b/"), (F.col("page_id") % 5).cast("string")).alias("source_label"),
        "block", "offset",
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Label "), F.col("k").cast("string"))).alias("label"),
        F.concat(
            F.lit("A passage number "), (F.col("k") % 5).cast("string"), F.lit(" on  page "), (F.col("page_id") % 3).cast("string")
        ).alias("snippet"),
        F.col("at").alias("created_at"),
    )


def _adds(a, parity):
    return a.filter(f"event_type = 'purchase' and event_id % 2 = {parity}").select(
        "event_id", "user_id", "title", "summary", "kind", "source_label", F.col("at").alias("added_at"),
        F.when(F.col("k") % 3 == 0, 1).otherwise(0).alias("is_done"),
    )


def reading_list(a):
    entries = J.reading_list_upsert(_adds(a, 0), _adds(a, 1))
    marks = a.filter("event_type = 'signup'").select(
        "user_id", J.entry_key().alias("key"), "at", (F.col("k") % 2).alias("done")
    )
    return J.set_done(entries, marks)


def store(a):
    rows = a.filter("event_type in ('view', 'purchase', 'error')").select(
        "user_id", "source_label", "kind", F.col("at").alias("modified_at"), "event_id", "k"
    )
    one = J.latest(rows, ["user_id", "source_label"], ["modified_at", "event_id"])
    return one.select(
        "user_id", "source_label", "modified_at", ((F.col("k") + 1) * 1000000).cast("long").alias("bytes"),
        J.usable("kind", "source_label", F.col("k") % 9, F.col("k") % 3, F.col("k") * 20).cast("int").alias("usable"),
        (F.col("k") * 20).alias("chars"),
    )


def source_keys(spark, sf):
    a = acts(spark, sf)
    rows = a.select("source_label").distinct()
    return rows.select(
        "source_label", J.canonical_source("source_label").alias("canonical"), J.browser_identity("source_label").alias("identity"),
        J.www_variant("source_label").alias("www"),
    )


def www_groups(spark, sf):
    pages = read_pages(spark, sf)
    host = J.folded_host(url_host("url"))
    target = F.regexp_replace("url", r"//www\.", "//")
    kept = J.keep_www(F.regexp_replace("url", "//", "//www."), target)
    return pages.groupBy(host.alias("host")).agg(
        F.count(F.lit(1)).alias("pages"), F.sum(kept.contains("//www.").cast("int")).alias("kept_www")
    )


def history_rows(spark, sf):
    a = acts(spark, sf)
    return J.history(opens(a)).select("user_id", "key", "title", "source_label", "opened_at")


def reading_list_rows(spark, sf):
    a = acts(spark, sf)
    return reading_list(a).select("user_id", "key", "title", "summary", "added_at", "is_done")


def bookmark_rows(spark, sf):
    a = acts(spark, sf)
    return J.bookmark_upsert(bookmarks(a)).select("user_id", "source_label", "block", "offset", "event_id")


def nearest_bookmarks(spark, sf):
    a = acts(spark, sf)
    targets = a.filter("event_type = 'view'").select(
        "user_id", F.concat(F.lit("https://example.org/b/"), (F.col("page_id") % 5).cast("string")).alias("source_label"), "block",
        F.col("event_id").alias("target_id"), "offset",
        F.concat(F.lit("a passage number "), (F.col("k") % 5).cast("string"), F.lit(" on page")).alias("snippet"),
    )
    return J.nearest_bookmark(targets, bookmarks(a)).select("target_id", "offset")


def bookmark_spans(spark, sf):
    blocks = numbered_blocks(cited_blocks(spark, sf))
    rows = positions(spark, sf).join(blocks, ["doc_id", "block"]).filter("text <> ''")
    snippet = F.when(F.col("event_id") % 2 == 0, F.substr("text", F.col("offset") + 4, F.lit(30))).otherwise(F.lit("no such text"))
    rows = rows.withColumn("snippet", snippet)
    first, last = J.bookmark_span("text", "offset", "snippet")
    start = J.sentence_start(F.col("text"), F.least(F.col("offset"), F.length("text") - 1))
    return rows.select("event_id", first.alias("first"), last.alias("last"), start.alias("sentence_start"))


def section_enrichment(spark, sf):
    sections = explode_rows(
        cited_blocks(spark, sf).withColumn(
            "s", F.transform(S.section_of("blocks", "title"), lambda b, i: F.struct(i.cast("int").alias("block"), b.section.alias("found")))
        ),
        "s", "doc_id",
    )
    marks = positions(spark, sf).withColumn(
        "heading", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Kept "), F.col("k").cast("string")))
    )
    return marks.join(sections, ["doc_id", "block"], "left").select(
        "event_id", F.coalesce("heading", "found").alias("section")
    )


def full_bookmarks(a):
    """Bookmarks under the label of their document."""
    marks = bookmarks(a).drop("source_label").join(a.select("event_id", "source_label"), "event_id")
    return J.bookmark_upsert(marks)


def last_labels(a):
    return J.latest(a.select("user_id", "source_label", "at", "event_id"), ["user_id"], ["at", "event_id"]).select(
        "user_id", "source_label"
    )


def history_overview(spark, sf):
    a = acts(spark, sf)
    h = J.history(opens(a))
    counts = full_bookmarks(a).groupBy("user_id", "source_label").agg(F.count(F.lit(1)).alias("bookmarks"))
    listed = reading_list(a).select("user_id", "source_label", F.lit(1).alias("listed")).distinct()
    return (
        h.join(counts, ["user_id", "source_label"], "left")
        .join(listed, ["user_id", "source_label"], "left")
        .select(
            "user_id", "kind", "source_label", F.coalesce("bookmarks", F.lit(0)).alias("bookmarks"),
            F.coalesce("listed", F.lit(0)).alias("listed"),
        )
    )


def bookmark_search(spark, sf):
    a = acts(spark, sf)
    rows = J.bookmark_groups(bookmarks(a), "Passage number 3 on  PAGE", "https://example.org/b/2")
    return rows.select("user_id", "source_label", "is_current", "group_latest", "block", "offset", "event_id")


def reading_list_split(spark, sf):
    a = acts(spark, sf)
    return reading_list(a).groupBy("user_id").agg(
        F.sum(1 - F.col("is_done")).alias("to_read"), F.sum("is_done").alias("done")
    )


def delete_cascade(spark, sf):
    """History items deleted by error events: files, bookmarks and progress of their sources go too, unless the
    reading list keeps the source; a last-opened source that is gone is replaced."""
    a = acts(spark, sf)
    source = ["user_id", "source_label"]
    gone = a.filter("event_type = 'error'").select(*source).distinct()
    listed = reading_list(a)
    cleared = gone.join(listed.select(*source).distinct(), source, "left_anti")
    left = J.history(opens(a)).join(gone, source, "left_anti")
    files = store(a).join(cleared, source, "left_anti")
    marks = full_bookmarks(a).join(cleared, source, "left_anti")
    keys = cleared.select("user_id", F.explode(J.progress_keys("source_label")).alias("key")).distinct()
    progress = J.progress_table(a).join(keys, ["user_id", "key"], "left_anti")
    newest = left.groupBy("user_id").agg(F.max_by("source_label", F.struct("opened_at", "event_id")).alias("from_history"))
    first = listed.groupBy("user_id").agg(F.max_by("source_label", F.struct("added_at", "key")).alias("from_list"))
    last = last_labels(a).join(gone.withColumn("is_gone", F.lit(True)), source, "left")
    n = lambda t, c: t.groupBy("user_id").agg(F.count(F.lit(1)).alias(c))
    out = last
    for table, name in ((left, "history_left"), (files, "files_left"), (marks, "bookmarks_left"), (progress, "progress_left")):
        out = out.join(n(table, name), "user_id", "left")
    return out.join(newest, "user_id", "left").join(first, "user_id", "left").select(
        "user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("history_left", "files_left", "bookmarks_left", "progress_left")],
        F.when(F.col("is_gone"), F.coalesce("from_history", "from_list")).otherwise(F.col("source_label")).alias("last_opened"),
    )


# ----- the change log --------------------------------------------------------------------------
HOUR_MS = 3_600_000


def _narrow(spark, sf):
    """Acts on five sources of a user, so that the log has many changes of one entry."""
    label = F.concat(F.lit("https://example.org/b/"), (F.col("page_id") % 5).cast("string"))
    rows = acts(spark, sf).withColumn("source_label", label).withColumn("kind", F.lit("WEB"))
    return rows.withColumn("key", J.entry_key()).withColumn("seq", F.col("event_id"))


def _list_versions(a):
    """Purchases add, sign-ups mark, each fifth of them removes."""
    gone = F.col("k") % 5 == 0
    op = F.when(F.col("event_type") == "purchase", "add").otherwise(F.when(gone, "remove").otherwise("done"))
    changes = a.filter("event_type in ('purchase', 'signup')").select(
        "user_id", "key", "at", "seq", op.alias("op"), "title", "summary", "source_label", (F.col("k") % 2).alias("done")
    )
    return C.reading_list_versions(changes)


def _cascades(a, versions):
    """Errors delete a history item."""
    deletes = a.filter("event_type = 'error'").select("user_id", "source_label", "at", "seq")
    return C.cascades(deletes, versions)


def _bookmark_versions(a, cascades):
    """Clicks bookmark; some are renamed half an hour later, some deleted after an hour."""
    click = a.filter("event_type = 'click'").withColumn("created_at", F.col("at"))
    named = click.filter("k % 7 in (1, 2)").select(
        *C.IDENTITY, (F.col("at") + HOUR_MS // 2).alias("at"), "seq", F.concat(F.lit("  New  label "), F.col("k").cast("string")).alias("new_label")
    )
    gone = click.filter("k % 7 = 3").select(*C.IDENTITY, (F.col("at") + HOUR_MS).alias("gone_at"), F.col("seq").alias("gone_seq"))
    return C.bookmark_versions(click, named, gone, cascades.filter(~F.col("preserved")))


def reading_list_log(spark, sf):
    return _list_versions(_narrow(spark, sf))


def bookmark_log(spark, sf):
    a = _narrow(spark, sf)
    return _bookmark_versions(a, _cascades(a, _list_versions(a)))


def cascade_log(spark, sf):
    """Deleted history items, whether the list kept their source, and the bookmarks that went with it."""
    a = _narrow(spark, sf)
    told = _cascades(a, _list_versions(a))
    went = _bookmark_versions(a, told).select("user_id", "source_label", F.col("to_at").alias("at"), F.col("to_seq").alias("seq"))
    lost = went.groupBy("user_id", "source_label", "at", "seq").agg(F.count("*").alias("bookmarks_gone"))
    return told.join(lost, ["user_id", "source_label", "at", "seq"], "left").select(
        F.col("seq").alias("event_id"), "user_id", "source_label", "preserved", F.coalesce("bookmarks_gone", F.lit(0)).alias("bookmarks_gone")
    )


def _known(a):
    """Sources that protect a stored document: history, bookmarks, reading list, last opened."""
    return J.known_sources(J.history(opens(a)), full_bookmarks(a), reading_list(a), last_labels(a))


def protected_keys(spark, sf):
    return _known(acts(spark, sf))


def orphans(spark, sf):
    a = acts(spark, sf)
    return J.orphan_report(store(a), _known(a))


# limits of the retention query: parameters of the caller
STORE_FILES = 24
STORE_BYTES = 96 * 1024 * 1024


def retention(spark, sf):
    """Files outside the limits that no history, bookmark, list or last-opened entry protects."""
    a = acts(spark, sf)
    return J.evictions(store(a), _known(a), STORE_FILES, STORE_BYTES)


def usability(spark, sf):
    df = W.extract_pages(rich_pages(spark, sf))
    args = (F.lit("WEB"), F.col("url"), F.col("n_paragraphs"), F.col("n_headings"), F.col("n_chars"))
    return df.select(
        "page_id", J.usable(*args).cast("int").alias("usable"), J.strong_remote(*args).cast("int").alias("strong")
    )


def cache_lookup(spark, sf):
    a = acts(spark, sf)
    requests = a.filter("event_type = 'view'").select("user_id", "source_label").distinct()
    known = J.latest(opens(a), ["user_id", "source_label"], ["opened_at", "event_id"]).select(
        "user_id", "source_label", (-F.col("opened_at")).alias("order")
    )
    # all files stay; those whose length leaves 20 over 40 count as unusable, so that the fallback is used
    kept = store(a).withColumn("usable", F.when(F.col("chars") % 40 == 20, 0).otherwise(F.col("usable")))
    return J.lookup(requests, kept, known)


def progress_rows(spark, sf):
    a = acts(spark, sf)
    moves = a
    table = J.progress_table(moves)
    requests = moves.filter("event_type = 'view'").select("user_id", "source_label").distinct()
    return J.read_progress(requests, table)


def last_opened(spark, sf):
    """Preferred stored document (of the last event), else the newest history row that has one."""
    a = acts(spark, sf)
    files = store(a).filter("usable = 1").select("user_id", "source_label")
    last = last_labels(a)
    preferred = last.join(files, ["user_id", "source_label"]).select("user_id", F.col("source_label").alias("preferred"))
    h = J.history(opens(a)).join(files, ["user_id", "source_label"])
    newest = h.groupBy("user_id").agg(F.max_by("source_label", F.struct("opened_at", "event_id")).alias("newest"))
    return last.select("user_id").join(preferred, "user_id", "left").join(newest, "user_id", "left").select(
        "user_id", F.coalesce("preferred", "newest").alias("document")
    )


def store_summary(spark, sf):
    return read_documents(spark, sf).agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text")).alias("bytes"))


def _captures(spark, sf, session):
    """Two captures of every document; a seventh of each kind is absent, which is an empty text, not a missing row."""
    docs = read_documents(spark, sf)
    lines = F.split("text", "\n")
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    cut = F.array_join(F.filter(lines, lambda x, i: (i + F.col("doc_id")) % 3 != 0), "\n\n")
    more = F.concat(text, F.lit("\n\nOne more line of text, at the end of it."))
    even, odd, absent = (cut, more, 1) if session else (text, cut, 2)
    taken = F.when(F.col("doc_id") % 7 == absent, F.lit("")).when(F.col("doc_id") % 2 == 0, even).otherwise(odd)
    return docs.withColumn("given_title", F.col("source")).withColumn("text", taken)


def capture_choice(spark, sf):
    v = J.capture_quality(_captures(spark, sf, False))
    s = J.capture_quality(_captures(spark, sf, True))
    df = J.choose_capture(v, s)
    picked = F.when(F.col("choice") == "session", F.col("s")).otherwise(F.col("v"))
    beats = F.when(F.col("choice").isNotNull(), J.beats_remote(picked, F.col("doc_id") % 3, F.lit(1), (F.col("doc_id") % 40) * 10))
    return df.select("doc_id", "choice", F.coalesce(beats, F.lit(False)).cast("int").alias("beats_remote"))


def window_union(spark, sf):
    docs = line_blocks(read_documents(spark, sf))
    rows = explode_rows(docs, "blocks", "doc_id").withColumnRenamed("doc_id", "session").select("session", "pos", "text")
    return J.visible_then_exposed(rows.filter("pos % 3 = 1"), rows)


def document_kinds(spark, sf):
    a = acts(spark, sf)
    rows = a.select("source_label").distinct()
    return rows.select(
        "source_label", document_kind("source_label").alias("kind"), session_is_pdf("source_label").cast("int").alias("session_pdf")
    )


def oversize_inputs(spark, sf):
    accepted, refused = split_oversize(read_pages(spark, sf), "html", 6000)
    mark = lambda df, name: df.select("page_id", F.octet_length("html").alias("bytes"), F.lit(name).alias("route"))
    return mark(accepted, "accepted").unionByName(mark(refused, "quarantined"))


QUERIES = {
    "s05_document_kinds": document_kinds,
    "s06_oversize_inputs": oversize_inputs,
    "j01_source_keys": source_keys,
    "j02_www_groups": www_groups,
    "j03_history": history_rows,
    "j04_reading_list": reading_list_rows,
    "j04_reading_list_log": reading_list_log,
    "j05_bookmark_log": bookmark_log,
    "j05_bookmarks": bookmark_rows,
    "j06_nearest_bookmarks": nearest_bookmarks,
    "j07_bookmark_spans": bookmark_spans,
    "j08_section_enrichment": section_enrichment,
    "j09_history_overview": history_overview,
    "j10_bookmark_search": bookmark_search,
    "j11_reading_list_split": reading_list_split,
    "j12_delete_cascade": delete_cascade,
    "j12_cascade_log": cascade_log,
    "j13_protected_keys": protected_keys,
    "j14_orphans": orphans,
    "j15_retention": retention,
    "j16_usability": usability,
    "j17_cache_lookup": cache_lookup,
    "j18_progress": progress_rows,
    "j19_last_opened": last_opened,
    "j20_store_summary": store_summary,
    "j21_capture_choice": capture_choice,
    "j22_window_union": window_union,
}
