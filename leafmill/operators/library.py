"""Per-user library tables: history, reading list, bookmarks, progress, stored documents.

"Latest per key" is an aggregation with map-side combine, never a sort of a whole user.
Top-k limits use ranked windows, which Spark limits per task before the exchange, so a user
who owns a third of all rows stays cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import col, collapse, token_key
from leafmill.operators.blocks import peel_plain_text

# --- fixed values: limits of the library ---
OFFSET_TOLERANCE = 3
MATCH_TOLERANCE = 12
SNIPPET_MIN = 16
SPAN_PREFIX, SPAN_CHARS = 96, 220
QUALITY_MARGIN = 160


# ----- keys -------------------------------------------------------------------------------
def canonical_source(label) -> Column:
    """scheme://host/path in lower case without query, fragment and closing '/'; other labels as tokens."""
    label = col(label)
    scheme = F.regexp_extract(label, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    host = F.regexp_extract(label, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    path = F.regexp_extract(label, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    key = F.lower(F.concat(scheme, F.lit("://"), host, F.regexp_replace(path, "/+$", "")))
    return F.when(scheme == "", token_key(label)).otherwise(key)


def browser_identity(label) -> Column:
    """The second identity: keeps the query and the case of the path."""
    label = F.regexp_replace(F.trim(col(label)), r"\s*#.*$", "")
    head = r"(?i)^(https?)://(?:[^/?#@]*@)?([^/?#:]+)(?::\d+)?([^?]*)(?:\?(.*))?$"
    part = lambda i: F.regexp_extract(label, head, i)
    query = F.when(part(4) != "", F.concat(F.lit("?"), part(4))).otherwise("")
    web = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.regexp_replace(part(3), "/+$", ""), query)
    return F.when(label.rlike(head), web).otherwise(F.lower(F.regexp_replace(label, "/+$", "")))


def folded_host(host) -> Column:
    return F.regexp_replace(F.lower(col(host)), r"^www\.", "")


def www_variant(url) -> Column:
    """The url with 'www.' when its host has two labels and none yet, else null."""
    head = r"(?i)^(https?://)([^/?#:@]+)(.*)$"
    host = F.regexp_extract(col(url), head, 2)
    fits = col(url).rlike(head) & ~F.lower(host).startswith("www.") & (F.regexp_count(host, F.lit(r"\.")) == 1)
    return F.when(fits, F.regexp_replace(col(url), head, "$1www.$2$3"))


def keep_www(current, target) -> Column:
    """Redirect target with the www host kept when it only drops 'www.'."""
    head = r"(?i)^(https?://)([^/?#:@]+)(.*)$"
    old = F.lower(F.regexp_extract(col(current), head, 2))
    new = F.lower(F.regexp_extract(col(target), head, 2))
    kept = F.concat(
        F.regexp_extract(col(target), head, 1), F.regexp_extract(col(current), head, 2), F.regexp_extract(col(target), head, 3)
    )
    return F.when(old.startswith("www.") & (F.concat(F.lit("www."), new) == old), kept).otherwise(col(target))


def entry_key(kind="kind", source="source_label", title="title", summary="summary", chars: int | None = None) -> Column:
    """Dedupe key of history and reading list: web by canonical source, paged by title and whole summary, or by the first
    ``chars`` characters of it if a number is given."""
    begun = F.substring(col(summary), 1, chars) if chars else col(summary)
    paged = F.concat(F.lit("pdf|"), token_key(title), F.lit("|"), token_key(begun))
    return F.when(col(kind) == "PDF", paged).otherwise(F.concat(F.lit("web|"), canonical_source(source)))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key; combines map-side, no sort."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def top(rows: DataFrame, user: str, order: list, k: int | None) -> DataFrame:
    """All rows, or the first ``k`` of each user with their ``rank``."""
    if k is None:
        return rows
    w = Window.partitionBy(user).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# ----- history and reading list --------------------------------------------------------------
def history(opens: DataFrame, kept: int | None = None) -> DataFrame:
    """Latest open per user and key; the newest ``kept`` of each user if a number is given."""
    rows = latest(opens.withColumn("key", entry_key()), ["user_id", "key"], ["opened_at", "event_id"])
    return top(rows, "user_id", [F.desc("opened_at"), F.desc("event_id")], kept)


def reading_list_upsert(existing: DataFrame, added: DataFrame) -> DataFrame:
    """New entries over existing ones: title and summary of the new, added_at and done flag of the old."""
    old = latest(existing.withColumn("key", entry_key()), ["user_id", "key"], ["added_at", "event_id"])
    new = latest(added.withColumn("key", entry_key()), ["user_id", "key"], ["added_at", "event_id"])
    o, n = old.alias("o"), new.alias("n")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    return o.join(n, ["user_id", "key"], "full_outer").select(
        "user_id", "key", pick("title"), pick("summary"), pick("source_label"), pick("kind"),
        F.coalesce("o.added_at", "n.added_at").alias("added_at"),
        F.coalesce("o.is_done", F.lit(0)).alias("is_done"),
    )


def reading_list_remove(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """Entries without the (user, key) pairs of ``gone``."""
    return entries.join(gone.select("user_id", "key").distinct(), ["user_id", "key"], "left_anti")


def set_done(entries: DataFrame, marks: DataFrame) -> DataFrame:
    """Entries with the last done mark of their (user, key) applied."""
    last = latest(marks, ["user_id", "key"], ["at"]).select("user_id", "key", F.col("done").alias("_done"))
    return entries.join(last, ["user_id", "key"], "left").withColumn(
        "is_done", F.coalesce("_done", "is_done")
    ).drop("_done")


# ----- bookmarks -----------------------------------------------------------------------------
def bookmark_upsert(bookmarks: DataFrame, kept: int | None = None) -> DataFrame:
    """A bookmark goes when a later one of the same user, source and block lies less than 4 characters away.

    All others stay, or the newest ``kept`` of each user if a number is given.

    Each offset keeps its latest row; that row is announced to the offsets around it, and
    survives if nothing later was announced at its own.  Linear, no pairs.
    """
    place = ["user_id", "source_label", "block"]
    at = latest(bookmarks, [*place, "offset"], ["created_at", "event_id"])
    near = F.explode(F.sequence(F.col("offset") - OFFSET_TOLERANCE, F.col("offset") + OFFSET_TOLERANCE))
    heard = (
        at.select(*place, near.alias("offset"), F.struct("created_at", "event_id").alias("t"))
        .groupBy(*place, "offset")
        .agg(F.max("t").alias("t"))
    )
    alive = at.join(heard, [*place, "offset"]).filter(F.struct("created_at", "event_id") == F.col("t")).drop("t")
    return top(alive, "user_id", [F.desc("created_at"), F.desc("event_id")], kept)


BOOKMARK = ["user_id", "source_label", "block", "offset", "created_at"]


def bookmark_delete(bookmarks: DataFrame, gone: DataFrame) -> DataFrame:
    """Bookmarks without those named by all five identifying columns."""
    return bookmarks.join(gone.select(*BOOKMARK).distinct(), BOOKMARK, "left_anti")


def rename_label(label, chars: int | None = None) -> Column:
    """White space collapsed, null if nothing is left; the first ``chars`` characters if a number is given."""
    text = F.trim(collapse(label))
    return F.nullif(F.trim(F.substring(text, 1, chars)) if chars else text, F.lit(""))


def bookmark_rename(bookmarks: DataFrame, renames: DataFrame, chars: int | None = None) -> DataFrame:
    """Bookmarks with the last new label given for their five identifying columns: ``renames`` has those, new_label and at."""
    last = renames.groupBy(*BOOKMARK).agg(F.max_by("new_label", "at").alias("_new"), F.lit(True).alias("_named"))
    label = F.when(F.col("_named"), rename_label("_new", chars)).otherwise(F.col("label"))
    return bookmarks.join(last, BOOKMARK, "left").withColumn("label", label).drop("_new", "_named")


def _prefixes(rows: DataFrame, place: list[str], snippet: str, others: DataFrame, other: str, proper: bool) -> DataFrame:
    """The rows with each beginning ``key`` of their snippet that is as long as a snippet of the other side in their place.

    A place has no more lengths than its longest snippet has characters.
    """
    lengths = others.groupBy(*place).agg(F.collect_set(F.length(other)).alias("lengths"))
    own = F.length(snippet)
    fits = F.filter("lengths", lambda n: (n < own) if proper else (n <= own))
    keys = F.transform(fits, lambda n: F.substr(F.col(snippet), F.lit(1), n))
    return rows.join(lengths, place).withColumn("key", F.explode(keys)).drop("lengths")


def _nearest_on_both_sides(asks: DataFrame, marks: DataFrame, group: list[str]) -> DataFrame:
    """(group, t_offset, near): up to two nearest marks of every asked offset, the last at or before it and the first after.

    ``marks`` has (group, offset, made), ``asks`` (group, t_offset).  Asks and marks of an offset are one row each before the
    windows, so a window holds at most the offsets of one block of text, however many targets or bookmarks share them.
    """
    made = marks.groupBy(*group, "offset").agg(F.max("made").alias("made"))
    points = made.select(*group, F.col("offset").alias("at"), F.struct("offset", "made").alias("mark"), F.lit(False).alias("asked"))
    asked = asks.select(*group, F.col("t_offset").alias("at"), F.lit(None).cast(points.schema["mark"].dataType).alias("mark"), F.lit(True).alias("asked"))
    points = points.unionByName(asked.distinct()).groupBy(*group, "at").agg(F.max("mark").alias("mark"), F.max("asked").alias("asked"))
    window = Window.partitionBy(*group).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.last("mark", True).over(window.orderBy("at"))
    after = F.last("mark", True).over(window.orderBy(F.desc("at")))
    found = points.select(*group, F.col("at").alias("t_offset"), "asked", F.array_compact(F.array(before, after)).alias("near"))
    return found.filter("asked").select(*group, "t_offset", F.explode("near").alias("near"))


def nearest_bookmark(targets: DataFrame, bookmarks: DataFrame, chars: int | None = None, least: int = SNIPPET_MIN) -> DataFrame:
    """Best bookmark per target: same place, offset within 12 or a matching snippet start, nearest first.

    Snippets match when both have ``least`` characters and one begins with the other; only their first ``chars`` characters
    count if a number is given.  Two routes, and no pairs of a place: cells of 13 offsets; and the beginnings of the longer
    snippet as keys, in both directions, with the nearest offset on either side among the bookmarks of a key.  Equal offsets
    are reduced to their newest bookmark first.  Null snippets match none.
    """
    place = ["user_id", "source_label", "block"]
    width = MATCH_TOLERANCE + 1
    snippet = F.lower(collapse("snippet"))
    snippet = F.substring(snippet, 1, chars) if chars else snippet
    t = targets.withColumn("t_snip", snippet).select(*place, "target_id", F.col("offset").alias("t_offset"), "t_snip")
    b = bookmarks.withColumn("snip", snippet)
    by_offset = latest(
        b.select(*place, "offset", "created_at", "event_id"), [*place, "offset"], ["created_at", "event_id"]
    ).withColumn("cell", F.floor(F.col("offset") / width))
    cells = t.withColumn("cell", F.explode(F.sequence(F.floor(F.col("t_offset") / width) - 1, F.floor(F.col("t_offset") / width) + 1)))
    near = cells.join(by_offset, [*place, "cell"]).filter(
        F.abs(F.col("offset") - F.col("t_offset")) <= MATCH_TOLERANCE
    )
    asks = t.filter(F.length("t_snip") >= least)
    marks = (
        b.filter(F.length("snip") >= least)
        .groupBy(*place, "snip", "offset")
        .agg(F.max(F.struct("created_at", "event_id")).alias("made"))
    )
    # the bookmark is as long or longer, or the target is longer
    longer = F.lit(False).alias("longer")
    shorter = F.lit(True).alias("longer")
    ask_keys = asks.withColumn("key", F.col("t_snip")).select("*", longer).unionByName(
        _prefixes(asks, place, "t_snip", marks, "snip", True).select(*asks.columns, "key", shorter)
    )
    mark_keys = marks.withColumn("key", F.col("snip")).select("*", shorter).unionByName(
        _prefixes(marks, place, "snip", asks, "t_snip", False).select(*marks.columns, "key", longer)
    )
    group = [*place, "key", "longer"]
    alike = ask_keys.join(_nearest_on_both_sides(ask_keys, mark_keys, group), [*group, "t_offset"])
    cols = ["target_id", "t_offset", "offset", "created_at", "event_id"]
    both = near.select(*cols).unionByName(
        alike.select("target_id", "t_offset", "near.offset", "near.made.created_at", "near.made.event_id")
    )
    rank = F.struct(
        F.abs(F.col("offset") - F.col("t_offset")).alias("d"), (-F.col("created_at")).alias("c"), (-F.col("event_id")).alias("e")
    )
    return both.groupBy("target_id").agg(F.min_by(F.struct("event_id", "offset"), rank).alias("m")).select(
        "target_id", "m.event_id", "m.offset"
    )


def sentence_end(text, start) -> Column:
    """Index of the first . ! ? at or after start, at most 220 characters on."""
    limit = F.least(start + SPAN_CHARS, F.length(text) - 1)
    stop = F.regexp_instr(F.substr(text, start + 1, limit - start), F.lit("[.!?]"))
    return F.when(stop > 0, start + stop - 1).otherwise(limit).cast("int")


def sentence_start(text, anchor) -> Column:
    """Start of the sentence around an offset, at most 220 characters back."""
    low = F.greatest(anchor - SPAN_CHARS, F.lit(0))
    before = F.substr(text, low + 1, anchor - low)
    tail = F.regexp_extract(before, r"([^.!?\n]*)$", 1)
    at = anchor - F.length(tail)
    lead = F.length(F.regexp_extract(F.substr(text, at + 1), r"^\s*", 0))
    return F.least(F.greatest(at + lead, F.lit(0)), F.length(text) - 1).cast("int")


def bookmark_span(text, offset, snippet) -> tuple[Column, Column]:
    """(first, last) index of a bookmark: its snippet start close to the offset, else to the sentence end."""
    text = col(text)
    start = F.least(F.greatest(col(offset), F.lit(0)), F.length(text) - 1).cast("int")
    prefix = F.substring(collapse(snippet), 1, SPAN_PREFIX)
    window = F.substr(text, start + 1, F.length(prefix) + MATCH_TOLERANCE)
    found = F.instr(window, prefix)
    hit = (prefix != "") & (found > 0)
    first = F.when(hit, start + found - 1).otherwise(start)
    last = F.when(hit, F.least(start + found - 1 + F.length(prefix) - 1, F.length(text) - 1)).otherwise(
        sentence_end(text, start)
    )
    return first.cast("int"), last.cast("int")


def bookmark_groups(bookmarks: DataFrame, query: str, current: str) -> DataFrame:
    """Bookmarks whose title, label or snippet holds the query, with the order of their source group."""
    q = query.strip().lower()
    hit = (
        F.lower("title").contains(q)
        | F.coalesce(F.lower("label").contains(q), F.lit(False))
        | F.lower("snippet").contains(q)
    )
    rows = bookmarks.filter(hit)
    newest = rows.groupBy("user_id", "source_label").agg(F.max("created_at").alias("group_latest"))
    return rows.join(newest, ["user_id", "source_label"]).withColumn(
        "is_current", (F.col("source_label") == current).cast("int")
    ).orderBy(
        "user_id", F.desc("is_current"), F.desc("group_latest"), "source_label", "block", "offset", F.desc("created_at")
    )


# ----- retention -------------------------------------------------------------------------------
def known_sources(*tables: DataFrame) -> DataFrame:
    out = tables[0].select("user_id", "source_label")
    for t in tables[1:]:
        out = out.union(t.select("user_id", "source_label"))
    return out.distinct()


def orphan_report(store: DataFrame, known: DataFrame) -> DataFrame:
    """Stored documents nobody refers to: count and bytes per user."""
    return store.join(known, ["user_id", "source_label"], "left_anti").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("removed"), F.sum("bytes").alias("freed")
    )


def evictions(store: DataFrame, known: DataFrame, max_files: int, max_bytes: int, cell_ms=86_400_000) -> DataFrame:
    """Unprotected files to remove, oldest first, until the user is inside both limits, which the caller sets.

    File i of the eviction order goes if what is left before it still exceeds a limit.  The
    running sums have two levels, time cells and files inside a cell, so one user's store is
    never one sort.
    """
    totals = store.groupBy("user_id").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("total"))
    loose = store.join(known, ["user_id", "source_label"], "left_anti").withColumn(
        "cell", F.floor(F.col("modified_at") / cell_ms)
    )
    cells = loose.groupBy("user_id", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    earlier = Window.partitionBy("user_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    # the totals of a user reach the files through the cells, which are many for a busy user
    cells = cells.join(totals, "user_id").select(
        "user_id", "cell", "files", "total", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("b0"),
    )
    inside = (
        Window.partitionBy("user_id", "cell").orderBy("modified_at", "source_label").rowsBetween(Window.unboundedPreceding, -1)
    )
    loose = loose.withColumn("n1", F.count(F.lit(1)).over(inside)).withColumn(
        "b1", F.coalesce(F.sum("bytes").over(inside), F.lit(0))
    )
    rows = loose.join(cells, ["user_id", "cell"])
    over = (F.col("files") - F.col("n0") - F.col("n1") > max_files) | (
        F.col("total") - F.col("b0") - F.col("b1") > max_bytes
    )
    return rows.filter(over).select("user_id", "source_label", "modified_at", "bytes")


def usable(kind, label, paragraphs, headings, chars) -> Column:
    """May a stored document be shown?  Captured text, paged and web documents have their own floor."""
    blocks = col(paragraphs) + col(headings)
    captured = col(label).startswith("captured-text:")
    return (
        F.when(captured, (blocks >= 1) & (col(chars) >= 80))
        .when(col(kind) == "PDF", (blocks >= 1) & (col(chars) >= 200))
        .otherwise((col(paragraphs) >= 3) & (col(chars) >= 800))
    )


def strong_remote(kind, label, paragraphs, headings, chars) -> Column:
    web = (col(kind) == "WEB") & col(label).rlike("^https?://")
    return ~web | (
        (col(paragraphs) >= 6) & (col(chars) >= 1800) & (col(paragraphs) + col(headings) >= 6)
    )


def lookup(requests: DataFrame, store: DataFrame, known: DataFrame) -> DataFrame:
    """Stored document for a requested source: itself if usable, else the first known source with the
    same canonical key if that one is usable.  ``known`` has (user_id, source_label, order)."""
    ok = store.filter("usable = 1").select("user_id", F.col("source_label").alias("found"), F.col("chars"))
    exact = requests.join(
        ok.withColumn("source_label", F.col("found")), ["user_id", "source_label"], "left"
    ).withColumnsRenamed({"found": "exact", "chars": "exact_chars"})
    ranked = known.withColumn("canonical", canonical_source("source_label"))
    w = Window.partitionBy("user_id", "canonical").orderBy("order")
    # the request itself may be the first, so two candidates per key are enough
    firsts = (
        ranked.withColumn("r", F.row_number().over(w)).filter("r <= 2")
        .select("user_id", "canonical", F.col("source_label").alias("other"), "r")
    )
    pairs = (
        exact.filter("exact is null").withColumn("canonical", canonical_source("source_label"))
        .join(firsts, ["user_id", "canonical"])
        .filter("other <> source_label")
        .groupBy("user_id", "source_label").agg(F.min_by("other", "r").alias("found"))
        .join(ok, ["user_id", "found"])
        .select("user_id", "source_label", "found", F.col("chars").alias("found_chars"))
    )
    return exact.join(pairs, ["user_id", "source_label"], "left").select(
        "user_id", "source_label", F.coalesce("exact", "found").alias("document"),
        F.coalesce("exact_chars", "found_chars").alias("chars"),
    )


# ----- progress --------------------------------------------------------------------------------
def progress_keys(label) -> Column:
    label = col(label)
    canonical = F.when(label.rlike("^https?://"), canonical_source(label)).otherwise(label)
    return F.array_distinct(F.array(canonical, label))


def progress_table(moves: DataFrame) -> DataFrame:
    """Last position per user and alias key."""
    rows = moves.select("user_id", F.explode(progress_keys("source_label")).alias("key"), "block", "offset", "at", "event_id")
    return latest(rows, ["user_id", "key"], ["at", "event_id"])


def read_progress(requests: DataFrame, table: DataFrame) -> DataFrame:
    """Position of a source: the canonical key first, the exact one else."""
    t = table.select("user_id", "key", F.struct("block", "offset").alias("p"))
    keyed = requests.withColumn("keys", progress_keys("source_label"))
    first = keyed.withColumn("key", F.col("keys")[0]).join(t, ["user_id", "key"], "left").withColumnRenamed("p", "p1").drop("key")
    both = first.withColumn("key", F.try_element_at("keys", F.lit(2))).join(t, ["user_id", "key"], "left")
    return both.select(
        "user_id", "source_label", F.coalesce("p1", "p").block.alias("block"), F.coalesce("p1", "p").offset.alias("offset")
    )


# ----- two captures ------------------------------------------------------------------------------
def capture_quality(captures: DataFrame, least: int = 80) -> DataFrame:
    """Captures (doc_id, text, title) with quality columns; texts under ``least`` characters keep their row with a null."""
    text = F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), r"^\s+|\s+$", "")
    df = captures.withColumn("text", text)
    df = peel_plain_text(df, given_title="given_title")
    paras = F.filter("blocks", lambda b: b.type == "Paragraph")
    chars = F.aggregate(paras, F.lit(0), lambda a, b: a + F.length(b.text))
    df = df.withColumn("p", F.size(paras)).withColumn("h", F.size("blocks") - F.size(paras)).withColumn("pc", chars)
    score = F.col("pc") + F.col("p") * 140 + F.col("h") * 30 - F.size("metadata") * 20 + F.least(F.length("text"), F.lit(220))
    solid = (F.col("pc") >= 180) | (F.col("p") >= 2) | ((F.col("p") >= 1) & (F.col("h") >= 1) & (F.col("pc") >= 120))
    quality = F.struct("p", "h", "pc", score.alias("score"), solid.alias("solid"), F.length("text").alias("n"))
    return df.select("doc_id", F.when(F.length("text") >= least, quality).alias("q"))


def choose_capture(visible: DataFrame, session: DataFrame) -> DataFrame:
    """'visible', 'session' or null per document, by substance, score margin and paragraph text."""
    both = visible.select("doc_id", F.col("q").alias("v")).join(
        session.select("doc_id", F.col("q").alias("s")), "doc_id", "full_outer"
    )
    v, s = F.col("v"), F.col("s")
    choice = (
        F.when(v.isNull(), F.when(s.solid, "session"))
        .when(s.isNull(), F.when(v.solid, "visible"))
        .when(~v.solid & ~s.solid, F.lit(None))
        .when(s.solid & ~v.solid, "session")
        .when(v.solid & ~s.solid, "visible")
        .when(s.score > v.score + QUALITY_MARGIN, "session")
        .when(v.score > s.score + QUALITY_MARGIN, "visible")
        .when((s.pc > v.pc + 120) & (s.p >= v.p), "session")
        .otherwise("visible")
    )
    return both.select("doc_id", choice.alias("choice"), "v", "s")


def beats_remote(capture, paragraphs, headings, chars) -> Column:
    """A weak remote web document loses to a substantive capture that is more than 40 characters longer."""
    weak = (col(paragraphs) <= 1) & (col(chars) <= 220) & (col(headings) <= 3)
    return F.coalesce(capture.solid & weak & (capture.n > col(chars) + 40), F.lit(False))


def visible_then_exposed(visible: DataFrame, exposed: DataFrame) -> DataFrame:
    """All visible blocks plus exposed ones with a new key; first per key in a session."""
    key = token_key("text")
    v = visible.withColumn("key", key).withColumn("part", F.lit(0))
    e = exposed.withColumn("key", key).withColumn("part", F.lit(1))
    fresh = e.join(v.select("session", "key").distinct(), ["session", "key"], "left_anti")
    rows = v.unionByName(fresh).filter("key <> ''")
    first = F.min_by(F.struct("part", "pos", "text"), F.struct("part", "pos"))
    return rows.groupBy("session", "key").agg(first.alias("r")).select("session", "key", "r.part", "r.pos", "r.text")

