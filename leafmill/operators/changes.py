"""The library as one change log: entries are versions, valid from one change to the next, and gone behind a tombstone.

A change has a user, a time ``at`` in milliseconds and a number ``seq`` that orders changes of one time.  Versions are valid
from (from_at, from_seq) to (to_at, to_seq), open if the latter are null; ``as_of`` reads the library of any moment.  What came
before a change, or comes next, is carried over time cells (``ordering.carried``), so one busy user is many tasks.
Changes without user, key or time are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.library import OFFSET_TOLERANCE, rename_label
from leafmill.operators.ordering import carried

#: Width of a time cell.
CELL_MS = 86_400_000
ORDER = ["at", "seq"]
MOMENT = "struct<at: bigint, seq: bigint>"


def _moment() -> Column:
    return F.struct(F.col("at").cast("long").alias("at"), F.col("seq").cast("long").alias("seq"))


def _valid(start: str, end: str) -> list[Column]:
    return [
        F.col(f"{start}.at").alias("from_at"), F.col(f"{start}.seq").alias("from_seq"),
        F.col(f"{end}.at").alias("to_at"), F.col(f"{end}.seq").alias("to_seq"),
    ]


def as_of(versions: DataFrame, at: int | Column) -> DataFrame:
    """The versions that hold at a moment, all changes of that millisecond included."""
    moment = F.lit(at) if isinstance(at, int) else at
    return versions.filter((F.col("from_at") <= moment) & (F.col("to_at").isNull() | (F.col("to_at") > moment)))


def reading_list_versions(changes: DataFrame, cell_ms: int = CELL_MS) -> DataFrame:
    """Versions (user_id, key, title, summary, source_label, added_at, is_done, from_, to_) of reading-list entries.

    ``changes`` are (user_id, key, at, seq, op, title, summary, source_label, done): ``add`` makes an entry or changes its title,
    summary and label, keeping the time it was added and its mark; ``done`` sets the mark to 0 or 1; ``remove`` is a tombstone,
    behind which the next ``add`` makes a new entry.  Marks and tombstones of an absent entry do nothing.
    """
    op = F.col("op")
    rows = changes.filter("user_id IS NOT NULL AND key IS NOT NULL AND at IS NOT NULL AND op IS NOT NULL")
    rows = rows.withColumn("moment", _moment())
    removed = {"life": ("sum", (op == "remove").cast("long"))}
    rows = carried(rows, ["user_id", "key"], "at", ORDER, removed, cell_ms)
    added = F.when(op == "add", F.struct("at", "seq", "title", "summary", "source_label"))
    first = F.when(op == "add", F.col("moment"))
    mark = F.when(op == "done", F.struct("at", "seq", "done"))
    own = {"own_added": added, "own_first": first, "own_mark": mark}
    before = {"added": ("max", added), "first": ("min", first), "mark": ("max", mark)}
    rows = carried(rows.withColumns(own), ["user_id", "key", "life"], "at", ORDER, before, cell_ms)
    rows = rows.withColumns(
        {"added": F.greatest("added", "own_added"), "first": F.least("first", "own_first"), "mark": F.greatest("mark", "own_mark")}
    )
    rows = carried(rows, ["user_id", "key"], "at", ORDER, {"next": ("min", F.col("moment"))}, cell_ms, after=True)
    counts = (F.col("mark.at") > F.col("first.at")) | ((F.col("mark.at") == F.col("first.at")) & (F.col("mark.seq") > F.col("first.seq")))
    # a new label, title or mark is a new version; the tombstone itself is none
    return rows.filter((op != "remove") & F.col("added").isNotNull()).select(
        "user_id", "key", "added.title", "added.summary", "added.source_label", F.col("first.at").alias("added_at"),
        F.when(counts, F.col("mark.done")).otherwise(F.lit(0)).cast("int").alias("is_done"), *_valid("moment", "next"),
    )


def cascades(deletes: DataFrame, versions: DataFrame, cell_ms: int = CELL_MS) -> DataFrame:
    """``deletes`` (user_id, source_label, at, seq, ...) of history items with ``preserved``: whether the reading list has an
    entry of that source at that moment.  If not, its document, progress and bookmarks go with it.

    Versions open and close a count on the time line of (user, source), and a delete reads the count before it.
    """
    shown = versions.filter("source_label IS NOT NULL").select("user_id", "source_label", "from_at", "from_seq", "to_at", "to_seq")
    opened = shown.select("user_id", "source_label", F.col("from_at").alias("at"), F.col("from_seq").alias("seq"), F.lit(1).alias("open"))
    closed = shown.filter("to_at IS NOT NULL").select("user_id", "source_label", F.col("to_at").alias("at"), F.col("to_seq").alias("seq"), F.lit(-1).alias("open"))
    told = deletes.filter("user_id IS NOT NULL AND source_label IS NOT NULL AND at IS NOT NULL")
    line = told.withColumn("is_delete", F.lit(True)).unionByName(opened.unionByName(closed), allowMissingColumns=True)
    met = carried(line, ["user_id", "source_label"], "at", ORDER, {"listed": ("sum", F.coalesce("open", F.lit(0)))}, cell_ms)
    return met.filter("is_delete").withColumn("preserved", F.col("listed") > 0).drop("is_delete", "open", "listed")


IDENTITY = ["user_id", "source_label", "block", "offset", "created_at"]
PLACE = ["user_id", "source_label", "block", "offset"]


def bookmark_versions(
    adds: DataFrame, renames: DataFrame, deletes: DataFrame, clears: DataFrame, chars: int | None = None, cell_ms: int = CELL_MS
) -> DataFrame:
    """Versions (user_id, source_label, block, offset, created_at, seq, label, from_, to_) of bookmarks.

    ``adds`` are (user_id, source_label, block, offset, at, seq); a bookmark ends when a later one of its place lies less than 4
    characters away, when ``deletes`` name its user, source, block, offset and time, or when ``clears`` (user_id, source_label,
    at, seq) empty its source.  ``renames`` name it alike and give ``new_label``, collapsed, null if blank, its first ``chars``
    characters if a number is given.
    """
    adds = adds.filter("user_id IS NOT NULL AND source_label IS NOT NULL AND block IS NOT NULL AND offset IS NOT NULL AND at IS NOT NULL")
    adds = adds.select("user_id", "source_label", "block", "offset", "at", "seq").withColumn("moment", _moment())
    # each bookmark is announced to the offsets around it; what comes next at its own offset ends it
    steps = F.sequence(F.lit(-OFFSET_TOLERANCE), F.lit(OFFSET_TOLERANCE))
    told = adds.withColumn("step", F.explode(steps)).withColumn("offset", F.col("offset") + F.col("step"))
    met = carried(told, PLACE, "at", ["at", "seq", "step"], {"near": ("min", F.col("moment"))}, cell_ms, after=True)
    # announcements of one bookmark stand at different offsets, so none ends itself
    met = met.filter("step = 0").drop("step")
    exact = deletes.groupBy("user_id", "source_label", "block", "offset", F.col("created_at").alias("at")).agg(F.min(_moment_of("gone_at", "gone_seq")).alias("named"))
    met = met.join(exact, ["user_id", "source_label", "block", "offset", "at"], "left")
    line = met.unionByName(clears.select("user_id", "source_label", "at", "seq", F.lit(True).alias("is_clear")), allowMissingColumns=True)
    cleared = F.when(F.col("is_clear"), _moment())
    line = carried(line, ["user_id", "source_label"], "at", ORDER, {"cleared": ("min", cleared)}, cell_ms, after=True)
    held = line.filter("is_clear IS NULL").select(
        *PLACE, F.col("at").alias("created_at"), "seq", "moment", F.least("near", "named", "cleared").alias("end")
    )
    named = renames.select(*IDENTITY, "at", F.col("seq").alias("by"), rename_label("new_label", chars).alias("label"))
    given = held.join(named, IDENTITY).select(
        *IDENTITY, "seq", "end", F.struct(F.col("at").cast("long").alias("at"), F.col("by").cast("long").alias("seq")).alias("start"), "label"
    )
    given = given.filter("end IS NULL OR start < end").unionByName(
        held.select(*IDENTITY, "seq", "end", F.col("moment").alias("start"), F.lit(None).cast("string").alias("label"))
    )
    rows = given.withColumns({"start_at": F.col("start.at"), "start_seq": F.col("start.seq")})
    following = {"next": ("min", F.col("start"))}
    rows = carried(rows, [*IDENTITY, "seq"], "start_at", ["start_at", "start_seq"], following, cell_ms, after=True)
    return rows.withColumn("to", F.least("next", "end")).select(*IDENTITY, "seq", "label", *_valid("start", "to"))


def _moment_of(at: str, seq: str) -> Column:
    return F.struct(F.col(at).cast("long").alias("at"), F.col(seq).cast("long").alias("seq"))
