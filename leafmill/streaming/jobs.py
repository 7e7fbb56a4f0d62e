"""Streaming forms of the live parts: samples, dedupe, lookups, positions, fragments; ``sessions`` has the ordered ones."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from leafmill.functions.text import col
from leafmill.operators.library import latest
from leafmill.operators.ordering import carried

# --- fixed value: seconds of a sample ---
SAMPLE_SECONDS = 5
DAY_MS = 86_400_000


def watermarked(events: DataFrame, delay: str | None) -> DataFrame:
    """The stream with a watermark, if a delay is given.

    Without one every row counts, however late, and the state keeps all keys: right for a closed corpus.  A
    live job gives a delay, which bounds its state; rows later than that are then dropped by the operator, so
    ``sessions.late_sink`` should be run beside it.
    """
    return events.withWatermark("ts", delay) if events.isStreaming and delay else events


# ----- samples and status -----------------------------------------------------------------
def samples(events: DataFrame, seconds: int = SAMPLE_SECONDS, delay: str | None = None) -> DataFrame:
    """Last value, count and power per user and tumbling window."""
    cell = F.window("ts", f"{seconds} seconds")
    events = watermarked(events, delay)
    order = F.struct("ts", "event_id")
    return events.groupBy(cell, "user_id").agg(
        F.max_by("value", order).alias("level"),
        F.max_by("k", order).alias("current"),
        F.count(F.lit(1)).alias("n"),
        F.sum("k").alias("busy"),
    ).select(
        (F.unix_millis("window.start")).alias("window_ms"), "user_id", "level",
        (F.abs(F.col("current")) * F.col("level")).alias("watts"), "n", "busy",
    )


def cpu_percent(rows: DataFrame, cell_ms: int = DAY_MS) -> DataFrame:
    """100 * busy time / wall time since the previous sample of the user, which is carried over time cells.

    Samples without a user have no previous one.
    """
    known = carried(rows.filter("user_id IS NOT NULL"), ["user_id"], "window_ms", ["window_ms"], {"_was": ("max", F.col("window_ms"))}, cell_ms)
    rows = known.unionByName(rows.filter("user_id IS NULL").withColumn("_was", F.lit(None).cast("long")))
    return rows.withColumn("cpu", 100.0 * F.col("busy") / (F.col("window_ms") - F.col("_was"))).drop("_was")


def status(events: DataFrame, delay: str | None = None) -> DataFrame:
    """speaking, paused or idle per user and hour, from the last state in the hour."""
    events = watermarked(events, delay)
    order = F.struct("ts", "event_id")
    rows = events.groupBy(F.window("ts", "1 hour"), "user_id").agg(
        F.max_by("event_type", order).alias("last"), F.max((F.col("k") % 4 != 0).cast("int")).alias("has_segments")
    )
    state = F.when(F.col("last") == "view", "speaking").when(F.col("has_segments") == 1, "paused").otherwise("idle")
    return rows.select(F.unix_millis("window.start").alias("window_ms"), "user_id", state.alias("status"))


def session_dedupe(events: DataFrame, horizon: str | None = None) -> DataFrame:
    """Block keys not yet seen in the user's session, across windows; for ever, or within ``horizon`` if one is given."""
    keyed = events.withColumn("key", F.concat("event_type", F.lit(":"), F.col("k").cast("string")))
    if not keyed.isStreaming:
        return keyed.select("user_id", "key").distinct()
    if horizon is None:
        return keyed.select("user_id", "key").dropDuplicates()
    return keyed.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["user_id", "key"]).select("user_id", "key")


# ----- recent value -------------------------------------------------------------------------
def recent_value(lookups: DataFrame, tracked: DataFrame, ttl_ms: int) -> DataFrame:
    """The user's latest tracked value at each lookup, if its package and page signature agree and it is
    at most ``ttl_ms`` old.

    Time is cut into cells of one ttl: a lookup needs only its own cell and the last value of
    the cell before, so a busy user is spread over cells.
    """
    cell = F.floor(F.col("ms") / ttl_ms)
    value = F.struct("ms", "event_id", "package", "url", "sig")
    rows = tracked.withColumn("cell", cell).select("user_id", "cell", "ms", value.alias("v"))
    carried = rows.groupBy("user_id", "cell").agg(F.max("v").alias("v")).select(
        "user_id", (F.col("cell") + 1).alias("cell"), F.col("v.ms").alias("ms"), "v"
    )
    none = F.lit(None)
    asks = lookups.withColumn("cell", cell).select(
        "user_id", "cell", "ms", F.struct("lookup_id", "package", "sig").alias("ask")
    )
    timeline = (
        rows.unionByName(carried).withColumn("ask", none.cast(asks.schema["ask"].dataType))
        .unionByName(asks.withColumn("v", none.cast(rows.schema["v"].dataType)))
    )
    # a value of the same millisecond counts, so values sort before lookups
    w = Window.partitionBy("user_id", "cell").orderBy("ms", F.col("ask").isNotNull(), "v.event_id")
    seen = timeline.withColumn("last", F.last("v", True).over(w)).filter("ask is not null")
    good = (
        (F.col("last.package") == F.col("ask.package"))
        & (F.col("last.sig") == F.col("ask.sig"))
        & (F.col("ms") - F.col("last.ms") <= ttl_ms)
    )
    return seen.select("user_id", "ask.lookup_id", F.when(good, F.col("last.url")).alias("url"))


def recent_pairs(lookups: DataFrame, tracked: DataFrame, minutes: int, delay: str | None = None) -> DataFrame:
    """Stream-stream interval join behind the lookup: values at most ``minutes`` old; ``delay`` as in ``watermarked``."""
    a = watermarked(lookups, delay).alias("a")
    b = watermarked(tracked, delay).alias("b")
    fits = (
        (F.col("a.user_id") == F.col("b.user_id"))
        & (F.col("b.ts") <= F.col("a.ts"))
        & (F.col("b.ts") >= F.col("a.ts") - F.expr(f"interval {minutes} minutes"))
    )
    return a.join(b, fits).select(
        F.col("a.user_id").alias("user_id"), F.col("a.lookup_id").alias("lookup_id"),
        (F.col("a.package") == F.col("b.package")).alias("same_package"), (F.col("a.sig") == F.col("b.sig")).alias("same_sig"),
        F.unix_millis("b.ts").alias("ms"), F.col("b.event_id").alias("event_id"), F.col("b.url").alias("url"),
    )


def latest_of_pairs(pairs: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("same_package", "same_sig", "url"), F.struct("ms", "event_id"))
    rows = pairs.groupBy("user_id", "lookup_id").agg(best.alias("b"))
    return rows.filter("b.same_package and b.same_sig").select("user_id", "lookup_id", "b.url")


# ----- position upsert ----------------------------------------------------------------------
def position_sink(keys: list[str], order: list[str]):
    """foreachBatch sink: the batch's own latest rows, written under its batch id.

    A batch costs what it brings, and replaying it overwrites itself; ``merged`` makes the table of all batches.
    """

    def make(target: str):
        def write(batch: DataFrame, batch_id: int) -> None:
            latest(batch, keys, order).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

        return write

    return make


def merged(spark, target: str, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key over all batches; combined before the shuffle."""
    return latest(spark.read.parquet(target).drop("batch"), keys, order)


# ----- fragments ----------------------------------------------------------------------------
def append_fragment(text: Column, piece: Column) -> Column:
    """Text so far plus one fragment: ignored when blank, replaced when it extends the text, skipped when
    it is already the end, else joined on the longest overlap."""
    blank = F.trim(piece) == ""
    overlap = F.filter(
        F.sequence(F.least(F.length(text), F.length(piece)), F.lit(1), F.lit(-1)),
        lambda n: text.endswith(F.substr(piece, F.lit(1), n)),
    )
    join_at = F.coalesce(F.try_element_at(overlap, F.lit(1)), F.lit(0))
    return (
        F.when(blank, text)
        .when(F.trim(text) == "", piece)
        .when(piece.startswith(text), piece)
        .when(text.endswith(piece), text)
        .otherwise(F.concat(text, F.substr(piece, join_at + 1, F.length(piece))))
    )


def assemble_fragments(pieces) -> Column:
    """Fold of one response's fragments in order."""
    return F.aggregate(col(pieces), F.lit(""), append_fragment)


class FragmentText(StatefulProcessor):
    """Streaming form: the text so far per response."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.text = handle.getValueState("text", StructType([StructField("text", StringType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("seq")
        text = self.text.get()[0] if self.text.exists() else ""
        for piece in frame["piece"].tolist():
            text = joined_fragment(text, piece)
        self.text.update((text,))
        yield pd.DataFrame({"response_id": [key[0]], "text": [text]})

    def close(self) -> None:
        pass


def overlap(text: str, piece: str) -> int:
    """Length of the longest end of ``text`` that begins ``piece``: one pass with the borders of the piece."""
    most = min(len(text), len(piece))
    borders = [0] * (most + 1)
    size = 0
    for i in range(1, most):
        while size and piece[i] != piece[size]:
            size = borders[size]
        size += piece[i] == piece[size]
        borders[i + 1] = size
    met = 0
    for c in text[len(text) - most :]:
        while met and (met == most or c != piece[met]):
            met = borders[met]
        met += most > 0 and c == piece[met]
    return met


def joined_fragment(text: str, piece: str) -> str:
    """The rule of ``append_fragment`` for one pair of strings."""
    if piece.isspace() or not piece:
        return text
    whole = text.isspace() or not text or piece[: len(text)] == text
    return piece if whole else text + piece[overlap(text, piece) :]


def fragment_texts(fragments: DataFrame) -> DataFrame:
    """(response_id, seq, piece) stream to the growing text per response, update mode."""
    return fragments.groupBy("response_id").transformWithStateInPandas(
        statefulProcessor=FragmentText(),
        outputStructType="response_id string, text string",
        outputMode="Update",
        timeMode="None",
    )


# ----- incremental clean-up -------------------------------------------------------------------
def new_documents(docs: DataFrame) -> DataFrame:
    """Documents whose id has not come before; the ids are the state of the stream, in keyed stores."""
    return docs.dropDuplicates(["doc_id"])


def cleanup_sink(clean):
    """foreachBatch sink: the new documents of the batch are cleaned, and written under its batch id."""

    def make(target: str):
        def write(batch: DataFrame, batch_id: int) -> None:
            clean(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

        return write

    return make
