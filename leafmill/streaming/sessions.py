"""Sessions with limits and the throttle, in the order of event time: over a table and as streams.

Over a table both are prefixes of composed maps.  A cell of steps maps each of the few states of a session to the state
behind it; a block of time maps each event that may be met first to the one that is met first in the next block.  Maps are
composed in levels (``operators.ordering.entries``), so one user is many tasks and nothing runs in Python.

As streams both keep the rows of a key until the watermark has passed them, then take them in order: an event-time timer
stands at the earliest row that waits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from leafmill.operators.ordering import entries, ranked, sum_before
from leafmill.session import written

# --- fixed values: limits of a session ---
MAX_STEPS, MAX_STALLED, MIN_CHARS = 10, 2, 120
#: Steps of one cell.
CELL = 256
#: Milliseconds of one block of the throttle, if its interval is shorter.
BLOCK_MS = 64_000

SESSION = "user_id long, session long, steps long, blocks long, chars long"
ACCEPTED = "user_id long, event_id long, ms long"


def session_steps(events: DataFrame) -> DataFrame:
    """One step of each event with a user: its place in time, ``k % 3`` new blocks and ``2 k`` characters."""
    k = F.coalesce("k", F.lit(0))
    return events.filter(F.col("user_id").isNotNull()).select(
        "user_id", "event_id", "ts", (k % 3).cast("long").alias("fresh"), (k * 2).cast("long").alias("chars")
    )


# ----- sessions over a table ------------------------------------------------------------------
def _behind(state: Column, fresh: Column, steps: int, stalled: int) -> tuple[Column, Column]:
    """State after a step and whether it ends the session; a state is ``steps * stalled + stalled steps``."""
    taken = F.floor(state / stalled).cast("int") + 1
    still = F.when(fresh, F.lit(0)).otherwise(state % stalled + 1)
    closes = (taken >= steps) | (still >= stalled)
    return F.when(closes, F.lit(0)).otherwise(taken * stalled + still).cast("int"), closes


def _cell_map(news: Column, steps: int, stalled: int) -> Column:
    states = F.sequence(F.lit(0), F.lit(steps * stalled - 1))
    return F.aggregate(news, states, lambda met, fresh: F.transform(met, lambda s: _behind(s, fresh, steps, stalled)[0]))


def _walked(news: Column, entry: Column, steps: int, stalled: int) -> Column:
    """For each step of a cell: the sessions that ended before it in the cell, and whether it ends one."""
    none = F.array().cast("array<struct<ended: int, closes: boolean>>")
    start = F.struct(entry.alias("state"), F.lit(0).alias("ended"), none.alias("met"))

    def step(s: Column, fresh: Column) -> Column:
        state, closes = _behind(s["state"], fresh, steps, stalled)
        now = F.struct(s["ended"].alias("ended"), closes.alias("closes"))
        return F.struct(
            state.alias("state"), (s["ended"] + closes.cast("int")).alias("ended"), F.concat(s["met"], F.array(now)).alias("met")
        )

    return F.aggregate(news, start, step, lambda s: s["met"])


def capture_sessions(
    steps: DataFrame, least: int | None = None, max_steps: int = MAX_STEPS, max_stalled: int = MAX_STALLED, cell: int = CELL
) -> DataFrame:
    """(user_id, session, steps, blocks, chars) of the sessions that ended, in the order of (ts, event_id).

    A session ends with its ``max_steps``-th step or with ``max_stalled`` steps in a row without news; its number counts
    those of the user before it.  Sessions under ``least`` characters are left out if a number is given.  ``steps`` are those of
    ``session_steps``; a null time comes first, equal steps follow each other, an empty table gives no sessions.
    """
    order = [F.col("ts").asc_nulls_first(), F.col("event_id").asc_nulls_first()]
    placed = ranked(steps.select("user_id", "event_id", "ts", "fresh", "chars"), "user_id", order, "steps")
    step = F.struct("pos", (F.col("fresh") > 0).alias("news"), "fresh", "chars")
    cells = placed.groupBy("user_id", F.expr(f"pos div {cell}").alias("place")).agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(step)).alias("steps")
    )
    news = F.transform("steps", lambda s: s["news"])
    # the only cell of a user is entered at 0, so it needs no map
    maps = cells.filter(F.col("n") > cell).select("user_id", "place", _cell_map(news, max_steps, max_stalled).alias("map"))
    met = cells.join(entries(maps, "user_id"), ["user_id", "place"], "left")
    walked = met.withColumn("walk", _walked(news, F.coalesce("entry", F.lit(0)), max_steps, max_stalled))
    ended = F.size(F.filter("walk", lambda w: w["closes"])).cast("long")
    counted = sum_before(walked.select("user_id", "place", "steps", "walk", ended.alias("ended")), "user_id", "place", "ended")
    each = counted.select("user_id", "before", F.explode(F.arrays_zip("steps", "walk")).alias("s")).select(
        "user_id", (F.col("before") + F.col("s.walk.ended")).alias("session"), F.col("s.steps").alias("step"), F.col("s.walk.closes").alias("closes")
    )
    sessions = each.groupBy("user_id", "session").agg(
        F.count("*").alias("steps"),
        F.sum("step.fresh").alias("blocks"),
        F.sum(F.when(F.col("step.fresh") > 0, F.col("step.chars")).otherwise(F.lit(0))).alias("chars"),
        F.max("closes").alias("closed"),
    )
    sessions = sessions.filter("closed").drop("closed")
    return sessions if least is None else sessions.filter(F.col("chars") >= least)


# ----- throttle over a table --------------------------------------------------------------------
def throttled(events: DataFrame, interval_ms: int = 1000, block_ms: int = BLOCK_MS) -> DataFrame:
    """(user_id, event_id, ms) of accepted events: the first one of a user, then each that is the first at least
    ``interval_ms`` after the last accepted one; of one millisecond the first in the order of (ts, event_id).

    Time is cut into blocks of a multiple of the interval.  A range window points from each event to the next acceptable one,
    in its block or the next; pointers are doubled inside the block, and the ways from block to block are composed.  A row
    holds the distinct milliseconds of one user in one block.  Rows without user or time are left out.
    """
    rows = events.filter(F.col("user_id").isNotNull() & F.col("ts").isNotNull()).select(
        "user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")
    )
    rows = rows.withColumn("ms", F.unix_millis("ts"))
    if interval_ms <= 0:
        return rows.drop("ts")
    many = max(2, block_ms // interval_ms)
    width = many * interval_ms
    inside = F.pmod("ms", F.lit(width))
    block = F.expr(f"(ms - pmod(ms, {width})) div {width}")
    early = inside < interval_ms
    own = F.struct(block.alias("place"), F.lit(False).alias("guest"))
    # the first interval of a block also stands at the end of the block before
    visit = F.when(early, F.struct((block - 1).alias("place"), F.lit(True).alias("guest")))
    seats = (
        rows.groupBy("user_id", "ms")
        .agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
        .select("user_id", "ms", "event_id", early.alias("early"), F.explode(F.filter(F.array(own, visit), lambda x: x.isNotNull())).alias("seat"))
        .select("user_id", "ms", "event_id", "early", "seat.*")
    )
    reach = Window.partitionBy("user_id", "place").orderBy("ms").rangeBetween(Window.unboundedPreceding, interval_ms - 1)
    pointed = seats.withColumn("next", F.count("*").over(reach).cast("int"))
    at_home = ~F.col("guest")
    blocks = (
        pointed.groupBy("user_id", "place")
        .agg(
            F.sort_array(F.collect_list(F.when(at_home, F.struct("ms", "event_id", "next")))).alias("met"),
            F.count_if(at_home & F.col("early")).cast("int").alias("early"),
        )
        .filter(F.size("met") > 0)
    )
    # a pointer from the block's size on counts the events of the next block that come too early
    size = F.size("met")
    far = blocks.withColumn("far", F.transform("met", lambda x: x["next"]))
    for _ in range((many + 1).bit_length()):
        far = far.withColumn("far", F.transform("far", lambda p: F.when(p < size, F.element_at("far", F.least(p, size - 1) + 1)).otherwise(p)))
    ways = F.transform(
        F.sequence(F.lit(0), F.col("early")),
        lambda i: F.when(i < size, F.element_at("far", F.least(i, size - 1) + 1) - size).otherwise(F.lit(0)),
    )
    far = written(far.select("user_id", "place", "met", ways.alias("map")), "throttle")
    met = far.select("user_id", "place", "met").join(entries(far.select("user_id", "place", "map"), "user_id"), ["user_id", "place"])
    none = F.array().cast("array<struct<event_id: bigint, ms: bigint>>")

    def go(s: Column, _: Column) -> Column:
        here = F.element_at("met", F.least(s["at"], size - 1) + 1)
        kept = F.concat(s["kept"], F.array(F.struct(here["event_id"].alias("event_id"), here["ms"].alias("ms"))))
        return F.when(s["at"] < size, F.struct(here["next"].alias("at"), kept.alias("kept"))).otherwise(s)

    walk = F.aggregate(
        F.sequence(F.lit(0), F.lit(many)), F.struct(F.col("entry").alias("at"), none.alias("kept")), go, lambda s: s["kept"]
    )
    return met.select("user_id", F.explode(walk).alias("e")).select("user_id", "e.event_id", "e.ms")


# ----- streams in event time ----------------------------------------------------------------------
class InOrder(StatefulProcessor):
    """Keeps the rows (us, event_id, a, b) of a key until the watermark has passed them; then each is taken in the order of
    (us, event_id) by ``take``, which changes the state and may give a row.

    A row at or before the watermark of earlier batches is late and not taken: the state has gone past it.
    """

    names: tuple[str, ...]
    start: tuple

    def take(self, state: tuple, row: tuple) -> tuple[tuple, tuple | None]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        four = StructType([StructField(f, LongType()) for f in ("us", "event_id", "a", "b")])
        self.waiting = handle.getListState("waiting", four)
        self.state = handle.getValueState("state", StructType([StructField(f"s{i}", LongType()) for i in range(len(self.start))]))
        self.timer = handle.getValueState("timer", StructType([StructField("ms", LongType())]))

    def _wake_at(self, us: int) -> None:
        ms = -(-us // 1000)
        if self.timer.exists():
            now = self.timer.get()[0]
            if now <= ms:
                return
            self.handle.deleteTimer(now)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        first = None
        for frame in rows:
            timely = [r for r in zip(*(frame[c].tolist() for c in ("us", "event_id", "a", "b")), strict=True) if r[0] > passed]
            if timely:
                self.waiting.appendList(timely)
                first = min(r[0] for r in timely) if first is None else min(first, *(r[0] for r in timely))
        if first is not None:
            self._wake_at(first)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get())
        due = [r for r in rows if r[0] <= passed]
        rest = rows[len(due) :]
        state = tuple(self.state.get()) if self.state.exists() else self.start
        out = []
        for row in due:
            state, given = self.take(state, row)
            if given:
                out.append((key[0], *given))
        self.state.update(state)
        self.timer.clear()
        if rest:
            self.waiting.put(rest)
            self._wake_at(rest[0][0])
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=list(self.names)).astype("int64")

    def close(self) -> None:
        pass


class SessionLimits(InOrder):
    """Ends sessions by their limits; a row has its new blocks and characters."""

    names = ("user_id", "session", "steps", "blocks", "chars")
    start = (0, 0, 0, 0, 0)

    def __init__(self, least: int | None, max_steps: int, max_stalled: int):
        self.least, self.max_steps, self.max_stalled = least, max_steps, max_stalled

    def take(self, state: tuple, row: tuple) -> tuple[tuple, tuple | None]:
        session, steps, stalled, blocks, chars = state
        fresh, size = row[2], row[3]
        steps, blocks, chars = steps + 1, blocks + fresh, chars + size * (fresh > 0)
        stalled = 0 if fresh else stalled + 1
        if steps < self.max_steps and stalled < self.max_stalled:
            return (session, steps, stalled, blocks, chars), None
        closed = (session, steps, blocks, chars) if self.least is None or chars >= self.least else None
        return (session + 1, 0, 0, 0, 0), closed


class Throttle(InOrder):
    """Accepts a row when at least the interval passed since the last accepted one."""

    names = ("user_id", "event_id", "ms")
    start = (0, 0)

    def __init__(self, interval_ms: int):
        self.interval_ms = interval_ms

    def take(self, state: tuple, row: tuple) -> tuple[tuple, tuple | None]:
        met, last = state
        ms = row[0] // 1000
        if met and ms - last < self.interval_ms:
            return state, None
        return (1, ms), (row[1], ms)


def _stream(rows: DataFrame, processor: InOrder, schema: str, delay: str) -> DataFrame:
    return (
        rows.withWatermark("ts", delay)
        .groupBy("user_id")
        .transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    )


def session_stream(
    steps: DataFrame, delay: str, least: int | None = None, max_steps: int = MAX_STEPS, max_stalled: int = MAX_STALLED
) -> DataFrame:
    """``capture_sessions`` of a stream.  Rows wait until the watermark has passed them, so the result does not depend on the
    order of arrival, as long as no row is later than ``delay``; later ones are dropped (see ``late_sink``)."""
    rows = steps.filter("ts IS NOT NULL").select(
        "user_id", "ts", F.unix_micros("ts").alias("us"), F.coalesce("event_id", F.lit(0)).alias("event_id"), F.col("fresh").alias("a"), F.col("chars").alias("b")
    )
    return _stream(rows, SessionLimits(least, max_steps, max_stalled), SESSION, delay)


def throttle_stream(events: DataFrame, delay: str, interval_ms: int = 1000) -> DataFrame:
    """``throttled`` of a stream, under the same terms as ``session_stream``."""
    rows = events.filter("user_id IS NOT NULL AND ts IS NOT NULL").select(
        "user_id", "ts", F.unix_micros("ts").alias("us"), F.coalesce("event_id", F.lit(0)).alias("event_id"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")
    )
    return _stream(rows, Throttle(interval_ms), ACCEPTED, delay)


def late_sink(delay_ms: int):
    """foreachBatch sink for the rows that a watermark of ``delay_ms`` drops, written under their batch id.

    A row is late if it is not newer than the watermark, the newest time of the batches before less the delay.  The newest
    time of each batch is one number in a table beside the rows.
    """

    def make(target: str):
        def write(batch: DataFrame, batch_id: int) -> None:
            spark = batch.sparkSession
            newest = batch.agg(F.lit(batch_id).cast("long").alias("of"), F.unix_millis(F.max("ts")).alias("ms"))
            newest.write.mode("overwrite").parquet(f"{target}-newest/batch={batch_id}")
            before = spark.read.parquet(f"{target}-newest").filter(F.col("of") < batch_id).agg(F.max("ms")).first()[0]
            late = batch.filter(F.unix_micros("ts") <= (F.lit(before) - delay_ms) * 1000) if before is not None else batch.limit(0)
            late.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

        return write

    return make
