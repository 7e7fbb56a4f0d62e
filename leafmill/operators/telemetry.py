"""Telemetry samples with all their columns: the last reading of each kind, carried from window to window.

A sample stands for one user and one tumbling window.  A kind of reading that a window lacks keeps its last value; busy time is a
running total whose change gives the load.  Both are carried over time cells (``ordering.carried``): no window holds a user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.ordering import carried

CELL_MS = 86_400_000
#: Readings and the value of a sample before the first one (null: empty field).
READINGS = {
    "battery_percent": None, "charging": None, "voltage": None, "current": None, "temperature": None,
    "memory_mb": 0, "threads": 0, "accessible": False, "summary_status": "idle", "playback": "idle",
}


def playback_status(speaking: Column, has_segments: Column) -> Column:
    return F.when(speaking, "speaking").when(has_segments, "paused").otherwise("idle")


def telemetry_samples(readings: DataFrame, seconds: int, cell_ms: int = CELL_MS) -> DataFrame:
    """(user_id, window_ms, elapsed_seconds, the columns of ``READINGS``, draw_watts, cpu_hundredths) per user and window.

    ``readings`` are (user_id, at, seq, busy_ms, the columns of ``READINGS``), a null being no reading; ``at`` are milliseconds.
    Of a window the last reading of each kind counts, by (at, seq).  ``cpu_hundredths`` is 10,000 times the busy time since the
    sample before over the time since then, rounded half up, null for the first sample of a user; negative busy time is 0.
    Rows without user or time are left out.
    """
    width = 1000 * seconds
    rows = readings.filter("user_id IS NOT NULL AND at IS NOT NULL").withColumn("window_ms", F.expr(f"at - pmod(at, {width})"))

    def last(name: str) -> Column:
        return F.max(F.when(F.col(name).isNotNull(), F.struct("at", "seq", F.col(name).alias("value"))))

    samples = rows.groupBy("user_id", "window_ms").agg(
        *[last(name).alias(name) for name in READINGS], F.sum(F.greatest(F.coalesce("busy_ms", F.lit(0)), F.lit(0))).alias("busy")
    )
    before = {f"was_{name}": ("max", F.col(name)) for name in READINGS}
    before |= {"previous": ("max", F.col("window_ms")), "begun": ("min", F.col("window_ms"))}
    met = carried(samples, ["user_id"], "window_ms", ["window_ms"], before, cell_ms)
    now = {
        name: F.coalesce(F.col(f"{name}.value"), F.col(f"was_{name}.value"), *([F.lit(start)] if start is not None else []))
        for name, start in READINGS.items()
    }
    wall = F.col("window_ms") - F.col("previous")
    rows = met.select(
        "user_id", "window_ms", F.expr("(window_ms - coalesce(begun, window_ms)) div 1000").alias("elapsed_seconds"),
        *[value.alias(name) for name, value in now.items()], "busy", wall.alias("wall"),
    )
    return rows.withColumns(
        {"draw_watts": F.abs("current") * F.col("voltage"), "cpu_hundredths": F.expr("(20000 * busy + wall) div (2 * wall)")}
    ).drop("busy", "wall")


def sample_fields(samples: DataFrame) -> DataFrame:
    """The fourteen text fields of a sample, with its user before them; a null reading is an empty field."""

    def given(name: str, digits: int = 0) -> Column:
        text = F.format_string(f"%.{digits}f", F.col(name).cast("double")) if digits else F.col(name).cast("string")
        return F.when(F.col(name).isNotNull(), text).otherwise(F.lit(""))

    cents = F.col("cpu_hundredths")
    load = F.concat(F.expr("cpu_hundredths div 100").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return samples.select(
        "user_id",
        F.date_format(F.timestamp_millis("window_ms"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp_iso"),
        F.col("elapsed_seconds").cast("string").alias("elapsed_seconds"),
        given("battery_percent").alias("battery_percent"),
        given("charging").alias("is_charging"),
        given("voltage", 3).alias("voltage_volts"),
        given("current", 6).alias("current_amps"),
        given("draw_watts", 3).alias("draw_watts"),
        given("temperature", 1).alias("battery_temp_c"),
        F.when(cents.isNotNull(), load).otherwise(F.lit("")).alias("process_cpu_percent"),
        given("memory_mb").alias("process_memory_mb"),
        given("threads").alias("thread_count"),
        given("accessible").alias("accessibility_service_enabled"),
        given("summary_status").alias("summary_status"),
        given("playback").alias("playback_status"),
    )
