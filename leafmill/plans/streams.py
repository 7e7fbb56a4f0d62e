"""Streaming queries (run to completion over a file stream) and document store round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leafmill.functions.text import epoch_ms
from leafmill.operators import cleanup as C
from leafmill.operators import telemetry as M
from leafmill.operators.blocks import line_blocks, peel_plain_text
from leafmill.plans.inputs import cited_blocks, given_title, model_paragraphs
from leafmill.session import checkpoint_root
from leafmill.sources import store
from leafmill.sources.corpus import read_documents, read_table
from leafmill.streaming import jobs as T
from leafmill.streaming import run as R
from leafmill.streaming import sessions as S

SIX_HOURS = 6 * 3600 * 1000
ANY_ORDER = "36500 days"


def sampled(spark, sf):
    target = R.run_once(T.samples(R.stream_events(spark, sf)), "samples", "update")
    rows = R.newest(R.read_back(spark, target), ["window_ms", "user_id"])
    return T.cpu_percent(rows).select(
        "window_ms", "user_id", "level", F.round("watts", 4).alias("watts"), "n", F.round("cpu", 6).alias("cpu")
    )


def deduped(spark, sf):
    target = R.run_once(T.session_dedupe(R.stream_events(spark, sf)), "dedupe")
    return R.read_back(spark, target).select("user_id", "key")


def _events(spark, sf):
    """The closed event table as a stream would bring it, in one piece."""
    events = read_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def sessions(spark, sf):
    """Sessions of the least length or more, in the order of events."""
    return S.capture_sessions(S.session_steps(_events(spark, sf)), S.MIN_CHARS)


def sessions_stream(spark, sf):
    """The same of a stream whose files come in any order: no row of a closed corpus is late."""
    return R.run_to_end(
        spark, R.stream_events(spark, sf), lambda e: S.session_stream(S.session_steps(e), ANY_ORDER, S.MIN_CHARS), "sessions"
    )


def _asks(events):
    base = events.withColumn("package", F.col("k") % 2).withColumn("sig", F.floor(F.col("k") / 50).cast("int"))
    lookups = base.filter("event_type in ('view', 'error')").withColumnRenamed("event_id", "lookup_id")
    tracked = base.filter("event_type in ('click', 'signup')").withColumn(
        "url", F.concat(F.lit("https://example.org/p/"), F.col("k").cast("string"))
    )
    return lookups, tracked


def recent_lookup(spark, sf):
    events = read_table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    lookups, tracked = _asks(events.withColumn("ms", epoch_ms("ts")))
    return T.recent_value(
        lookups.select("user_id", "lookup_id", "ms", "package", "sig"),
        tracked.select("user_id", "event_id", "ms", "package", "sig", "url"), SIX_HOURS,
    )


def recent_lookup_stream(spark, sf):
    lookups, tracked = _asks(R.stream_events(spark, sf))
    pairs = T.recent_pairs(
        lookups.select("user_id", "lookup_id", "ts", "package", "sig"),
        tracked.select("user_id", "event_id", "ts", "package", "sig", "url"), SIX_HOURS // 60000,
    )
    return T.latest_of_pairs(R.read_back(spark, R.run_once(pairs, "lookup")))


def throttle(spark, sf):
    return S.throttled(_events(spark, sf), SIX_HOURS).select("user_id", "event_id")


def throttle_stream(spark, sf):
    stream = R.stream_events(spark, sf)
    return R.run_to_end(spark, stream, lambda e: S.throttle_stream(e, ANY_ORDER, SIX_HOURS), "throttle").select("user_id", "event_id")


def latest_positions(spark, sf):
    moves = R.stream_events(spark, sf).select(
        "user_id", (F.col("k") % 7).alias("item"), F.unix_millis("ts").alias("at"), "event_id",
        (F.col("k") % 10).alias("block"), (F.floor("value") % 200).cast("int").alias("offset"),
    )
    keys, order = ["user_id", "item"], ["at", "event_id"]
    target = R.run_once(moves, "positions", "append", T.position_sink(keys, order))
    return T.merged(spark, target, keys, order).select("user_id", "item", "block", "offset", "event_id")


def _fragments(spark, sf):
    """Assistant turns cut in steps of 40 characters: plain, cumulative, repeated-tail and overlapping pieces."""
    turns = read_table(spark, sf, "conversations").filter("role = 'assistant' and length(text) > 0")
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(40))

    def piece(at, i):
        end = F.least(at + 40, F.length("text"))
        return (
            F.when(i % 4 == 1, F.substr("text", F.lit(1), end))
            .when(i % 4 == 3, F.substr("text", F.greatest(at - 9, F.lit(1)), end - F.greatest(at - 9, F.lit(1)) + 1))
            .otherwise(F.substr("text", at + 1, end - at))
        )

    return turns.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("response_id"),
        "text", F.transform(starts, piece).alias("pieces"),
    )


def fragment_assembly(spark, sf):
    rows = _fragments(spark, sf)
    return rows.select("response_id", T.assemble_fragments("pieces").alias("text"))


def fragment_stream(spark, sf):
    folder = R.new_folder(spark, "fragments")
    rows = _fragments(spark, sf).select("response_id", F.posexplode("pieces").alias("seq", "piece"))
    rows.write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).parquet(folder)
    target = R.run_once(T.fragment_texts(stream), "texts", "update")
    return R.newest(R.read_back(spark, target), ["response_id"])


def incremental_cleanup(spark, sf):
    """Documents arrive as a stream; every batch is chunked, rewritten and validated once."""

    def clean(docs):
        chunks = C.cleanup_chunks(line_blocks(docs), C.WEB)
        rows = chunks.withColumn("cleaned", model_paragraphs(F.col("doc_id"), F.col("chunk"), F.col("paras")))
        return C.run_diagnostics(C.validated(rows.withColumn("failure", F.lit(None).cast("string")), C.WEB), "doc_id")

    target = R.run_once(T.new_documents(R.stream_documents(spark, sf)), "cleanup", "append", T.cleanup_sink(clean))
    return R.read_back(spark, target).select("doc_id", "chunks", "eligible", "chars_before")


def activity_status(spark, sf):
    target = R.run_once(T.status(R.stream_events(spark, sf)), "status", "update")
    rows = R.newest(R.read_back(spark, target), ["window_ms", "user_id"])
    return rows.groupBy("window_ms", "status").agg(F.count(F.lit(1)).alias("users"))


# ----- store round trips ------------------------------------------------------------------------
def _records(spark, sf):
    docs = cited_blocks(spark, sf)
    plain = F.transform("blocks", lambda b: F.struct(b.type.alias("type"), b.text.alias("text")))
    empty = F.slice(plain, 1, 0)
    presentation = F.when(
        F.col("doc_id") % 3 == 0,
        F.struct(F.lit("model-a").alias("modelId"), F.lit(11).alias("promptVersion"), F.lit(" ").alias("executionBackendLabel"),
                 F.when(F.col("doc_id") % 6 == 0, plain).otherwise(empty).alias("blocks")),
    )
    summary = F.when(
        F.col("doc_id") % 4 == 0,
        F.struct(F.lit("model-a").alias("modelId"), F.lit(2).alias("promptVersion"), F.lit(None).cast("long").alias("durationMs"),
                 F.when(F.col("doc_id") % 8 == 0, "sig").otherwise(" ").alias("sourceSignature"), F.lit("A text").alias("text")),
    )
    record = F.struct(
        "title", F.col("source").alias("sourceLabel"), F.when(F.col("doc_id") % 5 != 0, "WEB").alias("kind"),
        F.when(F.col("doc_id") % 2 == 0, 1).alias("pageCount"),
        F.size(F.filter("blocks", lambda b: b.type == "Paragraph")).alias("paragraphCount"),
        F.size(F.filter("blocks", lambda b: b.type == "Heading")).alias("headingCount"),
        empty.alias("metadataBlocks"), empty.alias("footnoteBlocks"), plain.alias("blocks"), presentation.alias("presentation"),
        summary.alias("summary"),
    )
    return docs.select("doc_id", record.alias("record"))


def _flat(df, name):
    r = F.col(name)
    return df.select(
        "doc_id", r.title.alias("title"), r.kind.alias("kind"), r.pageCount.alias("page_count"), r.paragraphCount.alias("paragraphs"),
        F.size(r.blocks).alias("n_blocks"), F.size(r.presentation.blocks).alias("shown"),
        r.presentation.executionBackendLabel.alias("backend"), r.summary.text.alias("summary"),
        F.array_join(F.transform(r.blocks, lambda b: F.concat(b.type, F.lit("="), b.text)), "|").alias("body"),
    )


def json_round_trip(spark, sf):
    rows = _records(spark, sf).withColumn("line", store.to_json_line("record"))
    return _flat(rows.withColumn("back", store.from_json_line("line")), "back")


def versioned_store(spark, sf):
    """Written at this version and at another one; only this version is read back."""
    path = f"{checkpoint_root(spark)}/documents-{uuid.uuid4().hex}"
    rows = _records(spark, sf)
    store.write_documents(rows, path)
    rows.withColumn("schema_version", F.lit(store.SCHEMA_VERSION - 1)).write.mode("append").partitionBy("schema_version").parquet(path)
    return _flat(store.read_documents_of_version(spark, path), "record").select("doc_id", "title", "n_blocks")


def telemetry_csv(spark, sf):
    """Events as quoted sample lines, read back."""
    path = f"{checkpoint_root(spark)}/samples-{uuid.uuid4().hex}"
    rows = read_table(spark, sf, "events").select(
        "event_id", "event_type", F.round("value", 2).alias("value"), F.concat(F.col("props"), F.lit('\n"end"')).alias("note")
    )
    store.write_samples_csv(rows, path)
    back = spark.read.csv(path, header=True, quote='"', escape='"', schema="event_id long, event_type string, value double, note string")
    return back


def _readings(events):
    """Each kind of event as one kind of reading; every event costs ``k`` ms."""
    is_a = lambda kind, value: F.when(F.col("event_type") == kind, value)
    k = F.col("k")
    return events.select(
        "user_id", epoch_ms("ts").alias("at"), F.col("event_id").alias("seq"), k.cast("long").alias("busy_ms"),
        is_a("click", k).alias("battery_percent"), is_a("click", k % 2 == 0).alias("charging"),
        is_a("purchase", 3 + k / 10).alias("voltage"), is_a("purchase", (k - 50) / 100).alias("current"),
        is_a("error", 20 + k / 10).alias("temperature"), is_a("signup", (k * 10).cast("long")).alias("memory_mb"),
        is_a("signup", k + 1).alias("threads"), is_a("signup", k % 3 == 0).alias("accessible"),
        is_a("error", F.concat(F.lit('step "'), k.cast("string"), F.lit('"\n'))).alias("summary_status"),
        is_a("view", M.playback_status(k % 3 == 0, k % 3 == 1)).alias("playback"),
    )


def telemetry_samples(spark, sf):
    """All fourteen columns of every sample, written as quoted lines and read back."""
    path = f"{checkpoint_root(spark)}/telemetry-{uuid.uuid4().hex}"
    events = read_table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    store.write_samples_csv(M.sample_fields(M.telemetry_samples(_readings(events), T.SAMPLE_SECONDS)), path)
    return store.read_samples_csv(spark, path)


def plain_documents(spark, sf):
    docs = read_documents(spark, sf)
    docs = docs.withColumn("given_title", given_title(F.col("doc_id"), F.col("text"), F.col("source")))
    done = peel_plain_text(docs)
    return done.select(
        "doc_id", "title", F.size("metadata").alias("n_metadata"),
        F.size(F.filter("blocks", lambda b: b.type == "Paragraph")).alias("n_paragraphs"),
    )


QUERIES = {
    "s02_plain_documents": plain_documents,
    "s07_versioned_store": versioned_store,
    "s08_json_round_trip": json_round_trip,
    "s09_telemetry_csv": telemetry_csv,
    "s09_telemetry_samples": telemetry_samples,
    "t01_samples": sampled,
    "t02_session_dedupe": deduped,
    "t03_capture_sessions": sessions,
    "t03_capture_sessions_stream": sessions_stream,
    "t04_recent_lookup": recent_lookup,
    "t04_recent_lookup_stream": recent_lookup_stream,
    "t05_throttle": throttle,
    "t05_throttle_stream": throttle_stream,
    "t06_latest_positions": latest_positions,
    "t07_fragment_assembly": fragment_assembly,
    "t07_fragment_stream": fragment_stream,
    "t08_incremental_cleanup": incremental_cleanup,
    "t09_activity_status": activity_status,
}
