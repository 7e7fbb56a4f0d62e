"""Document store: versioned nested records, JSON lines, telemetry CSV, box TSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import blank_to_null, col, collapse, let

# --- fixed values: record layout ---
SCHEMA_VERSION = 15
BLOCK = "struct<type:string,text:string>"
COUNTS = "array<struct<key:string,count:int>>"
PARAGRAPH_REPORT = "struct<blockIndex:int,changeKinds:array<string>,beforeText:string,afterText:string>"
CHUNK_REPORT = (
    "struct<firstBlockIndex:int,lastBlockIndex:int,status:string,rejectionReason:string,failureSummary:string,"
    "targetParagraphCount:int,contextBeforeChars:int,contextAfterChars:int,originalChars:int,cleanedChars:int,"
    f"changedParagraphs:int,droppedParagraphs:int,paragraphReports:array<{PARAGRAPH_REPORT}>>"
)
RUN_NUMBERS = (
    "totalParagraphs eligibleParagraphs totalChunks attemptedChunks acceptedChunks rejectedChunks changedParagraphs "
    "droppedParagraphs eligibleCharsBefore eligibleCharsAfter"
).split()
DIAGNOSTICS = (
    "struct<modelId:string,promptVersion:int,executionBackendLabel:string," + "".join(f"{n}:int," for n in RUN_NUMBERS)
    + f"changeKindCounts:{COUNTS},rejectionReasonCounts:{COUNTS},chunkReports:array<{CHUNK_REPORT}>>"
)
RECORD = (
    f"struct<title:string,sourceLabel:string,kind:string,pageCount:int,paragraphCount:int,headingCount:int,"
    f"metadataBlocks:array<{BLOCK}>,footnoteBlocks:array<{BLOCK}>,blocks:array<{BLOCK}>,"
    f"presentation:struct<modelId:string,promptVersion:int,executionBackendLabel:string,blocks:array<{BLOCK}>>,"
    f"summary:struct<modelId:string,promptVersion:int,durationMs:bigint,sourceSignature:string,text:string>,"
    f"diagnostics:{DIAGNOSTICS}>"
)
SAMPLE_COLUMNS = [
    "timestamp_iso", "elapsed_seconds", "battery_percent", "is_charging", "voltage_volts", "current_amps", "draw_watts",
    "battery_temp_c", "process_cpu_percent", "process_memory_mb", "thread_count", "accessibility_service_enabled",
    "summary_status", "playback_status",
]
BOX_SCHEMA = "text STRING, top INT, `left` INT, bottom INT, `right` INT, isHeading BOOLEAN, isClickable BOOLEAN"


def write_documents(docs: DataFrame, path: str) -> None:
    """One nested record per document, stamped with and partitioned by the schema version."""
    docs.withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.mode("append").partitionBy(
        "schema_version"
    ).parquet(path)


def read_documents_of_version(spark: SparkSession, path: str, version: int = SCHEMA_VERSION) -> DataFrame:
    """Records of one version; other versions are pruned as partitions."""
    return spark.read.parquet(path).filter(F.col("schema_version") == version).drop("schema_version")


def to_json_line(record) -> Column:
    return F.to_json(col(record))


def read_diagnostics(d: Column) -> Column:
    """Tolerant reading of the nested run record: missing numbers are 0 but for the length of a cleaned chunk, blank strings
    null, missing lists empty, counts without a key left out, a chunk without a status is accepted and unchanged."""
    # bound: a line that is read here would be parsed anew for every field
    return let(d, _tolerant)


def _tolerant(d: Column) -> Column:
    number = lambda c: F.coalesce(c, F.lit(0))
    listed = lambda c, kind: F.coalesce(c, F.array().cast(kind))

    def counts(c):
        keyed = F.filter(listed(c, COUNTS), lambda x: blank_to_null(x["key"]).isNotNull())
        return F.transform(keyed, lambda x: F.struct(x["key"].alias("key"), number(x["count"]).alias("count")))

    def paragraph(p):
        kinds = F.filter(listed(p["changeKinds"], "array<string>"), lambda k: blank_to_null(k).isNotNull())
        return F.struct(number(p["blockIndex"]).alias("blockIndex"), kinds.alias("changeKinds"), p["beforeText"], p["afterText"])

    def chunk(c):
        numbers = ["targetParagraphCount", "contextBeforeChars", "contextAfterChars", "originalChars"]
        return F.struct(
            number(c["firstBlockIndex"]).alias("firstBlockIndex"), number(c["lastBlockIndex"]).alias("lastBlockIndex"),
            F.coalesce(blank_to_null(c["status"]), F.lit("AcceptedUnchanged")).alias("status"),
            blank_to_null(c["rejectionReason"]).alias("rejectionReason"), blank_to_null(c["failureSummary"]).alias("failureSummary"),
            *[number(c[n]).alias(n) for n in numbers], c["cleanedChars"],
            number(c["changedParagraphs"]).alias("changedParagraphs"), number(c["droppedParagraphs"]).alias("droppedParagraphs"),
            F.transform(listed(c["paragraphReports"], f"array<{PARAGRAPH_REPORT}>"), paragraph).alias("paragraphReports"),
        )

    whole = F.struct(
        F.coalesce(d["modelId"], F.lit("")).alias("modelId"), number(d["promptVersion"]).alias("promptVersion"),
        blank_to_null(d["executionBackendLabel"]).alias("executionBackendLabel"), *[number(d[n]).alias(n) for n in RUN_NUMBERS],
        counts(d["changeKindCounts"]).alias("changeKindCounts"), counts(d["rejectionReasonCounts"]).alias("rejectionReasonCounts"),
        F.transform(listed(d["chunkReports"], f"array<{CHUNK_REPORT}>"), chunk).alias("chunkReports"),
    )
    return F.when(d.isNotNull(), whole.cast(DIAGNOSTICS))


def from_json_line(line) -> Column:
    """Tolerant reading: missing numbers are 0, blank strings null, an empty presentation or a summary
    without model, signature or text is null, the kind comes from the label when absent; diagnostics as in
    ``read_diagnostics``."""
    from leafmill.sources.corpus import document_kind

    r = F.from_json(col(line), RECORD)
    number = lambda c: F.coalesce(c, F.lit(0))
    blocks = lambda c: F.coalesce(c, F.array().cast(f"array<{BLOCK}>"))
    p, s = r.presentation, r.summary
    presentation = F.when(
        F.size(blocks(p.blocks)) > 0,
        F.struct(
            p.modelId.alias("modelId"), number(p.promptVersion).alias("promptVersion"),
            blank_to_null(p.executionBackendLabel).alias("executionBackendLabel"), p.blocks.alias("blocks"),
        ),
    )
    whole = (
        blank_to_null(s.modelId).isNotNull() & blank_to_null(s.sourceSignature).isNotNull() & blank_to_null(s.text).isNotNull()
    )
    summary = F.when(
        whole,
        F.struct(
            s.modelId.alias("modelId"), number(s.promptVersion).alias("promptVersion"), s.durationMs.alias("durationMs"),
            s.sourceSignature.alias("sourceSignature"), s.text.alias("text"),
        ),
    )
    return F.struct(
        F.coalesce(r.title, F.lit("")).alias("title"), F.coalesce(r.sourceLabel, F.lit("")).alias("sourceLabel"),
        F.coalesce(blank_to_null(r.kind), document_kind(r.sourceLabel)).alias("kind"),
        number(r.pageCount).alias("pageCount"), number(r.paragraphCount).alias("paragraphCount"),
        number(r.headingCount).alias("headingCount"), blocks(r.metadataBlocks).alias("metadataBlocks"),
        blocks(r.footnoteBlocks).alias("footnoteBlocks"), blocks(r.blocks).alias("blocks"),
        presentation.alias("presentation"), summary.alias("summary"),
        read_diagnostics(r.diagnostics).alias("diagnostics"),
    )


def write_json_lines(docs: DataFrame, record: str, path: str) -> None:
    docs.select(to_json_line(record).alias("value")).write.mode("overwrite").text(path)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(from_json_line("value").alias("document"))


def write_samples_csv(samples: DataFrame, path: str) -> None:
    """Every field quoted, quotes doubled, line breaks turned into blanks."""
    flat = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\r\n]", " ").alias(c) for c in samples.columns]
    samples.select(*flat).write.mode("append").csv(
        path, quoteAll=True, escape='"', emptyValue="", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def read_samples_csv(spark: SparkSession, path: str) -> DataFrame:
    """Samples of ``write_samples_csv`` with a user before the fourteen columns; fields are text, empty ones stay empty."""
    schema = ", ".join(["user_id long", *[f"{c} string" for c in SAMPLE_COLUMNS]])
    rows = spark.read.csv(path, header=True, quote='"', escape='"', schema=schema, mode="FAILFAST")
    return rows.fillna("", SAMPLE_COLUMNS)


def csv_field(c) -> Column:
    """One field of such a line."""
    text = F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), "[\r\n]", " ")
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def write_boxes(boxes: DataFrame, path: str) -> None:
    """Boxes (columns of ``BOX_SCHEMA``) as tab-separated lines with a header; tabs and line breaks in texts become blanks."""
    flat = boxes.withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), "[\t\r\n]", " "))
    flat.write.mode("append").csv(
        path, sep="\t", header=True, quote="", escape="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated boxes with a header; a row of another width fails the read."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=BOX_SCHEMA, mode="FAILFAST", quote="")
    return rows.filter(collapse("text") != "")
