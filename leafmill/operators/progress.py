"""Reading progress over segments: cumulative units, fractions, seeks, remaining time.

Segments are a table of their own.  A position asks for the segment before and after it, which is one ordered
pass over segments and places of a document.  Only different places take part, and a document has no more of those
than characters, however many readers it has; readers join the answers back by place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import col, count_of
from leafmill.operators.sentences import segments

# --- fixed values: reading speed and labels ---
WORDS_PER_MINUTE = 170.0
MIN_SPEED = 0.1
WORD = r"[\p{L}\p{N}][\p{L}\p{N}'’\-]*"
SEGS = (
    "struct<u:int,w:int,out:array<struct<seg:int,block:int,s:int,e:int,text:string,"
    "u0:int,u1:int,w0:int,w1:int>>>"
)


def measured_segments(blocks) -> Column:
    """Segments with cumulative characters (u0, u1) and words (w0, w1), each segment at least one."""

    def step(acc, g):
        u = (acc.u + F.greatest(F.length(g.text), F.lit(1))).cast("int")
        w = (acc.w + F.greatest(count_of(g.text, WORD), F.lit(1))).cast("int")
        row = F.struct(
            F.size(acc.out).alias("seg"), g.block.alias("block"), g.s.alias("s"), g.e.alias("e"),
            g.text.alias("text"), acc.u.alias("u0"), u.alias("u1"), acc.w.alias("w0"), w.alias("w1"),
        )
        return F.struct(u.alias("u"), w.alias("w"), F.concat(acc.out, F.array(row)).alias("out"))

    start = F.struct(F.lit(0).alias("u"), F.lit(0).alias("w"), F.array().alias("out")).cast(SEGS)
    return F.aggregate(segments(blocks), start, step).out


def measured(docs: DataFrame) -> DataFrame:
    df = docs.withColumn("segs", measured_segments("blocks"))
    last = F.try_element_at("segs", F.lit(-1))
    return df.withColumn("total_units", F.coalesce(last.u1, F.lit(0))).withColumn(
        "total_words", F.coalesce(last.w1, F.lit(0))
    )


SEG = ["seg", "block", "s", "e", "n", "u0", "u1", "w0", "w1"]


def segment_table(docs: DataFrame) -> DataFrame:
    """(doc_id, g): one row per segment, without its text (``n`` is its length); a document without any has a null."""
    rows = measured(docs).select("doc_id", F.explode_outer("segs").alias("x"))
    fields = [F.length("x.text").alias("n") if f == "n" else F.col(f"x.{f}") for f in SEG]
    return rows.select("doc_id", F.when(F.col("x").isNotNull(), F.struct(*fields)).alias("g"))


def _timeline(table: DataFrame, places: DataFrame, block: Column, at: Column) -> DataFrame:
    """Segments and places of a document side by side; ``known`` marks the document's own rows."""
    g = table.schema["g"].dataType
    rows = table.select("doc_id", block.alias("block"), at.alias("at"), "g", F.lit(True).alias("known"))
    asks = places.select("doc_id", "block", "at", F.lit(None).cast(g).alias("g"), F.lit(None).cast("boolean").alias("known"))
    return rows.unionByName(asks)


def located(docs: DataFrame, positions: DataFrame) -> DataFrame:
    """Positions (doc_id, block, offset, ...) of known documents with their segment and the offset inside it.

    ``seg``: the segment that holds the offset, else the last one of the block before it, else the first of the block,
    else the first of a later block, else the last.  Beside it the parts: ``exact``, ``first_in``, ``later``, ``final``.
    """
    at = F.greatest(F.col("offset"), F.lit(0))
    places = positions.select("doc_id", "block", at.alias("at")).distinct()
    rows = _timeline(segment_table(docs), places, F.col("g.block"), F.col("g.s"))
    doc = Window.partitionBy("doc_id")
    before = doc.orderBy("block", "at", F.col("g").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    after = doc.orderBy(F.desc("block")).rangeBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("prior", F.last("g", True).over(before))
        .withColumn("later", F.min("g").over(after))
        .withColumn("final", F.max("g").over(doc))
        .withColumn("is_known", F.max("known").over(doc))
        .withColumn("first_in", F.min("g").over(Window.partitionBy("doc_id", "block")))
        .filter("known IS NULL AND is_known")
    )
    inside = F.col("prior.block") == F.col("block")
    answers = rows.select(
        "doc_id", "block", "at", "first_in", "later", "final",
        F.when(inside, F.col("prior")).alias("prior"),
        F.when(inside & (F.col("at") < F.col("prior.e")), F.col("prior")).alias("exact"),
    )
    df = positions.withColumn("at", at).join(answers, ["doc_id", "block", "at"])
    df = df.withColumn("seg", F.coalesce("exact", "prior", "first_in", "later", "final"))
    inner = F.least(F.greatest(F.col("at") - F.col("seg.s"), F.lit(0)), F.greatest(F.col("seg.n") - 1, F.lit(0)))
    return df.select(
        "*", F.coalesce(inner, F.lit(0)).alias("inner"), F.coalesce("final.u1", F.lit(0)).alias("total_units"),
        F.coalesce("final.w1", F.lit(0)).alias("total_words"),
    )


def segment_or_first() -> Column:
    """The variant without the 'starts before' step, of a located row."""
    return F.coalesce("exact", "first_in", "later", "final")


def segment_in_block() -> Column:
    """The variant that stays inside the block; null when the block has no segment."""
    return F.coalesce("exact", "first_in")


def progress_fraction(df: DataFrame) -> Column:
    done = F.col("seg.u0") + F.col("inner")
    return F.coalesce(
        F.when(F.col("total_units") > 0, F.least(F.greatest(done / F.col("total_units"), F.lit(0.0)), F.lit(1.0))),
        F.lit(0.0),
    )


def seek(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (doc_id, fraction, ...) of known documents with ``target`` units and the segment ``seg`` that holds them."""
    table = segment_table(docs)
    totals = table.groupBy("doc_id").agg(F.coalesce(F.max("g.u1"), F.lit(0)).alias("total"))
    share = F.least(F.greatest(F.col("fraction"), F.lit(0.0)), F.lit(1.0))
    target = F.least(F.greatest(F.floor(share * F.col("total")), F.lit(0)), F.greatest(F.col("total") - 1, F.lit(0)))
    asked = wanted.join(totals, "doc_id").withColumn("target", target.cast("int")).drop("total")
    places = asked.select("doc_id", F.lit(0).alias("block"), F.col("target").alias("at")).distinct()
    rows = _timeline(table, places, F.lit(0), F.col("g.u0"))
    before = Window.partitionBy("doc_id").orderBy("at", F.col("g").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    # segments follow each other without gaps, so the last one that begins at the target or before holds it
    answers = rows.withColumn("seg", F.last("g", True).over(before)).filter("known IS NULL")
    return asked.join(answers.select("doc_id", F.col("at").alias("target"), "seg"), ["doc_id", "target"])


def remaining_seconds(speed) -> Column:
    share = F.col("inner") / F.greatest(F.col("seg.n"), F.lit(1))
    done = F.col("seg.w0") + (F.col("seg.w1") - F.col("seg.w0")) * share
    minutes = F.greatest(F.col("total_words") - done, F.lit(0.0)) / (
        F.greatest(col(speed), F.lit(MIN_SPEED)) * WORDS_PER_MINUTE
    )
    return F.floor(F.round(minutes * 60.0, 6)).cast("int")


def time_label(seconds) -> Column:
    s = col(seconds)
    hours = F.floor(s / 3600).cast("int")
    rest = F.floor((s % 3600 + 30) / 60).cast("int")
    minutes = F.greatest(F.floor((s + 30) / 60), F.lit(1)).cast("int")
    return (
        F.when(s < 45, "<1m left")
        .when(s < 3600, F.concat(minutes.cast("string"), F.lit("m left")))
        .when(rest <= 0, F.concat(hours.cast("string"), F.lit("h left")))
        .otherwise(F.concat(hours.cast("string"), F.lit("h "), rest.cast("string"), F.lit("m left")))
    )
