"""Places of rows in an order, for groups of any size, and CRC-32 as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import saved


def seated(rows: DataFrame, keys: list[str | Column], label: str) -> DataFrame:
    """The rows in the order of ``keys`` over all partitions, with a growing number ``seat``.

    The upper bits of a seat are its range, the lower 33 its place there.  Equal rows are told apart by the place they
    were read from, so that no run of equal keys has to fit into one range.  Both tables are written: reading them again
    gives the same ranges after a lost executor.
    """
    read = saved(rows.withColumn("read_from", F.monotonically_increasing_id()), label)
    order = [*keys, F.col("read_from")]
    dealt = read.repartitionByRange(*order).sortWithinPartitions(*order).drop("read_from")
    return saved(dealt.withColumn("seat", F.monotonically_increasing_id()), f"{label}-order")


def ranked(rows: DataFrame, group: str, keys: list[str | Column], label: str) -> DataFrame:
    """The rows with ``pos``, their place from 0 in their group by ``keys``, and ``n``, the rows of the group.

    ``group`` has no nulls.  A window would put a large group into one task; here rows are dealt by ranges of (group, keys)
    and each range adds what its group has before it: one row for each range and group.
    """
    dealt = seated(rows, [group, *keys], label).withColumn("range", F.shiftright("seat", 33))
    runs = dealt.groupBy(group, "range").agg(F.count("*").alias("in_range"), F.min("seat").alias("first"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("in_range").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(group, "range", "first", before.alias("before"), F.sum("in_range").over(whole).alias("n"))
    return (
        dealt.join(runs, [group, "range"])
        .withColumn("pos", F.col("before") + F.col("seat") - F.col("first"))
        .drop("range", "seat", "first", "before")
    )


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text as DuckDB SQL: one step for each bit, lowest bit of a byte first."""
    bits = f"flatten([[(ascii(c) >> i) & 1 for i in range(8)] for c in string_split({text}, '')])"
    step = "xor(crc >> 1, CASE WHEN (xor(crc, b) & 1) = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, [x::BIGINT for x in {bits}]), lambda crc, b: {step}), 4294967295::BIGINT)"
