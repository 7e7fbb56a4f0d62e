"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.session import checkpoint_root

U64 = np.uint64

# --- fixed values: odd 64-bit constants of the splitmix64 finaliser ---
MIX_1 = U64(0xBF58476D1CE4E5B9)
MIX_2 = U64(0x94D049BB133111EB)
GOLDEN = U64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder of the session."""
    return f"{checkpoint_root(spark)}/llm-{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """The rows as a written table in the shared folder: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser of an unsigned 64-bit array."""
    x = x + GOLDEN
    x ^= x >> U64(30)
    x *= MIX_1
    x ^= x >> U64(27)
    x *= MIX_2
    x ^= x >> U64(31)
    return x


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, one row at least.

    Bounds what numpy holds at once; a single text is never cut.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts, with null as the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def packed(parts: list[np.ndarray]) -> bytes:
    return np.concatenate(parts).tobytes() if parts else b""


def salt_of(*columns: str, parts: int) -> F.Column:
    return F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("int")


def hot_join(rows: DataFrame, facts: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``facts``, which has one row per key and says in ``size`` how many of the rows have it.

    Keys with more than one part in 4 x partitions of all rows are at most 4 x partitions many, so their facts are
    broadcast and their rows stay where they are; the rows of all other keys are shuffled.  ``size`` is dropped.
    """
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = facts.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    bound = max(1, total // parts)
    hot = facts.filter(F.col(size) > bound).drop(size)
    cold = facts.filter(F.col(size) <= bound).drop(size)
    return (
        rows.join(F.broadcast(hot), key)
        .unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how), allowMissingColumns=False)
    )


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """A bounded, repeatable sample of labelled documents: (text, label).

    Held-out rows (crc32 of the id as text, modulo 5, is 0) never enter.  ``limit`` is the bound: the
    ``limit`` labelled ids with the smallest hash.  A repeated labelled id counts once, by its largest label.
    """
    ids = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    # at most ``limit`` ids of a few bytes each: the size of the broadcast is bounded by the parameter
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "label")


def held_out(doc_id: str) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


class PairTable:
    """Lookup of int64 keys in numpy: open addressing with linear probing, filled once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * max(1, len(keys))).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rows = np.full(size, -1, np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == -1
            taken, first = np.unique(at[free], return_index=True)
            chosen = left[free][first]
            self.keys[taken], self.rows[taken] = keys[chosen], chosen
            wait = ~np.isin(left, chosen)
            at, left = (at[wait] + 1) & (size - 1), left[wait]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U64) * GOLDEN) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is not in the table.  Negative keys are never found."""
        at = self._slot(keys)
        met = self.keys[at]
        out = np.where(met == keys, self.rows[at], -1)
        rest = np.flatnonzero((met != keys) & (met != -1))
        while len(rest):
            at[rest] = (at[rest] + 1) & (len(self.keys) - 1)
            met = self.keys[at[rest]]
            out[rest] = np.where(met == keys[rest], self.rows[at[rest]], -1)
            rest = rest[(met != keys[rest]) & (met != -1)]
        return out
