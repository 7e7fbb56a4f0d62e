"""Operator 8: document fingerprints from prefix polynomial hashes.

A prefix array holds the polynomial of every prefix of a text, modulo two primes, so the hash of any span
is one subtraction and one product.  Equality of two spans is equality of two hashes; the longest common
extension of two places is found by binary search over spans.  A fingerprint is the hash of the whole text
and the smallest of its window hashes; the likeness of two fingerprints estimates the share of common windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import U64, mix

# --- fixed values: two primes below 2^31 and a base for each ---
PRIMES = (2147483647, 2147483629)
BASES = (1_103_515_245, 1_284_865_837)

WINDOW = 12
KEPT = 64


class Powers:
    """Powers of a base and of its inverse, grown to the longest text seen."""

    def __init__(self, base: int, prime: int):
        self.base, self.prime, self.inverse = base, prime, pow(base, -1, prime)
        self.up = self.down = np.ones(1, U64)

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            size, p = len(self.up), U64(self.prime)
            self.up = np.concatenate((self.up, self.up * U64(pow(self.base, size, self.prime)) % p))
            self.down = np.concatenate((self.down, self.down * U64(pow(self.inverse, size, self.prime)) % p))


POWERS = [Powers(b, p) for b, p in zip(BASES, PRIMES, strict=True)]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHash:
    """Prefix arrays of one text."""

    def __init__(self, codes: np.ndarray):
        self.size = len(codes)
        values = codes.astype(U64) + U64(1)
        self.prefix = []
        for power in POWERS:
            power.reach(self.size + 1)
            terms = values * power.up[: self.size] % U64(power.prime)
            self.prefix.append(np.concatenate((np.zeros(1, U64), np.cumsum(terms, dtype=U64))))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """62-bit hashes of the spans [start, end), equal for equal spans wherever they lie."""
        out = []
        for power, prefix in zip(POWERS, self.prefix, strict=True):
            p = U64(power.prime)
            out.append((prefix[end] - prefix[start]) % p * power.down[start] % p)
        return (out[0] << U64(31)) | out[1]

    def span(self, start: int, end: int) -> int:
        return int(self.spans(np.array([start]), np.array([end]))[0])


def same_span(a: PrefixHash, i: int, b: PrefixHash, j: int, length: int) -> bool:
    """Whether a[i:i+length] and b[j:j+length] are equal; spans that leave a text are not."""
    if i < 0 or j < 0 or i + length > a.size or j + length > b.size:
        return False
    return a.span(i, i + length) == b.span(j, j + length)


def common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """Length of the longest common span that begins at a[i] and b[j]."""
    low, high = 0, min(a.size - i, b.size - j)
    while low < high:
        middle = (low + high + 1) // 2
        if same_span(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def windows(codes: PrefixHash, window: int = WINDOW, first: int = 0) -> np.ndarray:
    """Hash of the window that ends at each character from ``first`` on; the windows at the beginning are shorter."""
    end = np.arange(first + 1, codes.size + 1)
    start = np.maximum(end - window, 0)
    return mix(codes.spans(start, end) ^ ((end - start).astype(U64) << U64(58))) >> U64(32)


def smallest(values: np.ndarray, kept: int = KEPT) -> np.ndarray:
    """The ``kept`` smallest different values, in order."""
    if len(values) > 8 * kept:
        # most values are different: a partition leaves few to sort, and equal ones are made up for
        part = np.unique(np.partition(values, 4 * kept)[: 4 * kept])
        if len(part) >= kept:
            return part[:kept]
    return np.unique(values)[:kept]


def written(prefix: PrefixHash, sketch: np.ndarray) -> str:
    whole = prefix.span(0, prefix.size)
    return f"{prefix.size:x}-{whole:016x}-" + sketch.astype(">u4").tobytes().hex()


def fingerprint(text: str, window: int = WINDOW, kept: int = KEPT) -> str:
    """length-hash-sketch; equal texts have equal fingerprints, and only hash collisions join others."""
    prefix = PrefixHash(code_points(text))
    return written(prefix, smallest(windows(prefix, window), kept))


def likeness(one: str, other: str, kept: int = KEPT) -> float:
    """Share of common windows of two texts (Dice), 0 to 1, from their fingerprints alone.

    Exact for texts of up to ``kept`` windows, else estimated by the smallest ``kept`` of both.  Two empty
    texts are alike, an empty and another one are not.
    """
    if one == other:
        return 1.0
    a, b = (np.frombuffer(bytes.fromhex(x.rsplit("-", 1)[1]), ">u4") for x in (one, other))
    if not len(a) or not len(b):
        return 0.0
    union = np.union1d(a, b)[:kept]
    shared = len(np.intersect1d(np.intersect1d(a, b), union))
    return 2 * shared / (len(union) + shared)


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, kept_prefix long"
)


def _in_order(docs: DataFrame, parts: int) -> DataFrame:
    """(part, guest, doc_id, text): the documents dealt to descending ranges of doc_id, each range with the
    first document of the next one as its guest.

    Only range bounds and the first id of each range come to the driver: a few numbers per partition.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select(F.col("doc_id").cast("double").alias("id"))
    steps = [i / parts for i in range(1, parts)]
    cuts = sorted(set(ids.approxQuantile("id", steps, 0.2 / parts)))
    splits = [-float("inf"), *(cuts or [0.0]), float("inf")]
    # repeated cuts are gone and null ids have a last range of their own
    ranges = Bucketizer(splits=splits, inputCol="id", outputCol="bucket", handleInvalid="keep")
    placed = (
        ranges.transform(rows.withColumn("id", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("nan")))))
        .withColumn("part", F.when(F.col("doc_id").isNull(), len(splits)).otherwise(len(splits) - 2 - F.col("bucket")).cast("int"))
        .drop("id", "bucket")
    )
    firsts = sorted(placed.groupBy("part").agg(F.max("doc_id").alias("doc_id")).collect())
    guests = [(row.doc_id, firsts[k - 1].part) for k, row in enumerate(firsts)]
    # one row for each range: bounded by the number of partitions
    guests = spark.createDataFrame(guests, "first long, host int")
    own = F.struct(F.col("part"), F.lit(False).alias("guest"))
    visit = F.when(F.col("host").isNotNull(), F.struct(F.col("host").alias("part"), F.lit(True).alias("guest")))
    return (
        placed.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("first")), "left")
        .select(F.explode(F.filter(F.array(own, visit), lambda x: x.isNotNull())).alias("seat"), "doc_id", "text")
        .select("seat.part", "seat.guest", "doc_id", "text")
    )


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, window: int = WINDOW, kept: int = KEPT) -> DataFrame:
    """Fingerprint of every whole text and of its edited text, and their likeness.

    The edited text ends in the beginning of the next document, in descending doc_id (after the last: the
    first).  A null text is empty; null ids come last; equal ids follow the order of their texts; a single
    document is its own next one.  ``kept_prefix`` is the longest common beginning of both texts.  One shuffle of the
    texts, by ranges of doc_id; inside a range a task holds two texts at a time.
    """
    spark = docs.sparkSession
    parts = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = _in_order(docs, parts)
    dealt = placed.repartitionByRange(parts // 3, "part").sortWithinPartitions(
        "part", "guest", F.col("doc_id").desc_nulls_last(), "text"
    )

    def finish(one, two) -> dict:
        doc_id, text, prefix, hashes, own = one
        half = len(text) // 2
        stay = len(text) - half
        other = edited(text, two[1])
        codes = PrefixHash(code_points(other))
        # up to the edit both texts have the same windows
        joined = np.concatenate((hashes[:stay], windows(codes, window, stay)))
        changed = written(codes, smallest(joined, kept))
        return {
            "doc_id": doc_id,
            "n_chars": len(text),
            "edited_sha256": hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(),
            "fingerprint": own,
            "edited_fingerprint": changed,
            "near_edited": likeness(own, changed, kept),
            "near_next": likeness(own, two[4], kept),
            "kept_prefix": common_extension(prefix, 0, codes, 0),
        }

    def read(doc_id, text):
        prefix = PrefixHash(code_points(text))
        hashes = windows(prefix, window)
        return doc_id, text, prefix, hashes, written(prefix, smallest(hashes, kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, closed, out = None, None, False, []
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for k in range(batch.num_rows):
                p, guest, doc_id, text = (c[k].as_py() for c in columns)
                if p != part:
                    part, last, closed = p, None, False
                if closed:  # a further guest of the same id
                    continue
                now = read(doc_id, text)
                if last is not None:
                    out.append(finish(last, now))
                last, closed = now, guest
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)

    return dealt.mapInArrow(run, RESULT)


SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
        ("kept_prefix", pa.int64()),
    ]
)
