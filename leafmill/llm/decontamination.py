"""Operator 1: benchmark decontamination by templates.

Numbers, names and units become typed placeholders; what stays is the template of a text.  Windows of template
tokens are hashed, and windows of documents are joined to those of the benchmark by hash.  Windows of one
alignment must fill most slots consistently: one benchmark value stands for one value of the document.  So
questions with other names and numbers are found.  A second template takes words that open a sentence as names.
Verbatim copies are found by windows of the words and numbers themselves, whatever they consist of.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import U64, mix, saved, slices

# --- fixed values: words that stand for numbers, and units that may follow one ---
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half "
    "once twice thrice first second third"
).split()
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles meter meters metre metres kilometer kilometers "
    "kilometre kilometres mg g kg gram grams kilogram kilograms ton tons lb lbs pound pounds oz ounce ounces ml l liter "
    "liters litre litres gallon gallons pint pints cup cups s sec secs second seconds min mins minute minutes h hr hrs hour "
    "hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur gbp percent degrees "
    "degree celsius fahrenheit kmh mph watt watts volt volts amp amps joule joules newton newtons hz khz mhz ghz kb mb gb tb"
).split()

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER, DIGIT, STOP, OTHER = 0, 1, 2, 3
KIND = np.full(256, OTHER, np.uint8)
KIND[[*range(97, 123), *range(65, 91), *range(128, 256)]] = LETTER
KIND[list(range(48, 58))] = DIGIT
KIND[[ord(c) for c in ".!?\n:"]] = STOP
SPAN = 1 << 14
POWER = np.cumprod(np.full(SPAN, 0x9E3779B97F4A7C15, U64))
BYTE = mix(np.arange(256, dtype=U64))
NUMBER, NAME, UNIT = 1, 2, 3
MARKS = mix(np.array([11, 12, 13, 14], U64))


def word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(mix(np.array([np.add.reduce(BYTE[raw] * POWER[: len(raw)])], U64) + U64(len(raw)))[0])


NUMBER_HASHES = np.sort(np.array([word_hash(w) for w in NUMBER_WORDS], U64))
UNIT_HASHES = np.sort(np.array([word_hash(w) for w in UNITS], U64))


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _lowered(text: str) -> tuple[bytes, bytes]:
    """UTF-8 of the text and of its lower case, of equal length."""
    raw, low = text.encode("utf-8", "surrogatepass"), text.lower().encode("utf-8", "surrogatepass")
    if len(raw) != len(low):
        parts = [c.lower() if len(c.lower().encode("utf-8", "surrogatepass")) == len(c.encode("utf-8", "surrogatepass")) else c for c in text]
        low = "".join(parts).encode("utf-8", "surrogatepass")
    return raw, low


def templates(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, token, kind, value) of all template tokens of the texts in order.

    ``token`` is the hash of the word, or of its placeholder; ``kind`` is 0 for a literal, else NUMBER, NAME or UNIT;
    ``value`` is the hash of what stood there.  A number is a run of digits with inner points and commas, or a
    number word; a unit is a known unit right after a number; a name is a word with a capital letter, not all capitals,
    that does not begin a sentence.  Neighbouring names are one name.
    """
    owner, value, slot, _ = words(texts)
    stream = template(owner, value, slot)
    return stream.owner, stream.token, stream.slot, stream.value


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, value, slot, opening) of all words and numbers; ``opening``: a name but for beginning a sentence."""
    pairs = [_lowered(t) for t in texts]
    raw = np.frombuffer(b"\n".join(a for a, _ in pairs) + b"\n", np.uint8)
    low = np.frombuffer(b"\n".join(b for _, b in pairs) + b"\n", np.uint8)
    ends = np.cumsum([len(a) + 1 for a, _ in pairs])
    kind = KIND[low]
    # marks outside ASCII: U+0080-00BF, U+2000-206F and U+3000-303F separate words
    for lead, second, width in ((0xC2, range(0x80, 0xC0), 2), (0xE2, (0x80, 0x81), 3), (0xE3, (0x80,), 3)):
        at = np.flatnonzero(low[:-width] == lead) if len(low) > width else np.empty(0, int)
        at = at[np.isin(low[at + 1], list(second))]
        for k in range(width):
            kind[at + k] = OTHER
    inner = np.flatnonzero(((low == 46) | (low == 44)) & np.concatenate(([False], kind[:-1] == DIGIT)) & np.concatenate((kind[1:] == DIGIT, [False])))
    kind[inner] = DIGIT
    begin = np.concatenate(([True], kind[1:] != kind[:-1])) & (kind <= DIGIT)
    at = np.flatnonzero(kind <= DIGIT)
    if not len(at):
        none = np.empty(0, U64)
        return np.empty(0, np.int64), none, np.empty(0, np.uint8), np.empty(0, bool)
    heads = np.flatnonzero(begin[at])
    starts = at[heads]
    sizes = np.diff(np.concatenate((heads, [len(at)])))
    place = np.arange(len(at)) - np.repeat(heads, sizes)
    value = mix(np.add.reduceat(BYTE[low[at]] * POWER[place % SPAN], heads) + sizes.astype(U64))
    owner = np.searchsorted(ends, starts, "right")
    digits = kind[starts] == DIGIT
    number = digits | _member(value, NUMBER_HASHES)
    after = np.concatenate(([False], number[:-1])) & np.concatenate(([False], owner[1:] == owner[:-1]))
    unit = ~number & after & _member(value, UNIT_HASHES)
    # a capital letter differs from its lower case in one of its first two bytes
    changed = raw != low
    capital = changed[starts] | (changed[np.minimum(starts + 1, len(low) - 1)] & (low[starts] >= 0xC3))
    capitals = np.add.reduceat(changed[at].astype(np.int64), heads)
    stops = np.concatenate(([0], np.cumsum(kind == STOP)))
    last = np.concatenate(([0], starts[:-1] + sizes[:-1]))
    opens = (stops[starts] - stops[last] > 0) | np.concatenate(([True], owner[1:] != owner[:-1]))
    named = capital & (capitals == 1) & ~number & ~unit & (sizes > 1)
    slot = np.where(number, NUMBER, np.where(unit, UNIT, np.where(named & ~opens, NAME, 0))).astype(np.uint8)
    return owner, value, slot, named & opens


class Stream(NamedTuple):
    """Tokens of texts in order: ``begin`` and ``end`` count words, ``opening`` marks names that open a sentence."""

    owner: np.ndarray
    token: np.ndarray
    slot: np.ndarray
    value: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    opening: np.ndarray


def template(owner: np.ndarray, value: np.ndarray, slot: np.ndarray, opening: np.ndarray | None = None) -> Stream:
    """The template tokens; with ``opening``, these words are names too."""
    count = len(owner)
    marks = np.zeros(count, bool) if opening is None else opening
    slot = np.where(marks, NAME, slot).astype(np.uint8)
    begin = np.arange(count)
    # neighbouring names are one
    again = np.concatenate(([False], (slot[1:] == NAME) & (slot[:-1] == NAME) & (owner[1:] == owner[:-1]) & ~marks[1:])) if count else marks
    if again.any():
        begin = np.flatnonzero(~again)
        value = np.add.reduceat(value, begin)
        owner, slot, marks = owner[begin], slot[begin], marks[begin]
    token = np.where(slot == 0, value, MARKS[slot])
    return Stream(owner, token, slot, value, begin, np.concatenate((begin[1:], [count])), marks)


TEMPLATE, OPENING, EXACT = 0, 1, 2


def streams(texts: list[str]) -> tuple[list[Stream], np.ndarray]:
    """The template, the template with opening names, and the words themselves; and the first word of every text."""
    owner, value, slot, opening = words(texts)
    place = np.arange(len(owner))
    exact = Stream(owner, value, np.zeros(len(owner), np.uint8), value, place, place + 1, np.zeros(len(owner), bool))
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [template(owner, value, slot), template(owner, value, slot, opening), exact], first


def windows(stream: Stream, kind: int, size: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of every run of ``size`` tokens inside one text with at least ``literals`` literals.

    Names that open a sentence count as literals, but for one literal at most.  Exact windows need no literals.
    """
    n = len(stream.token) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, U64)
    total = np.zeros(n, U64)
    for k in range(size):
        total += stream.token[k : k + n] * (mix(np.array([k + 1], U64))[0] | U64(1))
    fits = stream.owner[:n] == stream.owner[size - 1 :]
    if kind != EXACT:
        plain = np.concatenate(([0], np.cumsum(stream.slot == 0)))
        plain = plain[size:] - plain[:-size]
        opening = np.concatenate(([0], np.cumsum(stream.opening)))
        fits &= plain + np.minimum(opening[size:] - opening[:-size], 1) >= literals
    at = np.flatnonzero(fits)
    hashes = mix(total[at] + U64(size))
    return at, mix(hashes) if kind == EXACT else hashes


# -- Spark --

ITEM_WINDOWS = (
    "item_id long, item_tokens int, stream tinyint, item_pos int, low int, high int, size int, window long, "
    "places array<int>, kinds array<tinyint>, slots array<long>"
)
ITEM_SCHEMA = pa.schema(
    [
        ("item_id", pa.int64()),
        ("item_tokens", pa.int32()),
        ("stream", pa.int8()),
        ("item_pos", pa.int32()),
        ("low", pa.int32()),
        ("high", pa.int32()),
        ("size", pa.int32()),
        ("window", pa.int64()),
        ("places", pa.list_(pa.int32())),
        ("kinds", pa.list_(pa.int8())),
        ("slots", pa.list_(pa.int64())),
    ]
)


def item_windows(benchmark: DataFrame, size: int, literals: int) -> DataFrame:
    """Windows of every benchmark item in its three streams; an item of fewer tokens than a window is one window of
    its own length.  Words ``low`` to ``high`` lie under a window.  Null and empty items have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            items = batch.column("item_id").to_pylist()
            kinds, first = streams(texts)
            rows = []
            for kind, stream in enumerate(kinds):
                tokens = np.bincount(stream.owner, minlength=len(texts))
                starts = np.concatenate(([0], np.cumsum(tokens)))
                for length in sorted({min(size, int(n)) for n in tokens if n}):
                    at, hashes = windows(stream, kind, length, literals)
                    for i, h in zip(at.tolist(), hashes.view(np.int64).tolist(), strict=True):
                        d = int(stream.owner[i])
                        if length != min(size, tokens[d]):
                            continue
                        filled = np.flatnonzero(stream.slot[i : i + length]) + i
                        rows.append({
                            "item_id": items[d], "item_tokens": int(first[d + 1] - first[d]), "stream": kind, "item_pos": i - int(starts[d]),
                            "low": int(stream.begin[i] - first[d]), "high": int(stream.end[i + length - 1] - first[d]), "size": length, "window": h,
                            "places": (filled - starts[d]).tolist(), "kinds": stream.slot[filled].tolist(), "slots": stream.value[filled].view(np.int64).tolist(),
                        })
            yield pa.RecordBatch.from_pylist(rows, schema=ITEM_SCHEMA)

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, ITEM_WINDOWS)


FOUND = "doc_id long, doc_stream tinyint, doc_pos int, window long, doc_slots array<long>"
FOUND_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("doc_stream", pa.int8()), ("doc_pos", pa.int32()), ("window", pa.int64()), ("doc_slots", pa.list_(pa.int64()))]
)


def document_windows(docs: DataFrame, known: np.ndarray, lengths: dict[bool, list[int]], literals: int) -> DataFrame:
    """Windows of whole documents whose hash is one of the sorted ``known`` ones; ``lengths`` of exact and other windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 800_000):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = batch.column("doc_id").to_pylist()
            rows = []
            for kind, stream in enumerate(streams(texts)[0]):
                first = np.searchsorted(stream.owner, np.arange(len(texts)))
                for length in lengths[kind == EXACT]:
                    at, hashes = windows(stream, kind, length, literals)
                    met = _member(hashes, known)
                    for i, h in zip(at[met].tolist(), hashes[met].view(np.int64).tolist(), strict=True):
                        d = int(stream.owner[i])
                        filled = np.flatnonzero(stream.slot[i : i + length]) + i
                        rows.append({"doc_id": ids[d], "doc_stream": kind, "doc_pos": i - int(first[d]), "window": h, "doc_slots": stream.value[filled].view(np.int64).tolist()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=FOUND_SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)


def agreement(filled: list[tuple[int, int, int, int]]) -> tuple[int, int, int, int, int]:
    """(places, equal, off, slots, changed) of the slots (place, kind, theirs, ours) of an alignment.

    A place is equal if it holds the benchmark's value, and off if it holds another value than the one that stands for
    the benchmark's value most often.  ``slots`` and ``changed`` count different pairs of values.
    """
    places = {f[0]: tuple(f[1:]) for f in filled}
    pairs = Counter(places.values())
    most: dict[tuple[int, int], int] = {}
    for (kind, theirs, ours), n in pairs.items():
        most[kind, theirs] = max(most.get((kind, theirs), 0), n)
    equal = sum(n for (_, theirs, ours), n in pairs.items() if theirs == ours)
    return len(places), equal, len(places) - sum(most.values()), len(pairs), sum(theirs != ours for _, theirs, ours in pairs)


def consistent(places: int, equal: int, off: int, share: float) -> bool:
    """Whether half of the places hold the benchmark's own values, or ``share`` of the others are filled by one rule."""
    return 2 * equal >= places or places - equal - off >= share * (places - equal)


JUDGED = "doc_id long, item_id long, stream int, item_tokens int, spans array<struct<low:int,high:int>>, windows long, slots long, changed long"


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 8,
    literals: int = 5,
    coverage: float = 0.5,
    block: int = 2_000_000,
    share: float = 0.8,
) -> DataFrame:
    """(doc_id, item_id, coverage, windows, slots, changed, kind) of every document that holds a benchmark item.

    A pair is reported when exact windows and consistent alignments cover ``coverage`` of the words of the item.
    An alignment is consistent when half of its slots hold the benchmark's own values, or when in ``share`` of the others one
    benchmark value stands for one value.  ``kind`` is ``copy`` if the whole item is there word for word or every slot holds
    the benchmark's own value, else ``reparameterised``; ``changed`` counts the other values.

    Documents are compared with at most ``block`` window hashes at once (8 bytes each, so the size of what is
    sent to the tasks is bounded); a larger benchmark goes in several blocks, each against all documents.  Only
    matching windows are shuffled.  Null and empty texts hold nothing; rows that repeat a doc_id count as one
    document; a null doc_id is an id of its own; columns besides id and text are not read.
    """
    spark = docs.sparkSession
    items = saved(item_windows(benchmark, size, literals).filter(F.col("item_id").isNotNull()), "items")
    sizes = items.select("stream", "size").distinct().collect()  # at most ``size`` values a stream
    lengths = {exact: sorted({r["size"] for r in sizes if (r["stream"] == EXACT) == exact}) for exact in (False, True)}
    blocks = items.select("window").distinct().count() // block + 1
    found = None
    for k in range(blocks if sizes else 0):
        part = items.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k).select("window").distinct()
        known = np.sort(np.array([r[0] for r in part.collect()], np.int64).view(U64))
        here = document_windows(docs, known, lengths, literals)
        found = here if found is None else found.unionByName(here)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    aligned = (
        found.distinct()
        .join(items, "window")
        .select("doc_id", "item_id", (F.col("doc_stream") * 3 + F.col("stream")).cast("int").alias("stream"),
                (F.col("doc_pos") - F.col("item_pos")).alias("shift"), "item_tokens", F.struct("low", "high").alias("span"),
                F.arrays_zip("places", "kinds", F.col("slots").alias("theirs"), F.col("doc_slots").alias("ours")).alias("filled"))
    )
    # an alignment has each place of the item once: its lists are bounded by the length of the item
    alignments = aligned.groupBy("doc_id", "item_id", "stream", "shift", "item_tokens").agg(
        F.collect_set("span").alias("spans"), F.array_distinct(F.flatten(F.collect_list("filled"))).alias("filled")
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts = [], []
            for k, filled in enumerate(batch.column("filled").to_pylist()):
                places, equal, off, slots, changed = agreement([(f["places"], f["kinds"], f["theirs"], f["ours"]) for f in filled])
                if consistent(places, equal, off, share):
                    kept.append(k)
                    counts.append((slots, changed))
            rows = batch.take(pa.array(kept, pa.int64()))
            spans = rows.column("spans")
            columns = [rows.column(c) for c in ("doc_id", "item_id", "stream", "item_tokens")] + [spans, pc.list_value_length(spans).cast(pa.int64())]
            columns += [pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "stream", "item_tokens", "spans", "windows", "slots", "changed"])

    judged = alignments.select("doc_id", "item_id", "stream", "item_tokens", "spans", "filled").mapInArrow(judge, JUDGED)
    # words of the item under its windows
    under = F.flatten(F.transform("spans", lambda p: F.sequence(p["low"], p["high"] - 1)))
    exact = F.col("stream") == EXACT * 3 + EXACT
    whole = F.size("words") == F.col("item_tokens")
    return (
        judged.groupBy("doc_id", "item_id", "item_tokens", "stream")
        .agg(
            F.array_distinct(F.flatten(F.collect_list(F.array_distinct(under)))).alias("words"),
            *[F.sum(c).alias(c) for c in ("windows", "slots", "changed")],
        )
        # the streams tell of the same words: the largest count of one is reported
        .groupBy("doc_id", "item_id", "item_tokens")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("words")))).alias("covered"),
            *[F.max(c).alias(c) for c in ("windows", "slots", "changed")],
            F.max(exact & whole).alias("copied"),
        )
        .withColumn("coverage", F.col("covered") / F.col("item_tokens"))
        .filter(F.col("coverage") >= coverage)
        .withColumn("changed", F.when(F.col("copied"), F.lit(0).cast("long")).otherwise(F.col("changed")))
        .select("doc_id", "item_id", "coverage", "windows", "slots", "changed",
                F.when(F.col("changed") == 0, "copy").otherwise("reparameterised").alias("kind"))
    )
