"""Operator 11: language identification by rank-order profiles.

A profile is the list of the most frequent n-grams of a language.  A document gets such a list of its own; the out-of-place
distance sums how far each of its n-grams stands from its place in the profile, and the nearest profile wins.  N-grams
have one to five characters, stay inside words and mark both word ends, as Cavnar and Trenkle count them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import MIX_1, MIX_2, U64, held_out, slices, texts_of

SIZES = (1, 2, 3, 4, 5)
#: N-grams of a profile, and of a document, that are ranked; also the distance of one that a profile lacks.
RANKS = 300
#: Bound of the model: so many languages at most, those with the most documents to learn from.
LANGUAGES = 1000
UNKNOWN = "und"
#: N-grams are hashed to so many bits; the bits above hold the number of their text.
BITS = 48
STEP = 1_000_000
HELD = 2_000_000


@cache
def word_characters() -> np.ndarray:
    """Whether a code point is a letter or a mark on one."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased words of all texts with one 0 before, between and after them, and the number of the
    text that each belongs to."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(" ".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    numbers = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in lowered])
    numbers = np.concatenate((numbers[:1] * 0 if len(numbers) else np.zeros(1, np.int32), numbers))
    inside = word_characters()[codes]
    kept = inside.copy()
    kept[:-1] |= inside[1:]  # the gap before a word; the one after the last word ends the last text
    kept[-1] = True
    return np.where(inside, codes, 0)[kept], numbers[kept]


def gram_counts(codes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (number of the text, hash of the n-gram) and how often each occurs; ``STEP`` places at a time.

    The hash of an n-gram goes on from that of its beginning, so each size costs one step.
    """
    found = []
    gap = codes == 0
    wide = codes.astype(U64)
    # an n-gram that begins with a gap belongs to the text of its first letter
    owner = np.where(gap[:-1], numbers[1:], numbers[:-1]).astype(U64) << U64(BITS)
    for start in range(0, len(codes) - 1, STEP):
        at = np.arange(start, min(start + STEP, len(codes) - 1), dtype=np.int32)
        value = np.ones(len(at), U64)
        keys = []
        for size in SIZES:
            here = at + np.int32(size - 1)
            inside = here < len(codes)
            if not inside.all():
                at, value, here = at[inside], value[inside], here[inside]
            value = blended(value, wide[here])
            if size == 1:
                keep = ~gap[at]
                keys.append(owner[at[keep]] | (value[keep] >> U64(64 - BITS)))
                continue
            keys.append(owner[at] | (value >> U64(64 - BITS)))
            on = ~gap[here]  # what goes on has no gap inside
            at, value = at[on], value[on]
        found.append(np.unique(np.concatenate(keys), return_counts=True))
    return merged(found)


def blended(value: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The hash of an n-gram and one more character; the upper bits are the best ones."""
    value = (value ^ code) * MIX_1
    value ^= value >> U64(32)
    value *= MIX_2
    return value


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all parts, sorted, with the sums of their counts."""
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([c for _, c in parts])).astype(np.int64)


def ranks(keys: np.ndarray, counts: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, rank) of the ``kept`` most frequent n-grams of each text, equal counts by hash; ranks from 0."""
    text = (keys >> U64(BITS)).astype(np.int64)
    order = np.lexsort((-counts, text))  # stable: equal counts stay in the order of their hashes
    text, keys = text[order], keys[order]
    starts = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1]))) if len(text) else np.zeros(0, np.int64)
    rank = np.arange(len(text)) - np.repeat(starts, np.diff(np.append(starts, len(text))))
    top = rank < kept
    return text[top], (keys[top] & U64((1 << BITS) - 1)).astype(np.int64), rank[top]


@dataclass
class Profiles:
    """Ranked n-grams of the languages: ``grams`` sorted, with language and rank of each entry."""

    languages: list[str]
    grams: np.ndarray
    language: np.ndarray
    rank: np.ndarray
    kept: int = RANKS

    def nearness(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text and language 1 less the out-of-place distance as a share of the largest one; and the number of
        ranked n-grams of each text."""
        text, grams, rank = ranks(*gram_counts(*words_of(texts)), self.kept)
        total = np.bincount(text, minlength=len(texts))
        low, high = np.searchsorted(self.grams, grams, "left"), np.searchsorted(self.grams, grams, "right")
        width = high - low
        entry = np.repeat(low - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(width.sum())
        gain = self.kept - np.abs(np.repeat(rank, width) - self.rank[entry])
        n = len(self.languages)
        near = np.bincount(np.repeat(text, width) * n + self.language[entry], gain, len(texts) * n).reshape(len(texts), n)
        return near / np.maximum(total * self.kept, 1)[:, None], total

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the share of the nearest profile in the nearness of the two nearest.

        Equal distances go to the language that comes first, that is, the one with more documents to learn from.  A text
        without a letter is ``und`` with score 0, and so is every text if no language was learned.
        """
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        near, _ = self.nearness(texts)
        best = np.argmax(near, 1)
        ordered = np.sort(near, 1)
        first, second = ordered[:, -1], ordered[:, -2] if near.shape[1] > 1 else np.zeros(len(texts))
        score = np.divide(first, first + second, out=np.zeros(len(texts)), where=first > 0)
        spoken = np.array([any(map(str.isalpha, t)) for t in texts], bool)
        names = [self.languages[k] if s else UNKNOWN for k, s in zip(best, spoken, strict=True)]
        return names, np.where(spoken, score, 0.0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a task: counts are summed over its batches and given out when ``HELD`` are held."""
    names: dict[str, int] = {}
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        keys, counts = merged(parts)
        lang = pa.DictionaryArray.from_arrays(pa.array((keys >> U64(BITS)).astype(np.int32)), pa.array(list(names), pa.string()))
        grams = (keys & U64((1 << BITS) - 1)).astype(np.int64)
        return pa.RecordBatch.from_arrays([lang.cast(pa.string()), pa.array(grams), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])

    for batch in slices(batches, "text", STEP):
        langs = [names.setdefault(name, len(names)) for name in batch.column("lang").to_pylist()]
        codes, numbers = words_of(texts_of(batch))
        parts.append(gram_counts(codes, np.array(langs, np.int64)[numbers]))
        if sum(len(k) for k, _ in parts) > 2 * HELD:
            parts = [merged(parts)]
        if len(parts[0][0]) > HELD or len(names) > 50_000:
            yield out()
            parts = []
            names.clear()
    if parts:
        yield out()


def learn_profiles(docs: DataFrame, kept: int = RANKS, languages: int = LANGUAGES) -> Profiles:
    """Profiles of the languages in ``docs``, from every document with a language that is not held out.

    Held-out documents and those without id or language are never read.  All others count, whole; their n-grams are summed in
    each task and then by language.  The profiles come to the driver: ``languages`` times ``kept`` rows at most.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("lang", "text")
    frequent = rows.groupBy("lang").agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "lang").limit(languages)
    names = [row.lang for row in frequent.collect()]
    spark = docs.sparkSession
    # at most ``languages`` rows, so the broadcast is bounded
    known = spark.createDataFrame([(n,) for n in names], "lang string")
    counts = rows.join(F.broadcast(known), "lang").mapInArrow(_counted, "lang string, gram long, n long")
    totals = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = totals.withColumn("rank", place - 1).filter(F.col("rank") < kept).select("lang", "gram", "rank").toArrow()
    grams = top["gram"].to_numpy()
    place_of = {name: i for i, name in enumerate(names)}
    language = np.array([place_of[x] for x in top["lang"].to_pylist()], np.int64)
    order = np.lexsort((language, grams))
    return Profiles(names, grams[order], language[order], top["rank"].to_numpy().astype(np.int64)[order], kept)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``, from its whole text alone.

    A null text or one without a letter is ``und`` with score 0; a text whose n-grams no profile has gets the language with
    the most documents and score 0.  Repeated rows are answered each; other columns are left out.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", STEP):
            names, score = shipped.value.predict(texts_of(batch))
            ids = pc.cast(batch.column("doc_id"), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
