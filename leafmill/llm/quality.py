"""Operator 9: quality classifier by ordinal cumulative-link regression.

One vector of weights over hashed text features is shared by all grades; ordered thresholds cut its scale:
P(grade <= k) = sigmoid(threshold[k] - weights . x).  The model gives the expected grade and the probability
of reaching a grade, by which rows are selected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill.llm.common import U64, learning_rows, mix, saved, slices

WORDS = 1 << 14  # hashed words
SHAPES = 8**3  # trigrams of character classes
BINS = 10
MEASURES = 7
WIDTH = WORDS + SHAPES + MEASURES * BINS + 1

# --- fixed values: character classes of the shape features ---
LOWER, UPPER, DIGIT, BLANK, LINE, STOP, SIGN, HIGH = range(8)
CLASS = np.full(256, SIGN, np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = LOWER, UPPER, DIGIT, HIGH
CLASS[[9, 11, 12, 13, 32]], CLASS[10] = BLANK, LINE
CLASS[[ord(c) for c in ".,;:'\"?-()"]] = STOP

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
BYTE = mix(np.arange(256, dtype=U64))
SPAN = 1 << 14
POWER = np.cumprod(np.full(SPAN, 0x9E3779B97F4A7C15, U64))


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of the features of one text.

    Hashed distinct words (together of length 1), roots of the shares of character-class trigrams, and binned
    measures: length, distinct words, repeated words, capitals, signs, word length, high bytes.  The empty text has only the
    constant.
    """
    raw = np.frombuffer(text, np.uint8)
    kind = CLASS[raw]
    inside = (kind != BLANK) & (kind != LINE)
    letters = np.flatnonzero(inside)
    constant = np.array([WIDTH - 1]), np.array([1.0])
    if not len(letters):
        return constant
    first = np.concatenate(([0], np.flatnonzero(np.diff(letters) > 1) + 1))
    sizes = np.diff(np.concatenate((first, [len(letters)])))
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    words = mix(np.add.reduceat(BYTE[FOLD[raw[letters]]] * POWER[place % SPAN], first) + sizes.astype(U64))
    distinct, counts = np.unique(words, return_counts=True)
    slots = np.unique((distinct % U64(WORDS)).astype(np.int64))
    code = kind[:-2].astype(np.int64) * 64 + kind[1:-1].astype(np.int64) * 8 + kind[2:]
    shapes = np.bincount(code, minlength=SHAPES)
    met = np.flatnonzero(shapes)
    share = np.bincount(kind, minlength=8) / len(raw)
    measures = np.array(
        [
            np.log1p(len(words)) / 10,
            len(distinct) / len(words),
            counts[counts > 1].sum() / len(words),
            min(1.0, 2 * share[UPPER]),
            min(1.0, 4 * share[SIGN]),
            min(1.0, sizes.mean() / 20),
            float((words[1:] == words[:-1]).mean()) if len(words) > 1 else 0.0,
        ]
    )
    bins = WORDS + SHAPES + np.arange(MEASURES) * BINS + np.minimum((measures * BINS).astype(np.int64), BINS - 1)
    index = np.concatenate((slots, WORDS + met, bins, constant[0]))
    value = np.concatenate((np.full(len(slots), len(slots) ** -0.5), np.sqrt(shapes[met] / max(1, len(code))), np.ones(MEASURES + 1)))
    return index, value


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Ordinal:
    """Weights, ordered thresholds, and the grades that they part."""

    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k]) for k = 1 and up, a row for each value of the scale."""
        return _sigmoid(x[:, None] - self.thresholds[None, :])

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(np.array(self.grades, float))

    def scale(self, text: bytes) -> float:
        index, value = features(text)
        return float(self.weights[index] @ value)


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, decay: float = 1e-4, steps: int = 250) -> Ordinal:
    """Maximum likelihood with L2, by Adam on all rows.  Thresholds are a first one and positive steps, so they stay
    ordered.  One grade alone gives a model that always answers it."""
    grades = sorted({int(g) for g in grade})
    weights = np.zeros(WIDTH)
    if len(grades) < 2:
        return Ordinal(grades or [0], weights, np.empty(0))
    y = np.searchsorted(grades, grade)
    cuts = len(grades) - 1
    index = np.concatenate([i for i, _ in rows])
    value = np.concatenate([v for _, v in rows])
    owner = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    free = np.concatenate((weights, [-1.0], np.zeros(cuts - 1)))  # weights, first threshold, log steps
    mean, var = np.zeros(len(free)), np.zeros(len(free))
    n = np.arange(len(rows))
    for t in range(1, steps + 1):
        thresholds = free[WIDTH] + np.concatenate(([0.0], np.cumsum(np.exp(free[WIDTH + 1 :]))))
        x = np.bincount(owner, free[index] * value, len(rows))
        below = np.column_stack((np.zeros(len(rows)), _sigmoid(thresholds[None, :] - x[:, None]), np.ones(len(rows))))
        high, low = below[n, y + 1], below[n, y]
        p = np.maximum(high - low, 1e-12)
        slope_high, slope_low = high * (1 - high) / p, low * (1 - low) / p
        # d(-log p)/dx, and the same for the thresholds on both sides of the grade
        g_x = (slope_high - slope_low) / len(rows)
        g_t = np.bincount(y, -slope_high, cuts + 1)[:cuts] + np.bincount(y, slope_low, cuts + 1)[1:]
        g_t /= len(rows)
        later = np.cumsum(g_t[::-1])[::-1]
        slope = np.concatenate(
            (
                np.bincount(index, g_x[owner] * value, WIDTH) + decay * free[:WIDTH],
                [later[0]],
                later[1:] * np.exp(free[WIDTH + 1 :]),
            )
        )
        mean, var = 0.9 * mean + 0.1 * slope, 0.999 * var + 0.001 * slope**2
        free -= 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.999**t)) + 1e-8)
    thresholds = free[WIDTH] + np.concatenate(([0.0], np.cumsum(np.exp(free[WIDTH + 1 :]))))
    return Ordinal(grades, free[:WIDTH], thresholds)


def learn_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = 5_000) -> Ordinal:
    """The model of the graded column ``label``, from at most ``limit`` labelled rows that are not held out.

    What comes to the driver is bounded by ``limit``.  Without labels every row gets grade 0.
    """
    rows = saved(learning_rows(docs, labels, label, limit).distinct(), "graded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            made = [features(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "label": batch.column("label"),
                    "i": [i.astype(np.uint16).tobytes() for i, _ in made],
                    "v": [v.astype(np.float32).tobytes() for _, v in made],
                }
            )

    sample = rows.mapInArrow(run, "label int, i binary, v binary").collect()
    pairs = [(np.frombuffer(r.i, np.uint16).astype(np.int64), np.frombuffer(r.v, np.float32).astype(float)) for r in sample]
    return fit_ordinal(pairs, np.array([r.label for r in sample], np.int64))


def score_quality(docs: DataFrame, model: Ordinal, grade: int | None = None, least: float = 0.5) -> DataFrame:
    """The rows with ``expected_grade``, ``tail_probability`` (of at least ``grade``, by default the middle one) and ``keep``
    (tail_probability >= ``least``) of their whole text.

    A null text is scored as the empty one, which has the constant feature alone.  No shuffle; repeated rows score alike;
    other columns pass through; an input column of one of the three names is an error.
    """
    from pyspark.sql import types as T

    names = ["expected_grade", "tail_probability", "keep"]
    for name in names:
        if name in docs.columns:
            raise ValueError(f"column {name} exists")
    kinds = [T.DoubleType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, k, False) for n, k in zip(names, kinds, strict=True)]])
    cut = len(model.grades) // 2 if grade is None else int(np.searchsorted(model.grades, grade))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            tails = model.tails(np.array([model.scale(t or b"") for t in texts]))
            tail = tails[:, cut - 1] if 0 < cut <= tails.shape[1] else np.full(len(texts), float(cut == 0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(model.expected(tails)), pa.array(tail), pa.array(tail >= least)], names=schema.names
            )

    return docs.mapInArrow(run, schema)
