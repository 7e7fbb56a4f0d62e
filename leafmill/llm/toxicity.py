"""Operator 7: toxicity by a weighted finite-state pattern grammar.

Small transducers read the word classes of a clause: insults (weighted), threats, targets, negation and reported
speech.  They are composed into one automaton; its weight for a clause is the score of the clause, so an
insult that is aimed at somebody counts more, a negated or a reported one less.  The weights of the insult arcs
are learned from labelled documents; a document's score is a logistic curve over the sum of its clauses.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import learning_rows, saved, slices, texts_of

# --- fixed values: word lists of the grammar (English, German, French, Spanish) ---
INSULTS = (
    "idiot idiots moron morons loser losers scum trash stupid pathetic worthless disgusting clown imbecile fool bastard "
    "dumbass idioten dummkopf trottel abschaum crétin imbécile ordure connard abruti estúpido imbécil basura escoria"
).split()
VIOLENCE = (
    "kill hurt destroy beat stab shoot murder töten umbringen verletzen tuer frapper détruire matar golpear destruir"
).split()
INTENT = "will shall gonna going werde werden wirst vais va allons voy va vamos".split()
TARGETS = (
    "you your yours u ur they them those these people he she him her du dich dir ihr euch sie tu toi vous te ils elles "
    "tú usted ustedes ellos ellas vosotros"
).split()
NEGATIONS = (
    "not no never isn't aren't wasn't don't doesn't nobody neither nor nicht kein keine niemals nie ne pas jamais aucun "
    "nunca jamás ningún tampoco"
).split()
REPORTS = (
    "said says say called calls quoted quote wrote claimed reported according sagte sagt schrieb nannte dit disait "
    "écrit appelé dijo dice escribió llamó"
).split()

PLAIN, INSULT, THREAT, INTEND, TARGET, NEGATION, REPORT = range(7)
CLASSES = range(7)
PREFIXES = range(3, 7)
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
CLAUSE_END = re.compile(r"[.!?;:\n]")


class Transducer:
    """Deterministic transducer over word classes: (state, class) gives a state and a factor on the word's weight."""

    def __init__(self, states: int, step):
        self.states = states
        self.table = [[step(s, c) for c in CLASSES] for s in range(states)]

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same classes; factors are multiplied."""
        out = Transducer.__new__(Transducer)
        out.states = self.states * other.states
        out.table = [
            [
                (self.table[a][c][0] * other.states + other.table[b][c][0], self.table[a][c][1] * other.table[b][c][1])
                for c in CLASSES
            ]
            for a, b in product(range(self.states), range(other.states))
        ]
        return out

    def weigh(self, classes: list[int], weights: list[float]) -> float:
        """Sum of the weights on the path of one clause."""
        state, total = 0, 0.0
        for c, w in zip(classes, weights, strict=True):
            state, factor = self.table[state][c]
            total += factor * w
        return total


def grammar() -> Transducer:
    """The composed automaton of a clause."""
    insult = Transducer(1, lambda s, c: (0, 1.0 if c in (INSULT, THREAT) else 0.0))
    # violence counts in full for four words after an intention, else little
    threat = Transducer(5, lambda s, c: (4 if c == INTEND else max(0, s - 1), (1.0 if s else 0.2) if c == THREAT else 1.0))
    target = Transducer(2, lambda s, c: (1 if c == TARGET else s, 1.25 if s else 1.0))
    negation = Transducer(4, lambda s, c: (3 if c == NEGATION else max(0, s - 1), 0.5 if s else 1.0))
    report = Transducer(2, lambda s, c: (1 if c == REPORT else s, 0.7 if s else 1.0))
    out = insult
    for part in (threat, target, negation, report):
        out = out.compose(part)
    return out


def arcs_of(word: str) -> list[str]:
    """Arcs that a word can match: itself, and its beginnings (ending in '*')."""
    return [word, *(word[:n] + "*" for n in PREFIXES if n < len(word))]


class Scorer:
    """Lexicon and grammar; a plain object that goes to the tasks."""

    def __init__(self, arcs: dict[str, float], offset: float = -3.0, slope: float = 3.0):
        self.arcs, self.offset, self.slope = arcs, offset, slope

    def __getstate__(self):
        return self.arcs, self.offset, self.slope

    def __setstate__(self, state):
        self.arcs, self.offset, self.slope = state

    def _ready(self) -> None:
        if hasattr(self, "grammar"):
            return
        self.grammar = grammar()
        self.classes = {w: c for c, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (INTEND, INTENT)) for w in words}
        self.violence = set(VIOLENCE)
        self.finder = ahocorasick.Automaton()
        for arc in self.arcs:
            self.finder.add_word(arc.rstrip("*"), len(arc.rstrip("*")))
        for w in VIOLENCE:
            self.finder.add_word(w, len(w))
        self.finder.make_automaton()

    def insult(self, word: str) -> float:
        """Weight of the heaviest arc that accepts the word."""
        return max((self.arcs.get(a, 0.0) for a in arcs_of(word)), default=0.0)

    def clauses(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of every clause that holds an insult or a threat."""
        self._ready()
        low = text.lower()
        out, done = [], -1
        for end, size in self.finder.iter(low):
            start = end - size + 1
            if start < done or (start and low[start - 1].isalnum()):
                continue
            # the last clause ended at a mark, so nothing before it is searched again
            begin = max(low.rfind(mark, max(done, 0), start) for mark in ".!?;:\n") + 1
            stop = CLAUSE_END.search(low, end + 1)
            done = stop.start() if stop else len(low)
            classes, weights = [], []
            for m in WORD.finditer(low, begin, done):
                word = m[0].replace("’", "'")
                weight = self.insult(word)
                if weight > 0:
                    classes.append(INSULT)
                elif word in self.violence:
                    classes.append(THREAT)
                    weight = 1.0
                else:
                    classes.append(self.classes.get(word, PLAIN))
                weights.append(weight)
            weight = self.grammar.weigh(classes, weights)
            if weight > 0:
                out.append((begin, done, weight))
        return out

    def strength(self, text: str) -> float:
        """log(1 + sum of the clause weights)."""
        return math.log1p(sum(w for _, _, w in self.clauses(text)))

    def score(self, strength: float) -> float:
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, self.offset + self.slope * strength))))


# -- learning --


def _features(text: str) -> set[str]:
    return {a for w in set(WORD.findall(text.lower())) for a in arcs_of(w.replace("’", "'"))}


def _logistic(rows: list[np.ndarray], y: np.ndarray, width: int, decay: float, steps: int) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on 0/1 features, by Adam on all rows."""
    index = np.concatenate(rows) if rows else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    weights, bias = np.zeros(width), 0.0
    mean, var, mean_b, var_b = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, steps + 1):
        z = bias + np.bincount(owner, weights[index], len(rows))
        error = 1 / (1 + np.exp(-z)) - y
        slope = np.bincount(index, error[owner], width) / len(rows) + decay * weights
        slope_b = error.mean()
        mean, var = 0.9 * mean + 0.1 * slope, 0.999 * var + 0.001 * slope**2
        mean_b, var_b = 0.9 * mean_b + 0.1 * slope_b, 0.999 * var_b + 0.001 * slope_b**2
        fix1, fix2 = 1 - 0.9**t, 1 - 0.999**t
        weights -= 0.05 * (mean / fix1) / (np.sqrt(var / fix2) + 1e-8)
        bias -= 0.05 * (mean_b / fix1) / (math.sqrt(var_b / fix2) + 1e-8)
    return weights, bias


def _calibrated(strength: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Offset and slope of the logistic curve, by Newton steps with a small ridge; the slope is never negative."""
    x = np.column_stack((np.ones(len(y)), strength))
    beta = np.array([-2.0, 2.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        ridge = np.diag([1e-2, 1e-2])
        beta -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ beta)
    return float(beta[0]), max(0.0, float(beta[1]))


def learn_scorer(
    docs: DataFrame, labels: DataFrame, limit: int = 10_000, support: int = 5, width: int = 8_000, decay: float = 2e-4
) -> Scorer:
    """Insult arcs and the curve of the score, from at most ``limit`` labelled rows that are not held out.

    Candidate arcs are words and word beginnings of at least ``support`` different toxic texts and hardly any other,
    the ``width`` most frequent of them; a regression shares the weight out among them, so that words which only
    come along get little.  The general list of insults keeps a weight of its own.  Without labels of both kinds the
    list and a fixed curve remain.
    """
    general = {w: 1.0 for w in INSULTS}
    rows = saved(learning_rows(docs, labels, "toxic", limit).filter(F.col("text").isNotNull()).distinct(), "labelled")
    kinds = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if not kinds.get(0) or not kinds.get(1):
        return Scorer(general)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            seen = {0: Counter(), 1: Counter()}
            for text, label in zip(texts_of(batch), batch.column("label").to_pylist(), strict=True):
                seen[int(label > 0)].update(_features(text))
            arcs = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_pydict({"arc": arcs, "bad": [seen[1][a] for a in arcs], "good": [seen[0][a] for a in arcs]})

    counted = rows.mapInArrow(count, "arc string, bad long, good long").groupBy("arc").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    picked = (
        counted.filter((F.col("bad") >= support) & (F.col("good") * 20 <= F.col("bad")))
        .orderBy(F.col("bad").desc(), "arc")
        .limit(width)
        .collect()
    )
    number = {row.arc: i for i, row in enumerate(picked)}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            met = [[number[a] for a in _features(t) if a in number] for t in texts_of(batch)]
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "met": pa.array(met, pa.list_(pa.int32()))})

    # bounded by ``limit`` rows
    sample = rows.mapInArrow(meet, "label int, met array<int>").collect()
    y = np.array([float(r.label > 0) for r in sample])
    weights, _ = _logistic([np.array(r.met, np.int64) for r in sample], y, max(1, len(number)), decay, 300)
    top = max(1e-9, float(weights.max()))
    learned = {a: float(weights[i] / top) for a, i in number.items() if weights[i] >= 0.1 * top}
    scorer = Scorer(general | learned)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "x": [scorer.strength(t) for t in texts_of(batch)]})

    curve = rows.mapInArrow(strengths, "label int, x double").collect()
    scorer.offset, scorer.slope = _calibrated(np.array([r.x for r in curve]), np.array([float(r.label > 0) for r in curve]))
    return scorer


def score_toxicity(docs: DataFrame, scorer: Scorer, into: str = "score", matched: str | None = None) -> DataFrame:
    """The rows with the score of their whole text as a column ``into``, and the number of matched clauses as ``matched``
    if that is named.  Null and empty texts have no clause and get the score of a text without one.  No shuffle;
    repeated rows score alike; other columns pass through."""
    from pyspark.sql import types as T

    for name in (into, matched):
        if name in docs.columns:
            raise ValueError(f"column {name} exists")
    extra = [T.StructField(into, T.DoubleType(), False)] + ([T.StructField(matched, T.LongType(), False)] if matched else [])
    schema = T.StructType([*docs.schema.fields, *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [scorer.clauses(t) for t in texts_of(batch)]
            scores = pa.array([scorer.score(math.log1p(sum(w for _, _, w in c))) for c in found], pa.float64())
            more = [pa.array([len(c) for c in found], pa.int64())] if matched else []
            yield pa.RecordBatch.from_arrays([*batch.columns, scores, *more], names=schema.names)

    return docs.mapInArrow(run, schema)
