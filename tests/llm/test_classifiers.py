"""Toxicity, quality and the pipeline."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm import queries as Q
from leafmill.llm.common import held_out, learning_rows
from leafmill.llm.quality import features, fit_ordinal, learn_quality, score_quality
from leafmill.llm.toxicity import CLASSES, INSULT, NEGATION, PLAIN, REPORT, TARGET, Scorer, grammar, learn_scorer, score_toxicity

SF = "/root/testdata/sf0.01"

# -- operator 7 --


def test_composed_automaton_equals_the_parts():
    rng = random.Random(3)
    whole = grammar()
    for _ in range(50):
        classes = [rng.choice(list(CLASSES)) for _ in range(12)]
        total, threat, negated, target, report = 0.0, 0, 0, False, False
        for c in classes:
            factor = 1.0 if c in (1, 2) else 0.0
            factor *= (1.0 if threat else 0.2) if c == 2 else 1.0
            factor *= (1.25 if target else 1.0) * (0.5 if negated else 1.0) * (0.7 if report else 1.0)
            total += factor
            threat = 4 if c == 3 else max(0, threat - 1)
            negated = 3 if c == NEGATION else max(0, negated - 1)
            target, report = target or c == TARGET, report or c == REPORT
        assert math.isclose(whole.weigh(classes, [1.0] * 12), total)
    assert whole.weigh([TARGET, INSULT], [0, 1]) > whole.weigh([PLAIN, INSULT], [0, 1]) > whole.weigh([NEGATION, INSULT], [0, 1])


def test_clauses_and_words():
    scorer = Scorer({"loser": 1.0, "vequ*": 0.5})
    found = scorer.clauses("A closer look. You loser! It is said: he is no Loser; vequille here, vequ not. Loserly.")
    assert len(found) == 3 and found[0][2] > found[1][2]
    assert scorer.clauses("") == [] and scorer.clauses("losers closer") == []
    assert scorer.score(0) < 0.5 < scorer.score(2)
    # one mark only: the other marks are not looked for from the start of the text at every clause
    began = time.monotonic()
    assert len(scorer.clauses("you loser.  " * 200_000)) == 200_000
    assert time.monotonic() - began < 30


def test_held_out_toxicity(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = Q.op7_toxicity(spark, SF).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) >= 0.95


def test_labels_of_held_out_rows_are_never_read(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = learn_scorer(docs, labels), learn_scorer(docs, flipped)
    assert a.arcs == b.arcs and (a.offset, a.slope) == (b.offset, b.slope)
    assert learning_rows(docs, labels, "toxic", 50).count() == 50


def awkward(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "you idiot", None), (3, "you idiot", None), (None, "fine words", "y"), (4, "a b " * 50_000, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, label string")


def test_toxicity_of_awkward_rows(spark):
    docs = awkward(spark)
    nobody = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    scored = score_toxicity(docs, learn_scorer(docs, nobody)).collect()
    assert len(scored) == 6 and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if r.doc_id in (1, 2, None)}) == 1
    with pytest.raises(ValueError):
        score_toxicity(docs, Scorer({}), "label")
    assert score_toxicity(docs.limit(0), Scorer({"a": 1.0})).count() == 0


# -- operator 9 --


def test_thresholds_are_ordered_and_grades_recovered():
    rng = random.Random(1)
    rows, grades = [], []
    for _ in range(600):
        grade = rng.randrange(4)
        words = ["good"] * (3 * grade) + ["bad"] * (9 - 3 * grade) + [f"w{rng.randrange(50)}" for _ in range(10)]
        rng.shuffle(words)
        rows.append(features(" ".join(words).encode()))
        grades.append(grade)
    model = fit_ordinal(rows, np.array(grades))
    assert model.grades == [0, 1, 2, 3] and (np.diff(model.thresholds) > 0).all()
    scale = np.array([model.weights[i] @ v for i, v in rows])
    tails = model.tails(scale)
    assert (np.diff(tails, axis=1) <= 0).all()
    assert np.corrcoef(model.expected(tails), grades)[0, 1] > 0.9


def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = Q.op9_quality(spark, SF).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.keep == bool(r.quality) for r in rows) / len(rows) >= 0.95
    good = [r for r in rows if r.quality]
    assert sum(r.keep for r in good) / len(good) >= 0.98


def test_quality_of_awkward_rows(spark):
    docs = awkward(spark)
    nobody = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for model in (learn_quality(docs, nobody), learn_quality(docs, spark.createDataFrame([(3, 1, 1), (2, 0, 0)], "doc_id long, toxic int, quality int"))):
        scored = score_quality(docs, model).collect()
        assert len(scored) == 6 and all(0 <= r.tail_probability <= 1 for r in scored)
    with pytest.raises(ValueError):
        score_quality(docs.withColumn("keep", F.lit(1)), model)


# -- pipeline --


def test_pipeline_stages_against_brute_force(spark):
    import re

    from tests.llm.test_groups import brute_components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = corpus_pipeline.saved(stage(spark, kept, SF), "test")
        assert kept.columns == docs.columns
        after = {r.doc_id for r in kept.collect()}
        gone = set(before) - after
        assert after <= set(before)
        if name in ("toxicity", "quality"):
            good = {i for i in before if i in labels and labels[i].quality and not labels[i].toxic}
            assert len(good & gone) <= 0.02 * len(good)
        elif name == "near_duplicates":
            groups = {i: c for i, _, c in brute_components(sorted(before.items()))}
            assert after == {i for i in before if groups[i] == i}
        else:
            plain = lambda s: " " + " ".join(re.findall(r"\w+", s.lower())) + " "
            items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert gone == {i for i, t in before.items() if any(x in plain(t) for x in items)}
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert len(last) == kept.count() and all(r.lossless and r.n_pieces == len(r.piece_ids) for r in last)
    assert sorted(map(str, (tuple(r)[: len(docs.columns)] for r in last))) == sorted(map(str, map(tuple, kept.collect())))


def test_rows_of_null_or_repeated_ids_are_judged_alone(spark):
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) > 12)
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    texts = [" ".join(f"{word}{k}" for k in range(30)) for word in ("alpha", "beta", "gamma", "delta", "omega")]
    rows = [(None, texts[0]), (None, "words " + item), (7, texts[1]), (7, texts[2]), (8, item)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], schema)
    kept = corpus_pipeline.decontamination(spark, docs, SF).collect()
    assert {(r.doc_id, r.text) for r in kept} == {(None, texts[0]), (7, texts[1]), (7, texts[2])}
    rows = [(7, texts[1]), (7, texts[2]), (7, texts[2]), (None, texts[2]), (None, texts[3]), (None, texts[3] + " more"), (None, texts[0]), (9, texts[4]), (5, texts[4])]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], schema)
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()), key=str)
    named = [r for r in kept if r[0] is not None]
    assert named == sorted([(7, texts[1]), (7, texts[2]), (5, texts[4])], key=str)
    nameless = [t for i, t in kept if i is None]
    assert len(nameless) == 2 and texts[0] in nameless and {*nameless} & {texts[3], texts[3] + " more"}


def test_stages_of_awkward_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    extra = spark.createDataFrame(
        [(None, None, None, None, None), (None, "one two three four five six", "en", "s", 5), (77_000_001, "one two three four five six", None, None, 5),
         (77_000_002, "", "en", "s", 0), (77_000_002, "", "en", "s", 0)],
        docs.schema,
    )
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.unionByName(extra), SF).count() > 0, name
        stage(spark, docs.limit(0), SF).count()


def test_near_duplicates_keep_maps_and_clashing_columns(spark):
    rows = [(1, "a b c d e f", {"k": 1}, 5), (2, "a b c d e f", {"k": 2}, 6), (2, "a b c d e f", {"k": 2}, 6), (3, "other", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key map<string,int>, piece_ids int")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.row_key, r.piece_ids) for r in kept.collect()) == [(1, {"k": 1}, 5), (3, None, None)]
    coded = corpus_pipeline.sentencepiece(spark, docs, SF)
    assert coded.columns == ["doc_id", "text", "row_key", "piece_ids", "n_pieces", "lossless"] and coded.count() == 4
