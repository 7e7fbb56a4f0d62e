"""The change log against a step-by-step replay."""

import random
from collections import Counter

from pyspark.sql import functions as F

from leafmill.operators import changes as C

LIST = "user_id long, key string, at long, seq long, op string, title string, summary string, source_label string, done int"


def replay_list(changes):
    """The reading list behind each change, as the store keeps it."""
    held, states = {}, []
    for user, key, at, seq, op, title, summary, label, done in sorted(changes, key=lambda c: (c[2], c[3])):
        k = (user, key)
        if op == "add":
            old = held.get(k)
            held[k] = (title, summary, label, old[3] if old else at, old[4] if old else 0)
        elif op == "done" and k in held:
            held[k] = (*held[k][:4], done)
        elif op == "remove":
            held.pop(k, None)
        states.append((at, {(*k, *v) for k, v in held.items()}))
    return states


def some_changes(rng, n):
    rows = []
    for seq in range(n):
        user = 1 if rng.random() < 0.7 else rng.randrange(2, 5)
        op = rng.choice(["add", "add", "add", "done", "done", "remove"])
        key = f"k{rng.randrange(4)}"
        add = (f"t{seq}", f"s{seq}", f"{key}/{rng.randrange(2)}") if op == "add" else (None,) * 3
        rows.append((user, key, 1000 * rng.randrange(n), seq, op, *add, rng.randrange(2) if op == "done" else None))
    return rows


def test_reading_list_of_every_moment(spark):
    rng = random.Random(3)
    rows = some_changes(rng, 400)
    odd = [(None, "k0", 1, 900, "add", "x", "x", "x", None), (9, None, 1, 901, "add", "x", "x", "x", None), (9, "k", 5, 902, "remove", None, None, None, None)]
    frame = spark.createDataFrame(rows + odd, LIST).repartition(5)
    for cell in (10_000, C.CELL_MS):
        versions = C.reading_list_versions(frame, cell).cache()
        states = dict(replay_list(rows))  # the last change of a millisecond counts
        for at in sorted(states)[::37] + [max(states)]:
            got = C.as_of(versions, at).select("user_id", "key", "title", "summary", "source_label", "added_at", "is_done").collect()
            assert {tuple(r) for r in got} == states[at] and len(got) == len(states[at])
        assert versions.filter("to_at < from_at").count() == 0
    assert C.reading_list_versions(spark.createDataFrame([], LIST)).collect() == []


def replay_bookmarks(log):
    """Bookmarks behind each step: adds with tolerance, exact deletes, renames, cascades of deleted history items."""
    held, states = [], []
    for at, seq, op, user, source, block, offset, created, label in sorted(log):
        if op == "add":
            held = [b for b in held if not (b[:3] == (user, source, block) and abs(b[3] - offset) < 4)]
            held.append((user, source, block, offset, at, None))
        elif op == "delete":
            held = [b for b in held if b[:5] != (user, source, block, offset, created)]
        elif op == "rename":
            held = [(*b[:5], " ".join(label.split()) or None) if b[:5] == (user, source, block, offset, created) else b for b in held]
        elif op == "clear":
            held = [b for b in held if b[:2] != (user, source)]
        states.append((at, set(held)))
    return states


def test_bookmarks_of_every_moment(spark):
    rng = random.Random(5)
    log = []
    for i in range(300):
        at = 100 * i
        user, source, block, offset = (1 if rng.random() < 0.7 else 2), f"s{rng.randrange(2)}", rng.randrange(2), rng.randrange(30)
        log.append((at, 10 * i, "add", user, source, block, offset, None, None))
        if rng.random() < 0.3:
            log.append((at + rng.randrange(1, 3000), 10 * i + 1, "delete", user, source, block, offset, at, None))
        for n in range(rng.randrange(3)):
            log.append((at + rng.randrange(1, 3000), 10 * i + 2 + n, "rename", user, source, block, offset, at, rng.choice([" a  b ", " ", f"l{i}"])))
        if rng.random() < 0.05:
            log.append((at + 50, 10 * i + 5, "clear", user, source, None, None, None, None))
    frame = spark.createDataFrame(log, "at long, seq long, op string, user_id long, source_label string, block int, offset int, created_at long, new_label string")
    of = lambda op: frame.filter(F.col("op") == op)
    gone = of("delete").withColumnsRenamed({"at": "gone_at", "seq": "gone_seq"})
    for cell in (1000, C.CELL_MS):
        versions = C.bookmark_versions(of("add"), of("rename"), gone, of("clear"), cell_ms=cell).cache()
        states = dict(replay_bookmarks(log))
        for at in sorted(states)[::41] + [max(states)]:
            got = C.as_of(versions, at).select("user_id", "source_label", "block", "offset", "created_at", "label").collect()
            assert {tuple(r) for r in got} == states[at] and len(got) == len(states[at]), at


def test_cascades_ask_the_list_of_their_moment(spark):
    rng = random.Random(8)
    rows = some_changes(rng, 200)
    states = replay_list(rows)
    deletes = [(user, f"k{rng.randrange(4)}/{rng.randrange(2)}", 1000 * rng.randrange(220), 1000 + i) for i, user in enumerate([1, 2, 3] * 40)]
    frame = spark.createDataFrame(deletes, "user_id long, source_label string, at long, seq long")
    got = {r.seq: r.preserved for r in C.cascades(frame, C.reading_list_versions(spark.createDataFrame(rows, LIST)), 20_000).collect()}
    for user, label, at, seq in deletes:
        held = [s for t, s in states if t <= at]
        assert got[seq] == any(e[0] == user and e[4] == label for e in (held[-1] if held else ())), (user, label, at)
    assert Counter(got.values())[True] > 5
