import random

from pyspark.sql import functions as F

from leafmill.operators import library as J
from tests.helpers import one


def test_keys(spark):
    canon = lambda s: one(spark, J.canonical_source(F.lit(s)))
    assert canon("https://Www.Example.org/A/b/?x=1#y") == "https://www.example.org/a/b"
    assert canon("My File.pdf") == "my filepdf"
    assert one(spark, J.browser_identity(F.lit("HTTPS://Example.org/A/b/?x=1#y"))) == "https://example.org/A/b?x=1"
    assert one(spark, J.www_variant(F.lit("https://example.org/a"))) == "https://www.example.org/a"
    assert one(spark, J.www_variant(F.lit("https://a.example.org/a"))) is None
    assert one(spark, J.keep_www(F.lit("http://www.example.org/x"), F.lit("https://example.org/y"))) == "https://www.example.org/y"


def test_progress_is_shared_by_web_aliases_only(spark):
    moves = spark.createDataFrame(
        [(1, "https://example.org/a?x=1", 3, 9, 5, 1), (1, "captured-text:one", 4, 1, 6, 2)],
        "user_id long, source_label string, block int, offset int, at long, event_id long",
    )
    asks = spark.createDataFrame(
        [(1, "https://example.org/a"), (1, "captured-text:two")], "user_id long, source_label string"
    )
    got = {r["source_label"]: r["block"] for r in J.read_progress(asks, J.progress_table(moves)).collect()}
    assert got == {"https://example.org/a": 3, "captured-text:two": None}


def test_bookmark_upsert_against_replay(spark):
    rng = random.Random(7)
    rows = [(i, 1 + i % 2, "s", rng.randrange(3), rng.randrange(30), i * 10) for i in range(150)]
    expected = []
    for event, user, source, block, offset, at in rows:
        expected = [e for e in expected if not (e[1] == user and e[3] == block and abs(e[4] - offset) < 4)]
        expected.append((event, user, source, block, offset, at))
    df = spark.createDataFrame(rows, "event_id long, user_id long, source_label string, block int, offset int, created_at long")
    got = {r["event_id"] for r in J.bookmark_upsert(df).collect()}
    assert got == {e[0] for e in expected}


def test_evictions_against_replay(spark):
    rng = random.Random(3)
    rows = [(1, f"s{i}", rng.randrange(9) * 86_400_000 + rng.randrange(1000), rng.randrange(1, 9)) for i in range(60)]
    store = spark.createDataFrame(rows, "user_id long, source_label string, modified_at long, bytes long")
    known = spark.createDataFrame([(1, "s1"), (1, "s2")], "user_id long, source_label string")
    left, total, gone = len(rows), sum(r[3] for r in rows), set()
    for r in sorted((r for r in rows if r[1] not in ("s1", "s2")), key=lambda r: (r[2], r[1])):
        if left <= 24 and total <= 100:
            break
        gone.add(r[1])
        left, total = left - 1, total - r[3]
    got = {r["source_label"] for r in J.evictions(store, known, 24, 100).collect()}
    assert got == gone


def test_two_captures(spark):
    rich = "\n\n".join("A paragraph number %d that has quite a few words in it, for a test." % i for i in range(6))
    poor = "Menu\n\nHome page\n\nAnother label line here\n\nOne more label line that is short\n\nAnd the last label of it"
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, given_title string")
    v = J.capture_quality(frame([(1, rich, None), (2, poor, None), (3, rich, None), (4, "short", None)]))
    s = J.capture_quality(frame([(1, poor, None), (2, rich, None), (3, rich, None)]))
    got = {r["doc_id"]: r["choice"] for r in J.choose_capture(v, s).collect()}
    assert got == {1: "visible", 2: "session", 3: "visible", 4: None}


def test_history_is_whole_unless_a_number_is_given(spark):
    rows = [(i, 1, f"Page {i}", "s", "WEB", f"https://example.org/{i % 30}", i) for i in range(90)]
    df = spark.createDataFrame(
        rows, "event_id long, user_id long, title string, summary string, kind string, source_label string, opened_at long"
    )
    assert {r["opened_at"] for r in J.history(df).collect()} == set(range(60, 90))
    got = [r["opened_at"] for r in J.history(df, kept=20).orderBy("rank").collect()]
    assert got == list(range(89, 69, -1))


def test_bookmarks_are_deleted_and_renamed_exactly(spark):
    rows = [(1, "s", 0, 5, 10, "old"), (1, "s", 0, 5, 11, "old"), (2, "s", 0, 5, 10, None)]
    marks = spark.createDataFrame(rows, "user_id long, source_label string, block int, offset int, created_at long, label string")
    gone = spark.createDataFrame([(1, "s", 0, 5, 11)], "user_id long, source_label string, block int, offset int, created_at long")
    assert {(r.user_id, r.created_at) for r in J.bookmark_delete(marks, gone).collect()} == {(1, 10), (2, 10)}
    names = spark.createDataFrame(
        [(1, "s", 0, 5, 10, " a  new\tlabel " + "x" * 100, 1), (2, "s", 0, 5, 10, "  ", 1)],
        "user_id long, source_label string, block int, offset int, created_at long, new_label string, at long",
    )
    got = {(r.user_id, r.created_at): r.label for r in J.bookmark_rename(marks, names).collect()}
    assert got == {(1, 10): "a new label " + "x" * 100, (1, 11): "old", (2, 10): None}


def test_a_bookmark_alone_protects_a_document(spark):
    source = "user_id long, source_label string"
    nobody = spark.createDataFrame([], source)
    marked = spark.createDataFrame([(1, "a")], source)
    store = spark.createDataFrame([(1, "a", 1, 10), (1, "b", 2, 10)], source + ", modified_at long, bytes long")
    known = J.known_sources(nobody, marked, nobody, nobody)
    assert [tuple(r) for r in J.orphan_report(store, known).collect()] == [(1, 1, 10)]
    assert [r.source_label for r in J.evictions(store, known, 0, 0).collect()] == ["b"]


def test_paged_keys_take_the_whole_summary(spark):
    from leafmill.operators import library as J

    rows = [("PDF", "a.pdf", "T", "word " * 30 + end) for end in ("one", "two")]
    frame = spark.createDataFrame(rows, "kind string, source_label string, title string, summary string")
    assert frame.select(J.entry_key()).distinct().count() == 2
    assert frame.select(J.entry_key(chars=100)).distinct().count() == 1


def test_nearest_bookmark_against_all_pairs(spark):
    rng = random.Random(11)
    long = "the quick brown fox jumps over the lazy dog and then over all of the other animals of the farm " * 2

    def snippet():
        kind = rng.random()
        if kind < 0.1:
            return None if kind < 0.05 else "Short one"
        text = long[: rng.randrange(10, len(long))] + rng.choice(["", "", "x", "yy"])
        return text.upper() if rng.random() < 0.3 else text

    marks = [(i, rng.randrange(2), "s", rng.randrange(2), rng.randrange(500), snippet(), rng.randrange(40)) for i in range(300)]
    asks = [(i, rng.randrange(2), "s", rng.randrange(3), rng.randrange(500), snippet()) for i in range(200)]
    t = spark.createDataFrame(asks, "target_id long, user_id long, source_label string, block int, offset int, snippet string")
    b = spark.createDataFrame(marks, "event_id long, user_id long, source_label string, block int, offset int, snippet string, created_at long")
    for chars in (None, 48):
        expected = {}
        for target, user, _, block, at, own in asks:
            best = []
            for event, u, _, bl, offset, theirs, made in marks:
                x, y = (" ".join((v or "").split()).lower()[:chars] for v in (own, theirs))
                alike = min(len(x), len(y)) >= 16 and (x.startswith(y) or y.startswith(x))
                if (u, bl) == (user, block) and (abs(offset - at) <= 12 or alike):
                    best.append((abs(offset - at), -made, -event, offset))
            if best:
                expected[target] = (-min(best)[2], min(best)[3])
        got = {r.target_id: (r.event_id, r.offset) for r in J.nearest_bookmark(t, b, chars).collect()}
        assert got == expected and len(got) > 100
    assert J.nearest_bookmark(t, b.limit(0)).count() == 0 and J.nearest_bookmark(t.limit(0), b).count() == 0
