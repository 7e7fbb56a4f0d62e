import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafmill.operators import layout as L
from leafmill.sources import store
from leafmill.streaming import jobs as T
from tests.helpers import lit_array, one

HEADER = "text\ttop\tleft\tbottom\tright\tisHeading\tisClickable\n"
BODY = "The council of the town agreed on Monday that the old bridge would be repaired before the winter, which pleased"


def boxes(spark, rows):
    data = [(1, [(t, a, b, c, d, h, k, "org.example") for t, a, b, c, d, h, k in rows])]
    return spark.createDataFrame(data, f"doc_id long, boxes array<{L.BOX}>")


def test_inline_link_and_punctuation_are_joined(spark):
    df = boxes(
        spark,
        [(BODY, 100, 40, 200, 1000, False, False), ("Harbour Town Hall", 170, 500, 200, 700, False, True),
         (", and the river", 170, 705, 200, 900, False, False),
         (BODY.replace("Monday", "Friday") + " nobody.", 300, 40, 400, 1000, False, False)],
    )
    got = df.select(L.screen_text("boxes").alias("t")).first()["t"]
    assert got[0] == BODY + " Harbour Town Hall, and the river" and len(got) == 2


def test_labels_and_systemui_are_noise(spark):
    df = boxes(spark, [("Subscribe now", 0, 0, 9, 9, False, False), ("Short", 0, 0, 9, 9, False, True), (BODY, 0, 0, 9, 9, False, False)])
    flags = df.select(F.transform("boxes", L.noisy_box).alias("x")).first()["x"]
    assert flags == [True, False, False]


def test_article_starts_at_the_title_and_ends_at_the_discussion(spark):
    texts = ["www.example.com - by a friend", "The Bridge of the Town", "By Jane Field, 3 Mar", BODY + " everyone in it.", "3 replies", "I agree with it"]
    assert one(spark, L.article_part(lit_array(texts))) == texts[1:4]


def test_box_table_fails_on_another_width(spark, tmp_path):
    good = tmp_path / "good.tsv"
    good.write_text(HEADER + "A text\t1\t2\t3\t4\ttrue\tfalse\n\nB\t1\t2\t3\t4\tfalse\ttrue\n")
    assert store.read_boxes(spark, str(good)).count() == 2
    bad = tmp_path / "bad.tsv"
    bad.write_text(HEADER + "A text\t1\t2\n")
    with pytest.raises(Exception):
        store.read_boxes(spark, str(bad)).collect()


def test_fragments_against_the_plain_rule(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abc ") for _ in range(120))
    pieces, at = [], 0
    while at < len(text):
        end = min(at + rng.randrange(1, 12), len(text))
        pieces.append(rng.choice([text[at:end], text[:end], text[max(at - 3, 0):end]]))
        at = end
    expected = ""
    for p in pieces:
        expected = T.joined_fragment(expected, p)
    assert one(spark, T.assemble_fragments(lit_array(pieces))) == expected


def test_fragment_kinds(spark):
    join = lambda *p: one(spark, T.assemble_fragments(lit_array(p)))
    assert join("Hello", "Hello wor", "wor", "world", " ", "!") == "Hello world!"


def test_sessions_close_at_the_limits(spark, sf_dir):
    from leafmill.plans import all_queries

    got = {tuple(r) for r in all_queries()["t03_capture_sessions"](spark, sf_dir).collect()}
    events = pd.read_parquet(f"{sf_dir}/events.parquet")
    events["k"] = events.props.str.extract(r"(\d+)").astype(int)
    expected = set()
    for user, rows in events.sort_values("event_id").groupby("user_id"):
        session = steps = stalled = blocks = chars = 0
        for k in rows.k:
            fresh = k % 3
            steps, blocks, chars = steps + 1, blocks + fresh, chars + (k * 2 if fresh else 0)
            stalled = 0 if fresh else stalled + 1
            if steps >= 10 or stalled >= 2:
                if chars >= 120:
                    expected.add((user, session, steps, blocks, chars))
                session, steps, stalled, blocks, chars = session + 1, 0, 0, 0, 0
    assert got == expected


def test_stream_equals_batch_for_fragments(spark, sf_dir):
    from leafmill.plans import all_queries

    a = {tuple(r) for r in all_queries()["t07_fragment_assembly"](spark, sf_dir).select("response_id", "text").collect()}
    b = {tuple(r) for r in all_queries()["t07_fragment_stream"](spark, sf_dir).select("response_id", "text").collect()}
    assert a == b


def test_json_reading_is_tolerant(spark):
    line = '{"title":"T","sourceLabel":"https://e.org/a.pdf","presentation":{"modelId":"m","blocks":[]},"summary":{"modelId":" ","text":"x"}}'
    got = one(spark, store.from_json_line(F.lit(line)))
    assert (got["kind"], got["pageCount"], got["presentation"], got["summary"], got["blocks"]) == ("PDF", 0, None, None, [])


def test_streams_do_not_depend_on_files(spark, sf_dir, tmp_path):
    """events as a folder of many files in random order, one file a batch, against one file."""
    import random

    from pyspark.sql import functions as F

    from leafmill.plans import all_queries
    from leafmill.streaming import run as R

    events = pd.read_parquet(f"{sf_dir}/events.parquet").sample(frac=1, random_state=5)
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    order = list(range(6))
    random.Random(1).shuffle(order)
    for i in order:
        events.iloc[i::6].to_parquet(folder / f"part-{i}.parquet", coerce_timestamps="us")
    queries = all_queries()
    stream = R.stream_events
    try:
        R.stream_events = lambda s, d: stream(s, d, 1)
        for name in (
            "t01_samples", "t02_session_dedupe", "t03_capture_sessions_stream", "t04_recent_lookup_stream", "t05_throttle_stream",
            "t06_latest_positions", "t09_activity_status",
        ):
            many = sorted(map(str, queries[name](spark, str(tmp_path)).collect()))
            assert many == sorted(map(str, queries[name](spark, sf_dir).collect())), name
    finally:
        R.stream_events = stream
