"""Sweeps over arrays against plain loops, and a page with very many elements."""

import random
import time

from pyspark.sql import functions as F

from leafmill.functions import arrays as A
from leafmill.functions.text import let
from leafmill.operators import web as W
from tests.helpers import one

RANGE = "array<struct<open:int,end:int>>"


def ranges(rng, n):
    """Ranges that ascend by open, nested and overlapping."""
    opens = sorted(rng.sample(range(1, 4 * n + 5), n))
    return [(o, o + rng.randrange(1, 3 * n + 2)) for o in opens]


def test_running_states_and_ranks(spark):
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 10, 101):
        values = sorted(rng.randrange(50) for _ in range(n))
        column = F.array(*map(F.lit, values)).cast("array<int>")
        sums = one(spark, let(column, lambda c: A.running(c, F.lit(0), lambda s, x: s + x, "int")))
        assert sums == [sum(values[: i + 1]) for i in range(n)]
        for x in (-1, 0, 7, 25, 50, 99):
            assert one(spark, let(column, lambda c: A.rank_below(c, F.lit(x)))) == sum(v < x for v in values)


def test_covering_ranges(spark):
    rng = random.Random(2)
    for n in (0, 1, 5, 40):
        rs = ranges(rng, n)
        frame = spark.createDataFrame([(rs, list(range(0, 8 * n + 8)))], f"rs {RANGE}, ps array<int>")
        outer, over = frame.select(
            W.outermost("rs").alias("o"),
            let(A.reach_of("rs"), lambda i: F.transform("ps", lambda p: A.reached(i, p, p))).alias("c"),
        ).first()
        assert [tuple(r) for r in outer] == [r for r in rs if not any(o < r[0] < e for o, e in rs)]
        assert over == [any(o < p < e for o, e in rs) for p in range(0, 8 * n + 8)]


def test_a_page_of_very_many_elements(spark):
    """50,000 elements with removed parts all over: time does not grow with their product."""
    part = '<div class="x"><p>A paragraph number {} that is long enough to be read as one, really.</p><div class="sidebar">Read more links here</div></div>'
    pages = [(i, "https://e.org/" + str(i), "<body><article>" + "".join(part.format(k) for k in range(n)) + "</article></body>") for i, n in ((1, 100), (2, 16_000))]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    started = time.time()
    rows = W.prepare(frame).select("page_id", F.size("els3").alias("n"), F.size("block_els").alias("blocks")).collect()
    got = {r.page_id: r for r in rows}
    assert got[2].blocks == 160 * got[1].blocks and got[2].n > 15_000
    assert time.time() - started < 120
