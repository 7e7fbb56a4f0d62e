"""Queries against their DuckDB SQL on the smallest tables, and plan checks."""

import pytest

from leafmill.checks.compare import compare, duck
from leafmill.plans import all_checks, all_queries

FAST = [
    "s02", "s05", "s06", "b01", "b02", "b03", "b05", "b06", "b07", "b08", "b09", "b10", "b11", "p01", "p02", "p03", "p09",
    "p13", "p14", "p15", "n01", "n02", "n04", "n06", "n08", "n09", "n12", "n14", "a01", "a02", "a03", "c01", "c02", "c06",
    "c08", "c10", "c11", "c16", "j01", "j03", "j04", "j05", "j06", "j12", "j15", "j17", "j18", "l01", "l03", "l06", "t01",
    "t04", "t05", "t06",
]
NAMES = [n for n in all_checks() if n.split("_")[0] in FAST]


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, sf_dir, name):
    ok, message = compare(all_queries()[name](spark, sf_dir), con, all_checks()[name])
    assert ok, message


def test_every_check_belongs_to_a_query():
    assert set(all_checks()) <= set(all_queries())


@pytest.mark.parametrize("name", ["b09_block_cleanup", "p16_formatted", "n01_sentence_table", "c08_validation", "j05_bookmarks", "a02_progress"])
def test_plans_stay_native(spark, sf_dir, name):
    plan = all_queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan
