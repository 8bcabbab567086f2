"""Plan shapes: the similarity joins are equi-joins (no nested loop or
cartesian product), filters and column pruning reach the parquet scan,
capped lists run a partial window group limit before the shuffle."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF0001


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["near_pairs", "near_pairs_exact_bits", "lsh_pairs", "similar_count",
                                  "duplicate_summary", "neighbours_before", "avg_exists_combined"])
def test_no_nested_loop(spark, name):
    p = plan(E.queries()[name](spark, SF0001))
    assert "NestedLoopJoin" not in p and "CartesianProduct" not in p


def test_scan_pruning_and_pushdown(spark):
    df = E.queries()["hash_scan"](spark, SF0001)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in text and "animated" in text
    assert "crc" not in text.split("ReadSchema:")[1].split("\n")[0]


@pytest.mark.parametrize("name", ["same_digest_all", "similar_all", "lsh_nearest"])
def test_partial_window_group_limit(spark, name):
    df = E.queries()[name](spark, SF0001)
    df.collect()   # adaptive plan is final after execution
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in p
