"""Plan shape: no cross joins, filters and columns reach the scan, top-k is limited before the shuffle."""

from __future__ import annotations

import pytest

from __spark_entry__ import queries

SF_DIR = "/root/testdata/sf0.001"
QUERIES = queries()
TRAINED = {n for n in QUERIES if n.startswith("ml_") and n not in ("ml_5_group_keys", "ml_6_company_tokens", "ml_7_positive_lines")}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TRAINED))
def test_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filter_and_columns_reach_scan(spark):
    text = plan(QUERIES["flt_9_listing"](spark, SF_DIR))
    assert "EqualTo(o_orderstatus,F)" in text and "TakeOrderedAndProject" in text and "o_orderpriority" not in text


def test_group_limit_before_shuffle(spark):
    text = plan(QUERIES["win_7_active_order"](spark, SF_DIR))
    assert text.count("WindowGroupLimit") == 2


def test_line_context_needs_no_shuffle(spark):
    assert "hashpartitioning" not in plan(QUERIES["rsh_8_line_features"](spark, SF_DIR))


def test_only_two_python_functions(spark):
    used = {n for n in set(QUERIES) - TRAINED if "ArrowEvalPython" in plan(QUERIES[n](spark, SF_DIR))}
    assert used == {"prj_2_unicode_form", "jn_6_gestalt_best"}
