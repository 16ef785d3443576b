"""Plans: no nested-loop joins, scans that read only what is needed, filters that reach the scan."""

import pytest

from turnwise.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["lookup_outcome", "exact_item_hits", "dense_cosine_top1", "interval_overlap", "late_feedback", "prototype_match", "trigram_cosine", "alias_overlap", "selector_lookup", "group_report", "rolling_share", "teacher_vs_fsm"])
def test_no_nested_loops(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name, columns", [("dup_inputs", "doc_id:bigint,text:string"), ("suite_report", "conv_id:bigint,text:string"), ("sorted_sets", "p_name:string,p_brand:string,p_type:string")])
def test_scans_are_pruned(spark, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan(spark, name)


def test_filters_reach_the_scan(spark):
    p = plan(spark, "missing_reference")
    assert "GreaterThan(l_quantity" in p


def test_ordered_windows_see_ranges_not_the_stream(spark):
    """What goes to one partition are sums of ranges."""
    p = plan(spark, "rolling_share")
    for part in p.split("Exchange SinglePartition")[1:]:
        assert "HashAggregate" in part.split("\n")[1] or "Project" in part.split("\n")[1]
