"""Properties of physical plans that the scale of the data depends on."""

import os

import pytest

import __spark_entry__ as entry_module

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def plan(spark, name):
    frame = entry_module.queries()[name](spark, SF_DIR)
    return frame._jdf.queryExecution().executedPlan().toString()


def test_scoring_never_reads_the_question_texts(spark):
    text = plan(spark, "agg_score_closed")
    scans = [line for line in text.splitlines() if "ReadSchema" in line]
    assert scans and not any("text:string" in line for line in scans)


@pytest.mark.parametrize("name", ["win_smoke_a", "win_stratified_sample", "win_pick_smallest"])
def test_small_top_k_is_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


@pytest.mark.parametrize(
    "name", ["agg_score_closed", "jn_suffix", "jn_coverage", "win_retrieve", "jn_audit", "agg_cider"]
)
def test_no_pair_join(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    # The only loop joins left are those with one-row totals.
    assert text.count("BroadcastNestedLoopJoin") <= text.count("Cross")


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)" in plan(spark, "agg_bleu")
