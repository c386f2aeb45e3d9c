"""MET-1..4: year over year, shares, custom metrics."""

import pytest

from kpimart.config import PipelineConfig
from kpimart.functions.registry import get_aggregate, register_aggregate, unregister_aggregate
from kpimart.operators.metrics import ratio_of_sums, share, share_of_parent, share_of_total, yoy
from kpimart.plans.processing import run


def test_gap_years_and_zero_previous(spark):
    df = spark.createDataFrame(
        [("c", 2019, 100.0), ("c", 2020, 110.0), ("c", 2022, 50.0), ("d", 2019, 0.0), ("d", 2020, 5.0)],
        "cat string, year int, v double",
    )
    out = {(r.cat, r.year): r for r in yoy(df, "v", "year", ["cat"]).collect()}
    assert out[("c", 2019)].yoy is None
    assert out[("c", 2020)].yoy == pytest.approx(0.1)
    assert out[("c", 2022)].yoy is None and out[("c", 2022)].prev_v is None  # gap
    assert out[("d", 2020)].yoy is None  # previous value 0


def test_yoy_without_dims_uses_no_global_window(spark):
    df = spark.createDataFrame([(2019, 10.0), (2020, 15.0), (2020, 5.0), (2021, 10.0)], "year int, v double")
    res = yoy(df, "v", "year")
    out = {r.year: r for r in res.collect()}
    assert out[2020].v == 20.0 and out[2020].yoy == pytest.approx(1.0)  # duplicates summed first
    assert out[2021].yoy == pytest.approx(-0.5)
    assert "Window" not in res._jdf.queryExecution().executedPlan().toString()


def test_shares_in_a_group_sum_to_100(spark):
    df = spark.createDataFrame(
        [("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 2.0), (None, "z", 4.0), (None, "w", 4.0)],
        "parent string, child string, v double",
    )
    out = share_of_parent(df, "v", ["parent"]).groupBy("parent").sum("share").collect()
    for r in out:
        assert r["sum(share)"] == pytest.approx(100.0)
    tot = share_of_total(df, "v")
    assert sum(r.share for r in tot.collect()) == pytest.approx(100.0)
    plan = tot._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_zero_total_gives_null_share(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0)], "k string, v double, t double")
    assert share(df, "v", "t").first().share is None
    assert share_of_total(df, "v").first().share is None


def test_custom_metric_registry_last_wins(spark):
    df = spark.createDataFrame([("a", 10.0, 2.0), ("a", 20.0, 3.0)], "k string, s double, q double")

    @register_aggregate("test_ratio")
    def _first(d, column):
        return ratio_of_sums("q", "s")

    @register_aggregate("test_ratio")
    def _second(d, column):
        return ratio_of_sums("s", "q")

    try:
        assert get_aggregate("test_ratio") is _second
        cfg = PipelineConfig.from_dict({"aggregations": [{"column": "s", "operation": "test_ratio", "alias": "r"}], "group_by": ["k"]})
        assert run(df, cfg).first().r == pytest.approx(6.0)
    finally:
        unregister_aggregate("test_ratio")
    with pytest.raises(ValueError, match="Unknown aggregation operation"):
        PipelineConfig.from_dict({"aggregations": [{"column": "s", "operation": "test_ratio"}]})
