"""CHT-1..8: chart datasets."""

import pytest

from kpimart.config import ChartConfig, PipelineConfig
from kpimart.operators.charts import chart_dataset, check_chart, combined_datasets, multi_series, pie_slices


@pytest.fixture()
def agg(spark):
    return spark.createDataFrame(
        [(2020, "a", 1.0, None), (2021, "b", 3.0, 4.0)], "year int, cat string, lo double, hi double"
    )


def test_bar_line_table(agg):
    bar = chart_dataset(agg, ChartConfig("bar", "year", "lo"))
    assert bar.columns == ["x", "series", "value"]
    assert sorted((r.x, r.series, r.value) for r in bar.collect()) == [(2020, "lo", 1.0), (2021, "lo", 3.0)]
    line = chart_dataset(agg, ChartConfig("line", "year", "lo"))
    assert line.columns == ["x", "series", "value"]
    table = chart_dataset(agg, ChartConfig("table", "year", ["lo", "hi"]))
    assert table.columns == ["year", "lo", "hi"]


def test_dot_with_size_and_color(agg):
    dot = chart_dataset(agg, ChartConfig("dot", "year", "lo", size="hi", color="cat"))
    assert dot.columns == ["x", "y", "size", "color"]


def test_multi_series_keeps_nulls(agg):
    long = multi_series(agg, "year", ["lo", "hi"])
    rows = sorted((r.year, r.series, r.value) for r in long.collect())
    assert (2020, "hi", None) in rows and len(rows) == 4


def test_pie_shares_sum_to_100(agg):
    slices = pie_slices(agg, "cat", "lo").collect()
    assert sum(r.share for r in slices) == pytest.approx(100.0)


def test_chart_columns_checked(agg):
    with pytest.raises(ValueError, match="Unknown chart column"):
        check_chart(agg, ChartConfig("bar", "year", "LO"))


def test_combined_charts_share_one_filtered_frame(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y")], "cat string, brand string")
    cnt = lambda k: PipelineConfig.from_dict({"aggregations": [{"column": "c", "operation": "count", "alias": "n"}], "group_by": [k]})
    out = combined_datasets(df, [(cnt("cat"), ChartConfig("bar", "cat", "n")), (cnt("brand"), ChartConfig("bar", "brand", "n"))])
    assert sorted((r.chart_id, r.x, r.value) for r in out.collect()) == [(0, "a", 2), (0, "b", 1), (1, "x", 1), (1, "y", 2)]


def test_combined_grouping_sets_equal_separate_charts(spark):
    from kpimart.plans.processing import run

    df = spark.createDataFrame(
        [("a", "x", 1.0), ("a", "y", 2.0), ("b", "y", 3.0), (None, "y", 4.0), ("b", None, 5.0)],
        "cat string, brand string, v double",
    )
    aggs = [{"column": "v", "operation": "sum", "alias": "s"}, {"column": "v", "operation": "count", "alias": "n"}]
    cfg = lambda k: PipelineConfig.from_dict({"filters": [{"column": "v", "op": "<", "value": 5.0}], "aggregations": aggs, "group_by": [k]})
    charts = [(cfg("cat"), ChartConfig("bar", "cat", "s")), (cfg("brand"), ChartConfig("line", "brand", "n"))]
    out = combined_datasets(df, charts)
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    want = []
    for i, (p, c) in enumerate(charts):
        for r in run(df, p).collect():
            want.append((i, r[c.x], c.y[0], float(r[c.y[0]])))
    assert got == sorted(want, key=repr)  # includes the real null keys of both charts
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Expand" in plan and "Union" not in plan  # one grouping-sets pass
