"""Config parsing and build-time checks (no job needed)."""

import pytest

from kpimart.config import AggregationSpec, ChartConfig, DashboardConfig, FilterSpec, PipelineConfig


def test_unknown_operation_rejected_before_any_job():
    with pytest.raises(ValueError, match="Unknown aggregation operation: median"):
        PipelineConfig.from_dict({"aggregations": [{"column": "x", "operation": "median"}]})


def test_default_alias():
    assert AggregationSpec("sales", "sum").output_name == "sum_sales"
    assert AggregationSpec("id", "count", "n").output_name == "n"


def test_duplicate_alias_rejected():
    with pytest.raises(ValueError, match="Duplicate aggregation alias"):
        PipelineConfig.from_dict(
            {"aggregations": [{"column": "a", "operation": "sum", "alias": "t"}, {"column": "b", "operation": "max", "alias": "t"}]}
        )


def test_alias_equal_to_key_rejected():
    with pytest.raises(ValueError, match="equals a group key"):
        PipelineConfig.from_dict({"aggregations": [{"column": "a", "operation": "sum", "alias": "k"}], "group_by": ["k"]})


def test_duplicate_key_rejected():
    with pytest.raises(ValueError, match="Duplicate group key"):
        PipelineConfig.from_dict({"aggregations": [], "group_by": ["k", "k"]})


def test_missing_aggregations_key_is_none_and_empty_list_is_empty():
    assert PipelineConfig.from_dict({"group_by": ["a"]}).aggregations is None
    assert PipelineConfig.from_dict({"aggregations": [], "group_by": ["a"]}).aggregations == ()


def test_filter_operators():
    assert FilterSpec("a", 1, "=").op == "=="
    assert FilterSpec("a", [1, 2], "in").value == (1, 2)
    with pytest.raises(ValueError, match="Unknown filter operator"):
        FilterSpec("a", 1, "~")
    with pytest.raises(ValueError, match="needs a list"):
        FilterSpec("a", "x", "in")
    with pytest.raises(ValueError, match="needs a string"):
        FilterSpec("a", 3, "contains")


def test_chart_config_checks():
    c = ChartConfig.from_dict({"type": "bar", "x": "year", "y": "n"})
    assert c.y == ("n",)
    assert ChartConfig("line", "x", ["a", "b"]).y == ("a", "b")
    assert ChartConfig("dot", "x", "y", size="s").columns == ("x", "y", "s")
    with pytest.raises(ValueError, match="Unknown chart type"):
        ChartConfig("area", "x", "y")
    with pytest.raises(ValueError, match="needs 'x'"):
        ChartConfig.from_dict({"type": "bar", "y": "n"})


def test_dashboard_config_flat_and_nested_forms():
    flat = DashboardConfig.from_json(
        '{"charts": [{"type": "bar", "x": "category", "y": "total"}], "filters": ["year", "brand"], '
        '"aggregations": [{"column": "sales", "operation": "sum", "alias": "total"}], "group_by": ["category"]}'
    )
    assert flat.view.filters == ("year", "brand")
    assert flat.pipeline.filters == ()
    assert flat.pipeline.group_by == ("category",)
    nested = DashboardConfig.from_dict(
        {"name": "N", "pipeline": {"filters": [{"column": "region", "value": "X"}]}, "view": {"filters": ["year"]}}
    )
    assert nested.name == "N"
    assert nested.pipeline.filters[0] == FilterSpec("region", "X")
    assert DashboardConfig.from_json("").name == "Unnamed Dashboard"
    with pytest.raises(ValueError, match="valid JSON"):
        DashboardConfig.from_json("{not json")


def test_cluster_conf_keys_are_spark_settings(spark):
    from kpimart.session import CLUSTER_CONF

    for key in CLUSTER_CONF:
        assert key.startswith("spark.")
    # the SQL settings are runtime settings Spark knows
    for key in CLUSTER_CONF:
        if key.startswith("spark.sql."):
            assert spark.conf.isModifiable(key), key
