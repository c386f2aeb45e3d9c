"""REG-1 (named processors) and REG-2 (named dashboard datasets)."""

import pytest

from kpimart.functions.registry import apply_transformation, get_transformation, register
from kpimart.plans.dashboards import (
    DashboardRegistry,
    PipelineDashboard,
    StoredDashboard,
    get_dashboard,
    register_dashboard,
)
from kpimart.sinks.store import SnapshotStore

CONFIG = {
    "name": "Sales",
    "pipeline": {"aggregations": [{"column": "sales", "operation": "sum", "alias": "total"}], "group_by": ["cat", "year"]},
    "view": {"charts": [{"type": "bar", "x": "cat", "y": "total"}], "filters": ["year"]},
}


@pytest.fixture()
def df(spark):
    return spark.createDataFrame([("a", 2020, 1.0), ("a", 2021, 2.0), ("b", 2020, 3.0)], "cat string, year int, sales double")


def test_transformation_registry_last_wins(df):
    @register("test_double")
    def _one(d):
        return d.withColumn("sales", d.sales * 3)

    @register("test_double")
    def _two(d, factor=2):
        return d.withColumn("sales", d.sales * factor)

    assert get_transformation("test_double") is _two
    assert get_transformation("absent") is None
    assert sorted(r.sales for r in apply_transformation(df, "test_double").collect()) == [2.0, 4.0, 6.0]

    @register("test_class")
    class Scale:
        def __init__(self, factor):
            self.factor = factor

        def __call__(self, d):
            return d.withColumn("sales", d.sales * self.factor)

    assert sorted(r.sales for r in apply_transformation(df, "test_class", factor=10).collect()) == [10.0, 20.0, 30.0]
    with pytest.raises(ValueError, match="Unknown transformation"):
        apply_transformation(df, "absent")


def test_pipeline_dashboard(df):
    d = PipelineDashboard(CONFIG, df)
    assert d.name == "Sales"
    got = d.get_data({"year": 2020})
    assert sorted((r.cat, r.total) for r in got.collect()) == [("a", 1.0), ("b", 3.0)]
    with pytest.raises(ValueError, match="not permitted"):
        d.get_data({"cat": "a"})
    charts = d.chart_data({"year": 2020})
    assert len(charts) == 1 and charts[0].columns == ["x", "series", "value"]
    d.update_config({"name": "Renamed"})
    assert d.get_config()["name"] == "Renamed" and "pipeline" in d.get_config()
    assert PipelineDashboard({}, df).name == "Unnamed Dashboard"


def test_stored_dashboard(spark, df, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    d = StoredDashboard(CONFIG, store, 3)
    assert d.get_data() is None
    store.save(3, PipelineDashboard(CONFIG, df).get_data())
    assert sorted(r.total for r in d.get_data({"year": 2021}).collect()) == [2.0]


def test_dashboard_registry():
    reg = DashboardRegistry()
    reg.register("sales", PipelineDashboard)
    reg.register("sales", StoredDashboard)
    assert reg.get("sales") is StoredDashboard and reg.list_all() == ["sales"]
    assert reg.unregister("sales") and not reg.unregister("sales") and reg.get("sales") is None
    register_dashboard("global_sales", PipelineDashboard)
    assert get_dashboard("global_sales") is PipelineDashboard
