"""PRJ-1..5: computed fields, expression grammar, aggregate broadcast."""

import pandas as pd
import pytest

from kpimart.config import ComputedField
from kpimart.operators.computed import growth_ratio, with_computed_fields


@pytest.fixture()
def df(spark):
    return spark.createDataFrame(
        [("a", 1.0, 2), ("a", 3.0, 0), ("b", 5.0, 4), (None, 7.0, 1)], "g string, v double, w int"
    )


def test_chain_and_replace(df):
    out = with_computed_fields(
        df,
        [
            {"name": "v2", "expression": {"op": "*", "args": [{"col": "v"}, {"lit": 2}]}},
            {"name": "v3", "expression": {"op": "+", "args": [{"col": "v2"}, {"lit": 1}]}},
            {"name": "v", "expression": {"op": "neg", "args": [{"col": "v"}]}},
        ],
    )
    rows = sorted((r.v, r.v2, r.v3) for r in out.collect())
    assert rows == [(-7.0, 14.0, 15.0), (-5.0, 10.0, 11.0), (-3.0, 6.0, 7.0), (-1.0, 2.0, 3.0)]


def test_division_by_zero_is_null(df):
    out = with_computed_fields(df, [ComputedField("r", {"op": "/", "args": [{"col": "v"}, {"col": "w"}]})])
    by_v = {r.v: r.r for r in out.collect()}
    assert by_v[3.0] is None and by_v[1.0] == 0.5


def test_growth_ratio(spark):
    df = spark.createDataFrame([(110.0, 100.0), (5.0, 0.0), (5.0, None)], "value double, prev double")
    got = [r.growth for r in growth_ratio(df, "value", "prev").collect()]
    assert got[0] == pytest.approx(0.1) and got[1] is None and got[2] is None


def test_string_operand_rejected(df):
    with pytest.raises(ValueError, match="numeric"):
        with_computed_fields(df, [ComputedField("x", {"op": "+", "args": [{"col": "g"}, {"lit": 1}]})])


def test_unknown_column_and_case_clash(df):
    with pytest.raises(ValueError, match="Unknown"):
        with_computed_fields(df, [ComputedField("x", {"col": "V"})])
    with pytest.raises(ValueError, match="case"):
        with_computed_fields(df, [ComputedField("V", {"lit": 1})])


def test_sql_string_form_and_subquery_rejected(df):
    out = with_computed_fields(df, [ComputedField("x", "v * w")])
    assert sorted(r.x for r in out.collect()) == [0.0, 2.0, 7.0, 20.0]
    with pytest.raises(ValueError, match="Subqueries"):
        with_computed_fields(df, [ComputedField("x", "(select 1)")])
    with pytest.raises(ValueError, match="Invalid expression"):
        with_computed_fields(df, [ComputedField("x", "nope + 1")])


def test_whole_frame_aggregate_is_a_scalar_subquery(df):
    out = with_computed_fields(
        df, [ComputedField("below_max", {"op": "-", "args": [{"agg": "max", "arg": {"col": "v"}}, {"col": "v"}]})]
    )
    assert sorted(r.below_max for r in out.collect()) == [0.0, 2.0, 4.0, 6.0]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Window" not in plan


def test_grouped_aggregate_matches_brute_force(df):
    share = {"op": "/", "args": [{"col": "v"}, {"agg": "sum", "arg": {"col": "v"}, "over": ["g"]}]}
    out = with_computed_fields(df, [ComputedField("part", share)]).toPandas()
    pdf = df.toPandas()
    pdf["total"] = pdf.groupby("g", dropna=False)["v"].transform("sum")
    pdf["part"] = pdf["v"] / pdf["total"]
    left = out.sort_values("v").reset_index(drop=True)
    right = pdf.sort_values("v").reset_index(drop=True)
    pd.testing.assert_series_equal(left["part"], right["part"], check_names=False)
    assert list(out.columns) == ["g", "v", "w", "part"]  # helper columns dropped


def test_rows_are_not_shuffled_for_the_values_of_few_groups(spark):
    df = spark.range(4_000_000).selectExpr("id", "if(id % 4 = 3, null, id % 4) g", "cast(id as double) v")
    above = {"op": "-", "args": [{"col": "v"}, {"agg": "min", "arg": {"col": "v"}, "over": ["g"]}]}
    out = with_computed_fields(df, [ComputedField("above", above)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert sorted((r.g is None, r.above) for r in out.where("id < 8").collect()) == sorted((i % 4 == 3, float(i - i % 4)) for i in range(8))
