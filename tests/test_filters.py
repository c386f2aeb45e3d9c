"""FLT-1..9 and the filter rows of the semantics contract."""

import pytest
from pyspark.sql import types as T

from kpimart.config import FilterSpec, ViewConfig
from kpimart.operators.filters import GlobalFilters, apply_filters, apply_row_filters, check_permitted

SCHEMA = T.StructType(
    [
        T.StructField("year", T.IntegerType()),
        T.StructField("category", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("sales", T.DoubleType()),
    ]
)
ROWS = [(2019, "A", "b1", 1.0), (2020, "A", "b2", 2.0), (2020, "B", None, 3.0), (2022, "B", "b1", 4.0)]


@pytest.fixture()
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def _years(df):
    return sorted(r.year for r in df.collect())


def test_equality_filters_and_in_order(df):
    out = apply_row_filters(df, [{"column": "year", "value": 2020}, {"column": "category", "value": "A"}])
    assert [(r.year, r.category) for r in out.collect()] == [(2020, "A")]


def test_comparison_operators(df):
    assert _years(apply_row_filters(df, [FilterSpec("year", 2020, ">=")])) == [2020, 2020, 2022]
    assert _years(apply_row_filters(df, [FilterSpec("year", 2020, "<")])) == [2019]
    assert _years(apply_row_filters(df, [FilterSpec("sales", 2.0, "<=")])) == [2019, 2020]
    assert _years(apply_row_filters(df, [FilterSpec("category", "A", "!=")])) == [2020, 2022]


def test_not_equal_drops_null_cells(df):
    assert _years(apply_row_filters(df, [FilterSpec("brand", "b1", "!=")])) == [2020]


def test_in_and_contains(df):
    assert _years(apply_row_filters(df, [FilterSpec("year", [2019, 2022], "in")])) == [2019, 2022]
    assert apply_row_filters(df, [FilterSpec("year", [], "in")]).count() == 0
    assert _years(apply_row_filters(df, [FilterSpec("brand", "2", "contains")])) == [2020]
    # contains is a literal substring: regex characters have no meaning
    assert apply_row_filters(df, [FilterSpec("brand", "b.", "contains")]).count() == 0


def test_none_value_matches_nothing(df):
    assert apply_row_filters(df, [FilterSpec("brand", None)]).count() == 0


def test_string_year_rejects_int_value(spark):
    s = spark.createDataFrame([("2023", "A")], "year string, category string")
    with pytest.raises(ValueError, match="Type mismatch"):
        apply_row_filters(s, [FilterSpec("year", 2023)])


def test_missing_column_is_an_error(df):
    with pytest.raises(ValueError, match="Unknown"):
        apply_row_filters(df, [FilterSpec("Year", 2020)])  # case-sensitive


def test_strict_global_filters(df):
    assert _years(apply_filters(df, year=2020, category="A")) == [2020]
    assert apply_filters(df).count() == 4
    with pytest.raises(ValueError, match="year must be an int"):
        apply_filters(df, year="2020")
    no_brand = df.drop("brand")
    with pytest.raises(ValueError, match="Unknown"):
        apply_filters(no_brand, brand="b1")


def test_lenient_filter_set_is_immutable_and_skips_absent_columns(df):
    f0 = GlobalFilters()
    f1 = f0.set_filter("year", 2020).set_filter("channel", "web")
    assert f0.get_filters() == {}
    assert f1.get_filters() == {"year": 2020, "channel": "web"}
    assert _years(f1.apply_to_dataframe(df)) == [2020, 2020]
    f2 = f1.clear_filter("year")
    assert f2.apply_to_dataframe(df).count() == 4
    assert f1.clear_all().get_filters() == {}
    copy = f1.get_filters()
    copy["year"] = 1
    assert f1.get_filters()["year"] == 2020


def test_permitted_filters(df):
    view = ViewConfig(filters=("year",))
    check_permitted(view, {"year": 2020})
    with pytest.raises(ValueError, match="not permitted"):
        check_permitted(view, {"brand": "b1"})


def test_filter_on_group_key_is_pushed_below_aggregate(spark, sf_small):
    from kpimart.config import AggregationSpec
    from kpimart.operators.aggregate import aggregate
    from kpimart.plans import marts

    fact = marts.sales_fact(spark, sf_small)
    agg = aggregate(fact, [AggregationSpec("sales", "sum", "total")], ["category"])
    out = apply_row_filters(agg, [FilterSpec("category", "PROMO")])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p_type,PROMO)" in plan  # reaches the Parquet scan of part


def test_datetime_column_filters(spark):
    import datetime as dt

    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1, 10), 1), (dt.datetime(2024, 3, 1, 0), 2)], "ts timestamp_ntz, n int"
    )
    got = apply_row_filters(df, [FilterSpec("ts", dt.datetime(2024, 2, 1), ">=")])
    assert [r.n for r in got.collect()] == [2]
    got = apply_row_filters(df, [FilterSpec("ts", "2024-02-01", "<")])
    assert [r.n for r in got.collect()] == [1]
    with pytest.raises(ValueError, match="Type mismatch"):
        apply_row_filters(df, [FilterSpec("ts", 2024)])


def test_empty_filter_list_keeps_every_row(df):
    assert apply_row_filters(df, []).count() == 4
