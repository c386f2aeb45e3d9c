"""AGG-1..11 and the semantics contract (null sums, NaN, counts, empties)."""

import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpimart.config import AggregationSpec
from kpimart.operators.aggregate import aggregate

SCHEMA = T.StructType(
    [
        T.StructField("k", T.StringType()),
        T.StructField("v", T.DoubleType()),
        T.StructField("d", T.DecimalType(18, 2)),
        T.StructField("s", T.StringType()),
    ]
)


def _specs(*triples):
    return [AggregationSpec(*t) for t in triples]


def _rows(df, key="k"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_null_group_and_null_key(spark):
    df = spark.createDataFrame(
        [("a", None, None, "x"), ("a", None, None, "y"), ("b", 1.0, Decimal("1"), "z"), (None, 2.0, Decimal("2"), "w")], SCHEMA
    )
    out = _rows(aggregate(df, _specs(("v", "sum"), ("v", "mean"), ("v", "min"), ("v", "max"), ("v", "count")), ["k"]))
    assert out["a"]["sum_v"] == 0.0  # sum of an all-null group is 0
    assert out["a"]["mean_v"] is None and out["a"]["min_v"] is None and out["a"]["max_v"] is None
    assert out["a"]["count_v"] == 2  # count counts rows, nulls included
    assert None in out and out[None]["sum_v"] == 2.0  # null key forms a group


def test_decimal_sum_keeps_type_and_zero(spark):
    df = spark.createDataFrame([("a", None, None, "x")], SCHEMA)
    res = aggregate(df, _specs(("d", "sum")), ["k"])
    assert isinstance(res.schema["sum_d"].dataType, T.DecimalType)
    assert float(res.first()["sum_d"]) == 0.0


def test_nan_ignored_by_min_max(spark):
    df = spark.createDataFrame([("a", float("nan"), None, "x"), ("a", 3.0, None, "x"), ("a", 1.0, None, "x")], SCHEMA)
    r = aggregate(df, _specs(("v", "min"), ("v", "max")), ["k"]).first()
    assert r["min_v"] == 1.0 and r["max_v"] == 3.0


def test_all_nan_gives_null(spark):
    df = spark.createDataFrame([("a", float("nan"), None, "x")], SCHEMA)
    r = aggregate(df, _specs(("v", "max"),), ["k"]).first()
    assert r["max_v"] is None


def test_empty_frame_global_gives_one_row_grouped_gives_none(spark):
    df = spark.createDataFrame([], SCHEMA)
    g = aggregate(df, _specs(("v", "sum"), ("v", "count"), ("v", "max")), [])
    rows = g.collect()
    assert len(rows) == 1 and rows[0]["sum_v"] == 0.0 and rows[0]["count_v"] == 0 and rows[0]["max_v"] is None
    assert aggregate(df, _specs(("v", "sum"),), ["k"]).count() == 0


def test_count_on_missing_column_works(spark):
    df = spark.createDataFrame([("a", 1.0, None, "x"), ("a", 2.0, None, "x")], SCHEMA)
    r = aggregate(df, _specs(("nope", "count"),), ["k"]).first()
    assert r["count_nope"] == 2


def test_sum_of_string_rejected_at_build_time(spark):
    df = spark.createDataFrame([("a", 1.0, None, "x")], SCHEMA)
    with pytest.raises(ValueError, match="numeric"):
        aggregate(df, _specs(("s", "sum"),), ["k"])


def test_unknown_column_rejected(spark):
    df = spark.createDataFrame([("a", 1.0, None, "x")], SCHEMA)
    with pytest.raises(ValueError, match="Unknown"):
        aggregate(df, _specs(("V", "sum"),), ["k"])  # case-sensitive


def test_passthrough_and_keys_only(spark):
    df = spark.createDataFrame([("a", 1.0, None, "x"), ("a", 2.0, None, "x"), ("b", 2.0, None, "y")], SCHEMA)
    assert aggregate(df, None, ["k"]).count() == 3  # no aggregations key: unchanged
    keys = aggregate(df, [], ["k", "s"])
    assert sorted((r.k, r.s) for r in keys.collect()) == [("a", "x"), ("b", "y")]


def test_decimal_mean_is_exact_sum_over_count(spark):
    df = spark.createDataFrame([("a", None, Decimal("0.1"), "x"), ("a", None, Decimal("0.2"), "x"), ("a", None, None, "x")], SCHEMA)
    r = aggregate(df, _specs(("d", "mean"),), ["k"]).first()
    assert r["mean_d"] == 0.3 / 2  # exact decimal sum 0.30, one division; the null is not counted
    assert math.isclose(r["mean_d"], 0.15)


def test_many_keys_many_measures_one_pass(spark):
    df = spark.createDataFrame([("a", 1.0, Decimal("1"), "x"), ("a", 2.0, Decimal("2"), "y"), ("b", 3.0, Decimal("3"), "x")], SCHEMA)
    out = aggregate(df, _specs(("v", "sum"), ("d", "max"), ("v", "count", "n")), ["k", "s"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # partial + final around one shuffle
    assert out.count() == 3


def test_sum_type_rule_matches_spark(spark):
    from kpimart.functions.columns import sum_type

    df = spark.createDataFrame([], "a int, b bigint, c decimal(18,2), d decimal(35,4), e float, f double, g smallint")
    for f in df.schema.fields:
        spark_type = df.select(F.sum(f.name).alias("s")).schema["s"].dataType
        assert sum_type(f.dataType) == spark_type, f.name
