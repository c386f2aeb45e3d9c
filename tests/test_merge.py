"""Text extremes in two levels, mergeable metrics, inner aggregates of families."""

import json
import random
from decimal import Decimal

import pyarrow.compute as pc
import pytest

from kpimart.functions.registry import MergeableMetric, register_mergeable, unregister_aggregate
from kpimart.operators import mergeable
from kpimart.operators.aggregate import aggregate
from kpimart.plans.families import fan_out_grouped, fan_out_table
from kpimart.plans.processing import run
from kpimart.sinks.store import SnapshotStore

ROWS = "k string, g int, s string, x int, d decimal(10,2), f double"


def _rows(n, seed=1):
    rng = random.Random(seed)
    pick = lambda *v: rng.choice(v)
    return [
        (pick("hot", "hot", "hot", "b", None), pick(1, 2, None), pick("é", "z", "", "a", None), pick(3, -5, None, 7),
         pick(None, Decimal("1.25"), Decimal(2)), pick(float("nan"), 1.5, None, -0.5))
        for _ in range(n)
    ]


SPECS = [
    {"column": "s", "operation": "min", "alias": "lo"}, {"column": "s", "operation": "max", "alias": "hi"},
    {"column": "x", "operation": "sum", "alias": "sx"}, {"column": "x", "operation": "mean", "alias": "mx"},
    {"column": "d", "operation": "sum", "alias": "sd"}, {"column": "d", "operation": "mean", "alias": "md"},
    {"column": "f", "operation": "min", "alias": "nf"}, {"column": "f", "operation": "max", "alias": "xf"},
    {"column": "", "operation": "count", "alias": "n"},
]


@pytest.mark.parametrize(("keys", "n"), [((), 0), ((), 200), (("k",), 200), (("k", "g"), 200), (("s",), 200)])
def test_text_extremes_equal_plain_aggregates(spark, keys, n):
    df = spark.createDataFrame(_rows(n), ROWS).repartition(4)
    got = aggregate(df, SPECS, keys)
    plain = [
        aggregate(df, [s], keys).withColumnRenamed(s["alias"], "v") for s in SPECS
        if s["column"] != "s"
    ]
    whole = sorted((tuple(r) for r in got.collect()), key=repr)
    at = len(keys)
    for spec, one in zip([s for s in SPECS if s["column"] != "s"], plain):
        i = at + SPECS.index(spec)
        assert sorted(((*r[:at], r[i]) for r in whole), key=repr) == sorted((tuple(r) for r in one.collect()), key=repr)
        assert got.schema.fields[i].dataType == one.schema["v"].dataType
    df.createOrReplaceTempView("text_rows")
    named = "".join(f"{k}, " for k in keys)
    text = spark.sql(f"select {named} min(s), max(s) from text_rows {'group by ' + ', '.join(keys) if keys else ''}")
    assert sorted((r[: at + 2] for r in whole), key=repr) == sorted((tuple(r) for r in text.collect()), key=repr)


def test_no_sort_of_rows_for_a_text_extreme(spark):
    df = spark.range(1000).selectExpr("id % 5 k", "cast(id % 3 as string) s")
    out = aggregate(df, [{"column": "s", "operation": "min"}, {"column": "", "operation": "count", "alias": "n"}], ["k"])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    below = plan[plan.rindex("Exchange") :]  # what runs before the first shuffle
    assert "HashAggregate" in below and "Sort" not in below


@pytest.fixture
def spread():
    """The difference of the greatest and the least value."""
    ends = lambda v: [pc.min(v).as_py(), pc.max(v).as_py()]

    def merge(a, b):
        lows, highs = ([s[i] for s in (a, b) if s[i] is not None] for i in (0, 1))
        return [min(lows, default=None), max(highs, default=None)]

    register_mergeable("spread", MergeableMetric("array<bigint>", "bigint", ends, merge, lambda s: None if s[0] is None else s[1] - s[0]))
    yield "spread"
    unregister_aggregate("spread")


@pytest.mark.parametrize(("keys", "held"), [((), 4096), (("k",), 1), (("k", "g"), 1), (("f",), 4096)])
def test_mergeable_metric_equals_native(spark, spread, monkeypatch, keys, held):
    monkeypatch.setattr(mergeable, "HELD_GROUPS", held)
    for n in (0, 300) if not keys else (300,):
        df = spark.createDataFrame(_rows(n, 2), ROWS).repartition(5)
        specs = [{"column": "x", "operation": spread, "alias": "sp"}, {"column": "s", "operation": "max", "alias": "hi"}]
        got = aggregate(df, specs, keys)
        assert got.columns == [*keys, "sp", "hi"]
        df.createOrReplaceTempView("spread_rows")
        named = "".join(f"{k}, " for k in keys)
        want = spark.sql(f"select {named} cast(max(x) - min(x) as bigint), max(s) from spread_rows {'group by ' + ', '.join(keys) if keys else ''}")
        # as text: NaN is a key
        assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r)) for r in want.collect())


def test_mergeable_metric_in_a_family(spark, spread, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 9), ("b", 4), (None, 2)], "k string, x int")
    config = lambda v, by: {"filters": [{"column": "k", "op": "in", "value": v}], "group_by": by,
                            "aggregations": [{"column": "x", "operation": spread, "alias": "sp"}]}
    store = SnapshotStore(spark, str(tmp_path))
    status = fan_out_grouped(df, {1: config(["a"], []), 2: config(["a", "b"], []), 3: config(["c"], []), 4: config(["a", "b"], ["k"]), 5: config(["b"], ["k"])}, store)
    assert {r.status for r in status.collect()} == {"ok"}
    assert [store.get(i).first().sp for i in (1, 2, 3)] == [8, 8, None]
    assert sorted(map(tuple, store.get(4).collect())) == [("a", 8), ("b", 0)] and store.get(5).count() == 1


def test_unknown_name_and_charts_of_a_mergeable_metric(spark, spread):
    from kpimart.config import ChartConfig, PipelineConfig
    from kpimart.operators.charts import combined_datasets

    df = spark.createDataFrame(_rows(50), ROWS)
    charts = [
        (PipelineConfig.from_dict({"aggregations": [{"column": "x", "operation": spread, "alias": "v"}], "group_by": [k]}), ChartConfig("bar", k, "v"))
        for k in ("k", "g")
    ]
    assert {r.chart_id for r in combined_datasets(df, charts).collect()} == {0, 1}
    unregister_aggregate(spread)
    with pytest.raises(ValueError, match="Unknown aggregation"):
        aggregate(df, [{"column": "x", "operation": spread}], ["k"])


def _relative(own, over, **more):
    below = {"op": "-", "args": [{"agg": "max", "arg": {"op": "+", "args": [{"col": "x"}, {"lit": 1}]}, "over": over}, {"col": "x"}]}
    again = {"op": "-", "args": [{"col": "below"}, {"agg": "min", "arg": {"col": "below"}}]}
    return {
        "filters": own, "computed_fields": [{"name": "below", "expression": below}, {"name": "again", "expression": again}],
        "aggregations": [{"column": "again", "operation": "sum", "alias": "v"}, {"column": "", "operation": "count", "alias": "n"}], **more,
    }


@pytest.mark.parametrize(("over", "by"), [([], ["s"]), (["g"], [])])
def test_inner_aggregates_of_a_family_equal_single_runs(spark, tmp_path, over, by):
    df = spark.createDataFrame(_rows(300, 3), ROWS).repartition(4)
    rng = random.Random(4)
    boards = {
        i: _relative(
            [{"column": "k", "op": "in", "value": rng.sample(["hot", "b", "none"], rng.randrange(1, 4))},
             {"column": "x", "op": ">=", "value": rng.choice([-9, 0, 4, 99])}],
            over, group_by=by,
        )
        for i in range(8)
    }
    frame = spark.createDataFrame([(i, json.dumps(b)) for i, b in boards.items()], "dashboard_id long, config string")
    store = SnapshotStore(spark, str(tmp_path))
    status = fan_out_table(df, frame, store, stage_input=False)
    assert {r.status for r in status.collect()} == {"ok"}
    assert len({r.path.rsplit("/", 1)[0] for r in store.current().select("path").collect()}) <= 2  # one family
    for i, board in boards.items():
        want = sorted((tuple(r) for r in run(df, board).collect()), key=repr)
        assert sorted((tuple(r) for r in store.get(i).collect()), key=repr) == want, board
