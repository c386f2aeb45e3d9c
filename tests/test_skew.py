"""A key holding a third of all rows: results stay exact and whole, and the
hot key is combined map-side (partial aggregate before the shuffle)."""

import pytest
from pyspark.sql import functions as F

from kpimart.config import AggregationSpec, PipelineConfig
from kpimart.operators.aggregate import aggregate
from kpimart.operators.latest import latest_per_key
from kpimart.operators.metrics import share_of_parent
from kpimart.plans.families import fan_out_grouped
from kpimart.sinks.store import SnapshotStore

N = 30_000


@pytest.fixture(scope="module")
def skewed(spark):
    # key "hot" holds every third row; the rest spread over 1000 keys
    ids = spark.range(N)
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 1000).cast("string")))
    return ids.select(
        key.alias("k"),
        (F.col("id") % 7).cast("double").alias("v"),
        F.col("id").alias("ts"),
        F.col("id").alias("event_id"),
    ).repartition(8)


def test_hot_key_aggregate_is_exact_and_combined_map_side(skewed):
    out = aggregate(skewed, [AggregationSpec("v", "sum"), AggregationSpec("v", "count", "n")], ["k"])
    rows = {r.k: r for r in out.collect()}
    assert rows["hot"].n == N // 3
    assert rows["hot"].sum_v == float(sum(i % 7 for i in range(0, N, 3)))
    assert sum(r.n for r in rows.values()) == N  # nothing dropped
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_sum") > plan.index("Exchange hashpartitioning")  # partial below the shuffle


def test_hot_key_latest_and_parent_share(skewed):
    latest = {r.k: r for r in latest_per_key(skewed, ["k"], "ts", ["v"], tiebreak="event_id").collect()}
    top = max(range(0, N, 3))
    assert latest["hot"].ts == top and latest["hot"].v == float(top % 7)
    shares = share_of_parent(skewed.withColumn("p", F.lit("all")), "v", ["p"])
    assert shares.agg(F.sum("share")).first()[0] == pytest.approx(100.0)
    assert shares.count() == N


def test_many_dashboards_on_the_hot_value(spark, skewed, tmp_path):
    cfg = lambda key: PipelineConfig.from_dict(
        {"filters": [{"column": "k", "value": key}], "aggregations": [{"column": "v", "operation": "sum", "alias": "s"}]}
    )
    configs = {i: cfg("hot") for i in range(20)}
    configs[99] = cfg("k1")
    store = SnapshotStore(spark, str(tmp_path / "store"))
    status = fan_out_grouped(skewed, configs, store).collect()
    assert all(r.status == "ok" for r in status)
    hot_sum = float(sum(i % 7 for i in range(0, N, 3)))
    assert {store.get(i).first().s for i in range(20)} == {hot_sum}
