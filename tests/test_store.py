"""SNK-1..7: snapshot store and JSON codec."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kpimart.sinks.codec import from_json_lines, to_json_lines
from kpimart.sinks.store import SnapshotStore


@pytest.fixture()
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "store"))


def test_never_saved_is_none_and_ensure_is_idempotent(store):
    store.ensure().ensure()
    assert store.get(1) is None
    assert store.manifest().count() == 0


def test_second_save_replaces_first(spark, store):
    a = spark.createDataFrame([("x", 1)], "k string, n long")
    b = spark.createDataFrame([("y", 2), ("z", 3)], "k string, n long")
    store.save(5, a)
    info = store.save(5, b)
    assert info.row_count == 2
    assert sorted(r.k for r in store.get(5).collect()) == ["y", "z"]
    # superseded snapshot folder pruned, manifest keeps both rows
    assert store.manifest().where("dashboard_id = 5").count() == 2


def test_empty_result_is_a_real_snapshot(spark, store):
    store.save(1, spark.createDataFrame([("x", 1)], "k string, n long"))
    store.save(1, spark.createDataFrame([], "k string, n long"))
    got = store.get(1)
    assert got is not None and got.count() == 0 and got.columns == ["k", "n"]


def test_dashboards_keep_their_own_schemas(spark, store):
    store.save(1, spark.createDataFrame([("x", 1)], "k string, n long"))
    store.save(2, spark.createDataFrame([(1.5,)], "v double"))
    assert store.get(1).columns == ["k", "n"] and store.get(2).columns == ["v"]


def test_replayed_snapshot_overwrites_itself(spark, store):
    t = dt.datetime(2024, 1, 1)
    store.save(3, spark.createDataFrame([(1,)], "n long"), snapshot_id="batch-1", created_at=t)
    store.save(3, spark.createDataFrame([(2,), (3,)], "n long"), snapshot_id="batch-1", created_at=t)
    assert store.manifest().where("dashboard_id = 3").count() == 1
    assert sorted(r.n for r in store.get(3).collect()) == [2, 3]


def test_saving_twice_equals_saving_once(spark, store):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")
    store.save(9, df)
    once = sorted(store.get(9).collect())
    store.save(9, df)
    assert sorted(store.get(9).collect()) == once


def test_compact_manifest(spark, store):
    for i in range(4):
        store.save(i, spark.createDataFrame([(i,)], "n long"))
    before = sorted(store.current().select("dashboard_id", "snapshot_id").collect())
    assert store.compact_manifest(max_entries=2)
    assert sorted(store.current().select("dashboard_id", "snapshot_id").collect()) == before


def test_json_lines_round_trip_keeps_nulls(spark):
    df = spark.createDataFrame([("a", None), (None, 2.5)], "k string, v double")
    js = to_json_lines(df)
    assert sorted(r.json for r in js.collect()) == ['{"k":"a","v":null}', '{"k":null,"v":2.5}']
    back = from_json_lines(js, df.schema)
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)


def test_current_picks_latest_per_dashboard(spark, store):
    store.save(1, spark.createDataFrame([(1,)], "n long"), created_at=dt.datetime(2024, 1, 1), prune=False)
    store.save(1, spark.createDataFrame([(2,)], "n long"), created_at=dt.datetime(2024, 1, 2), prune=False)
    cur = store.current().collect()
    assert len(cur) == 1 and cur[0].row_count == 1
    assert store.get(1).first().n == 2
    assert store.current().where(F.col("dashboard_id") == 1).first().created_at == dt.datetime(2024, 1, 2)


def test_prune_keeps_current_and_previous_and_vacuum_clears_the_rest(spark, store, tmp_path):
    import os

    for i in range(4):
        store.save(8, spark.createDataFrame([(i,)], "n long"), created_at=dt.datetime(2024, 1, 1 + i))
    folders = os.listdir(tmp_path / "store" / "data" / "dashboard_id=8")
    assert len(folders) == 2  # current + previous
    assert store.get(8).first().n == 3
    assert store.vacuum(retain=1) == 1
    assert len(os.listdir(tmp_path / "store" / "data" / "dashboard_id=8")) == 1
    assert store.get(8).first().n == 3


def test_vacuum_keeps_family_batches_in_use(spark, store, tmp_path):
    import os

    from kpimart.config import PipelineConfig
    from kpimart.plans.families import fan_out_grouped

    df = spark.createDataFrame([("r1", 1.0), ("r2", 2.0)], "region string, v double")
    cfg = lambda r: PipelineConfig.from_dict({"filters": [{"column": "region", "value": r}], "aggregations": [{"column": "v", "operation": "sum", "alias": "s"}]})
    fan_out_grouped(df, {1: cfg("r1"), 2: cfg("r2")}, store, snapshot_id="first").collect()
    fan_out_grouped(df, {1: cfg("r1"), 2: cfg("r2")}, store, snapshot_id="second").collect()
    assert store.vacuum(retain=1) >= 2  # both members' folders of the first run
    files = [f for d, _, names in os.walk(tmp_path / "store" / "batches") for f in names if f.startswith("part-")]
    assert len(files) == 2
    assert store.get(2).first().s == 2.0


def test_compaction_is_an_explicit_call(spark, tmp_path):
    import os

    store = SnapshotStore(spark, str(tmp_path / "auto"))
    for i in range(6):
        store.save(i % 2, spark.createDataFrame([(i,)], "n long"), created_at=dt.datetime(2024, 1, 1 + i))
    assert len(os.listdir(tmp_path / "auto" / "_manifest")) == 7  # no entry goes by itself
    assert store.compact_manifest(max_entries=3)
    assert len(os.listdir(tmp_path / "auto" / "_manifest")) == 1
    assert store.manifest().count() == 6
    assert store.get(0).first().n == 4 and store.get(1).first().n == 5


def test_a_replayed_save_writes_anew_and_keeps_the_old_data_until_then(spark, store):
    first = store.save(5, spark.createDataFrame([(1,)], "n long"), snapshot_id="batch-0", prune=False)
    read_before = store.get(5)
    again = store.save(5, spark.createDataFrame([(1,)], "n long"), snapshot_id="batch-0", prune=False)
    assert first.path != again.path and read_before.first().n == 1
    assert store.manifest().where("dashboard_id = 5").count() == 1
    assert store.latest_info(5).path == again.path
    assert store.vacuum(retain=1) == 1 and store.get(5).first().n == 1


def test_many_snapshots_are_read_by_the_manifest(spark, tmp_path):
    from kpimart.plans.families import fan_out_table

    store = SnapshotStore(spark, str(tmp_path / "a b%"))
    assert store.read_many(spark.range(3).toDF("dashboard_id")) is None
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, x int")
    count = '{"aggregations": [{"column": "x", "operation": "count", "alias": "n"}], "group_by": ["k"]'
    own = ', "filters": [{"column": "k", "value": "%s"}]}'
    boards = [(1, count + own % "a"), (2, count + own % "b"), (3, count + own % "none"), (4, count + "}"), (5, count + "}")]
    boards = spark.createDataFrame(boards, "dashboard_id long, config string")
    fan_out_table(df, boards, store, "one", stage_input=False)
    store.save(6, df)
    got = store.read_many(spark.createDataFrame([(i,) for i in (1, 1, 2, 3, 4, 6, 99)], "dashboard_id int")).collect()
    rows = sorted((r.dashboard_id, r.k, r.n, r.x) for r in got if r.dashboard_id != 6)
    assert rows == [(1, "a", 1, None), (2, "b", 2, None), (4, "a", 1, None), (4, "b", 2, None)]
    assert sorted(r.x for r in got if r.dashboard_id == 6) == [1, 2, 3]


def test_family_folders_go_with_their_last_user(spark, tmp_path):
    from kpimart.plans.families import fan_out_table

    store = SnapshotStore(spark, str(tmp_path))
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int")
    own = '{"aggregations": [], "group_by": ["k"], "filters": [{"column": "k", "value": "%s"}]}'
    boards = spark.createDataFrame([(1, own % "a"), (2, own % "b")], "dashboard_id long, config string")

    def folders():
        return {r[0] for r in store.manifest().selectExpr("regexp_extract(path, '/batches/([^-]+)', 1)").distinct().collect() if any(
            p.name.startswith(r[0] + "-") and not p.name.startswith(f"{r[0]}-empty") for p in (tmp_path / "batches").iterdir())}

    for name in ("one", "two", "three"):
        fan_out_table(df, boards, store, name, stage_input=False)
    assert folders() == {"two", "three"}
    # dashboard 2 stays on an older snapshot: its folder stays
    fan_out_table(df, boards.where("dashboard_id = 1"), store, "four", stage_input=False, retain=1)
    assert folders() == {"three", "four"}
    assert [r.k for r in store.get(2).collect()] == ["b"] and [r.k for r in store.get(1).collect()] == ["a"]
