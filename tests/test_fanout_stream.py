"""AGG-12, PIP-1..6, STR-1, SNK-7: fan-out, upload flow, file stream."""

import gzip
import os
import time

import pytest

from kpimart.config import PipelineConfig
from kpimart.plans.fanout import fan_out, get_data, records_processed, results_frame, trigger_processing, upload
from kpimart.plans.processing import apply_transformations, run
from kpimart.sinks.store import SnapshotStore
from kpimart.streaming.upload import upload_stream

CSV_SCHEMA = "cat string, year int, sales double"


def _gz(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt") as f:
        f.write(text)
    return str(path)


def _sum_by(key):
    return PipelineConfig.from_dict(
        {"aggregations": [{"column": "sales", "operation": "sum", "alias": "total"}], "group_by": [key]}
    )


def test_fan_out_reports_each_dashboard_and_survives_a_failure(spark, tmp_path):
    df = spark.createDataFrame([("a", 2020, 1.0), ("a", 2021, 2.0), ("b", 2020, 3.0)], CSV_SCHEMA)
    store = SnapshotStore(spark, str(tmp_path / "store"))
    configs = {
        1: _sum_by("cat"),
        2: _sum_by("year"),
        3: PipelineConfig.from_dict({"filters": [{"column": "nope", "value": 1}]}),  # fails at plan time
        4: {"aggregations": [{"column": "sales", "operation": "median"}]},  # fails at parse time
    }
    res = {r.dashboard_id: r for r in fan_out(df, configs, store)}
    assert res[1].status == "ok" and res[1].rows == 2
    assert res[2].status == "ok" and res[2].rows == 2
    assert res[3].status == "error" and "nope" in res[3].error
    assert res[4].status == "error" and "median" in res[4].error
    assert records_processed(list(res.values())) == 4
    assert results_frame(spark, list(res.values())).count() == 4
    assert sorted((r.cat, r.total) for r in store.get(1).collect()) == [("a", 3.0), ("b", 3.0)]


def test_raw_and_stored_reads_agree_on_key_filters(spark, tmp_path):
    df = spark.createDataFrame([("a", 2020, 1.0), ("a", 2021, 2.0), ("b", 2020, 3.0)], CSV_SCHEMA)
    store = SnapshotStore(spark, str(tmp_path / "store"))
    cfg = _sum_by("cat")
    store.save(1, run(df, cfg))
    stored = get_data(store, 1, {"cat": "a"})
    raw = get_data(store, 1, {"cat": "a"}, mode="raw", source=df, config=cfg)
    assert sorted(stored.collect()) == sorted(raw.collect())
    assert get_data(store, 42, {"cat": "a"}).collect() == []  # unknown dashboard: an empty result


def test_transform_only(spark):
    df = spark.createDataFrame([("a", 2020, 1.0), ("b", 2021, 2.0)], CSV_SCHEMA)
    cfg = {"filters": [{"column": "year", "value": 2021}], "computed_fields": [{"name": "s2", "expression": "sales * 2"}]}
    assert [r.s2 for r in apply_transformations(df, cfg).collect()] == [4.0]


def test_upload_flow_respects_the_role_gate(spark, tmp_path):
    path = _gz(tmp_path / "in" / "u.csv.gz", "cat,year,sales\na,2020,1.5\nb,2020,2.5\n")
    users = spark.createDataFrame([(1, "editor"), (2, "viewer")], "user_id long, role string")
    cfg = '{"pipeline": {"aggregations": [{"column": "sales", "operation": "sum", "alias": "total"}], "group_by": ["cat"]}}'
    dashboards = spark.createDataFrame([(10, "d", cfg, 1), (11, "e", cfg, 2)], "dashboard_id long, name string, config string, owner_id long")
    access = spark.createDataFrame([(1, 11)], "user_id long, dashboard_id long")
    store = SnapshotStore(spark, str(tmp_path / "store"))
    res = upload(spark, path, 1, users, dashboards, access, store, CSV_SCHEMA).collect()
    assert sorted(r.dashboard_id for r in res) == [10, 11]
    res_viewer = upload(spark, path, 2, users, dashboards, access, SnapshotStore(spark, str(tmp_path / "s2")), CSV_SCHEMA)
    assert res_viewer.collect() == []  # a viewer may not recompute, not even its own dashboard
    one = trigger_processing(spark, path, 10, dashboards, store, CSV_SCHEMA)
    assert one.status == "ok" and one.rows == 2
    assert trigger_processing(spark, path, 99, dashboards, store, CSV_SCHEMA).status == "error"


def test_stream_newest_file_wins(spark, tmp_path):
    incoming = tmp_path / "incoming"
    _gz(incoming / "first.csv.gz", "cat,year,sales\na,2020,1.0\n")
    time.sleep(1.1)
    second = _gz(incoming / "second.csv.gz", "cat,year,sales\nb,2020,5.0\nb,2021,6.0\n")
    os.utime(second)
    store = SnapshotStore(spark, str(tmp_path / "store"))
    q = upload_stream(spark, str(incoming), CSV_SCHEMA, {1: _sum_by("cat"), 2: _sum_by("year")}, store,
                      str(tmp_path / "cp"), name="t_stream", clean_source=True)
    q.awaitTermination()
    assert sorted((r.cat, r.total) for r in store.get(1).collect()) == [("b", 11.0)]
    assert sorted(r.year for r in store.get(2).collect()) == [2020, 2021]
    ids = sorted(r.snapshot_id for r in store.manifest().where("dashboard_id = 1").collect())
    assert ids == ["t_stream-000000000000", "t_stream-000000000001"]
    # consumed files are removed (SNK-7)
    assert not (incoming / "first.csv.gz").exists()
    assert not (incoming / "second.csv.gz").exists()


def test_stream_backlog_in_one_batch_keeps_only_the_newest_file(spark, tmp_path):
    incoming = tmp_path / "incoming"
    _gz(incoming / "a.csv.gz", "cat,year,sales\na,2020,1.0\n")
    time.sleep(1.1)
    _gz(incoming / "b.csv.gz", "cat,year,sales\nb,2020,2.0\n")
    time.sleep(1.1)
    _gz(incoming / "c.csv.gz", "cat,year,sales\nc,2020,3.0\nc,2021,4.0\n")
    store = SnapshotStore(spark, str(tmp_path / "store"))
    q = upload_stream(spark, str(incoming), CSV_SCHEMA, {1: _sum_by("cat")}, store, str(tmp_path / "cp"),
                      name="t_backlog", latest_only=True)
    q.awaitTermination()
    assert sorted((r.cat, r.total) for r in store.get(1).collect()) == [("c", 7.0)]
    assert [r.snapshot_id for r in store.manifest().collect()] == ["t_backlog-000000000000"]  # one batch


def test_retrieval_with_filters_matching_nothing_is_empty_not_none(spark, tmp_path):
    df = spark.createDataFrame([("a", 2020, 1.0)], CSV_SCHEMA)
    store = SnapshotStore(spark, str(tmp_path / "store"))
    store.save(1, run(df, _sum_by("cat")))
    got = get_data(store, 1, {"cat": "zzz"})
    assert got is not None and got.count() == 0 and got.columns == ["cat", "total"]
    assert get_data(store, 1).count() == 1  # without filters


def test_stream_with_the_dashboards_table(spark, tmp_path):
    import json

    incoming = tmp_path / "incoming"
    _gz(incoming / "u.csv.gz", "cat,year,sales\na,2020,1.0\nb,2020,2.0\nb,2021,4.0\n")
    conf = lambda c: json.dumps({"pipeline": {"filters": [{"column": "cat", "value": c}],
                                              "aggregations": [{"column": "sales", "operation": "sum", "alias": "s"}]}})
    dashboards = spark.createDataFrame([(1, conf("a")), (2, conf("b"))], "dashboard_id long, config string")
    store = SnapshotStore(spark, str(tmp_path / "store"))
    q = upload_stream(spark, str(incoming), CSV_SCHEMA, dashboards, store, str(tmp_path / "cp"), name="t_table")
    q.awaitTermination()
    assert store.get(1).first().s == 1.0 and store.get(2).first().s == 6.0


def test_stream_with_a_processing_time_trigger(spark, tmp_path):
    incoming = tmp_path / "incoming"
    _gz(incoming / "u.csv.gz", "cat,year,sales\na,2020,1.0\na,2021,2.0\n")
    store = SnapshotStore(spark, str(tmp_path / "store"))
    q = upload_stream(spark, str(incoming), CSV_SCHEMA, {1: _sum_by("cat")}, store, str(tmp_path / "cp"),
                      name="t_continuous", available_now=False, processing_time="1 second")
    try:
        q.processAllAvailable()
        assert store.get(1).first().total == 3.0
    finally:
        q.stop()
    assert not q.isActive


def test_upload_admits_by_name_and_size_and_removes_its_input(spark, tmp_path):
    users = spark.createDataFrame([(1, "editor")], "user_id long, role string")
    cfg = '{"pipeline": {"aggregations": [{"column": "sales", "operation": "sum", "alias": "total"}]}}'
    boards = spark.createDataFrame([(10, "d", cfg, 1)], "dashboard_id long, name string, config string, owner_id long")
    access = spark.createDataFrame([], "user_id long, dashboard_id long")
    store = SnapshotStore(spark, str(tmp_path / "store"))
    args = (1, users, boards, access, store, CSV_SCHEMA)
    plain = tmp_path / "in" / "u.csv"
    path = _gz(tmp_path / "in" / "u.csv.gz", "cat,year,sales\na,2020,1.5\n")
    plain.write_text("cat,year,sales\na,2020,1.5\n")
    with pytest.raises(ValueError, match="Only"):
        upload(spark, str(plain), *args)
    with pytest.raises(ValueError, match="larger"):
        upload(spark, path, *args, max_bytes=3, clean_source=True)
    assert not os.path.exists(path)  # removed on error too
    path = _gz(tmp_path / "in" / "v.csv.gz", "cat,year,sales\na,2020,1.5\n")
    assert [r.status for r in upload(spark, path, *args, clean_source=True).collect()] == ["ok"]
    assert not os.path.exists(path) and store.get(10).first().total == 1.5


def test_stream_binds_columns_by_name_and_touches_entitled_dashboards_only(spark, tmp_path):
    incoming = tmp_path / "incoming"
    _gz(incoming / "u.csv.gz", "sales,extra,year,cat\n1.0,x,2020,a\n2.0,y,2021,a\n")
    cfg = '{"pipeline": {"aggregations": [{"column": "sales", "operation": "sum", "alias": "total"}], "group_by": ["cat"]}}'
    boards = spark.createDataFrame([(1, cfg, 7), (2, cfg, 8)], "dashboard_id long, config string, owner_id long")
    users = spark.createDataFrame([(7, "editor"), (8, "editor")], "user_id long, role string")
    access = spark.createDataFrame([], "user_id long, dashboard_id long")
    store = SnapshotStore(spark, str(tmp_path / "store"))
    q = upload_stream(spark, str(incoming), CSV_SCHEMA, boards, store, str(tmp_path / "cp"), name="t_named", uploader=(7, users, access))
    q.awaitTermination()
    assert [(r.cat, r.total) for r in store.get(1).collect()] == [("a", 3.0)]
    assert store.get(2) is None
