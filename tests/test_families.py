"""Dashboard families (AGG-12 at scale): one job for many same-shape
dashboards must give exactly what running each dashboard alone gives."""

import pytest

from kpimart.config import PipelineConfig
from kpimart.plans.families import fan_out_grouped, plan_families
from kpimart.plans.processing import run
from kpimart.sinks.store import SnapshotStore

SCHEMA = "region string, cat string, year int, sales double"
ROWS = [("r1", "a", 2020, 1.0), ("r1", "b", 2020, 2.0), ("r2", "a", 2021, 3.0), ("r2", "a", 2020, None), (None, "a", 2020, 9.0)]


def _cfg(region, **extra):
    d = {"filters": [{"column": "region", "value": region}], **extra}
    return PipelineConfig.from_dict(d)


GROUPED = {"aggregations": [{"column": "sales", "operation": "sum", "alias": "s"}, {"column": "x", "operation": "count", "alias": "n"}], "group_by": ["cat"]}
GLOBAL = {"aggregations": [{"column": "sales", "operation": "sum", "alias": "s"}, {"column": "x", "operation": "count", "alias": "n"},
                           {"column": "sales", "operation": "max", "alias": "m"}]}


@pytest.fixture()
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def _check_same_as_alone(spark, df, configs, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    status = {r.dashboard_id: r for r in fan_out_grouped(df, configs, store).collect()}
    for dash_id, cfg in configs.items():
        assert status[dash_id].status == "ok", status[dash_id]
        alone = sorted(run(df, cfg).collect(), key=repr)
        got = store.get(dash_id)
        assert sorted(got.select(*run(df, cfg).columns).collect(), key=repr) == alone
        assert status[dash_id].rows == len(alone)


def test_grouped_family_equals_each_dashboard_alone(spark, df, tmp_path):
    configs = {1: _cfg("r1", **GROUPED), 2: _cfg("r2", **GROUPED), 3: _cfg("r9", **GROUPED), 4: _cfg("r1", **GROUPED)}
    fams, singles = plan_families(configs)
    assert len(fams) == 1 and not singles and fams[0].params == ("region",)
    _check_same_as_alone(spark, df, configs, tmp_path)


def test_global_family_gives_one_row_per_dashboard_even_when_empty(spark, df, tmp_path):
    configs = {1: _cfg("r1", **GLOBAL), 2: _cfg("r9", **GLOBAL)}
    _check_same_as_alone(spark, df, configs, tmp_path)
    store = SnapshotStore(spark, str(tmp_path / "s2"))
    fan_out_grouped(df, configs, store)
    empty = store.get(2).collect()
    assert len(empty) == 1 and empty[0].s == 0.0 and empty[0].n == 0 and empty[0].m is None


def test_passthrough_and_keys_only_families(spark, df, tmp_path):
    configs = {
        1: _cfg("r1"),
        2: _cfg("r2"),
        3: _cfg("r1", aggregations=[], group_by=["cat"]),
        4: _cfg("r2", aggregations=[], group_by=["cat"]),
    }
    _check_same_as_alone(spark, df, configs, tmp_path)


def test_identical_configs_and_singles(spark, df, tmp_path):
    computed = {"computed_fields": [{"name": "s2", "expression": {"op": "*", "args": [{"col": "sales"}, {"lit": 2}]}}],
                "aggregations": [{"column": "s2", "operation": "sum", "alias": "t"}], "group_by": ["year"]}
    inner_agg = {"computed_fields": [{"name": "m", "expression": {"agg": "max", "arg": {"col": "sales"}}}]}
    configs = {
        1: PipelineConfig.from_dict(computed),
        2: PipelineConfig.from_dict(computed),
        3: PipelineConfig.from_dict(inner_agg),
        4: _cfg("r1", **GROUPED),
    }
    fams, singles = plan_families(configs)
    assert [sorted(f.members) for f in fams] == [[1, 2]] and sorted(singles) == [3, 4]
    _check_same_as_alone(spark, df, configs, tmp_path)


def test_failures_are_reported_per_dashboard(spark, df, tmp_path):
    configs = {1: _cfg("r1", **GROUPED), 2: _cfg(5, **GROUPED), 3: {"aggregations": [{"column": "x", "operation": "median"}]}}
    store = SnapshotStore(spark, str(tmp_path / "store"))
    status = {r.dashboard_id: r for r in fan_out_grouped(df, configs, store).collect()}
    assert status[1].status == "ok" and store.get(1).count() == 2  # its family-mate's bad value does not stop it
    assert status[2].status == "error" and "Type mismatch" in status[2].error
    assert status[3].status == "error" and "median" in status[3].error


def test_family_plan_has_no_cartesian_product(spark, df):
    from kpimart.plans.families import run_family

    from kpimart.plans.families import members_frame

    for extra in (GROUPED, GLOBAL, {}):
        configs = {i: _cfg(f"r{i}", **extra) for i in range(1, 4)}
        fams, _ = plan_families(configs)
        fam = fams[0]
        out = run_family(df, fam.shape, fam.params, members_frame(df, fam))
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_identical_configs_share_one_snapshot(spark, df, tmp_path):
    cfg = PipelineConfig.from_dict(GROUPED)
    store = SnapshotStore(spark, str(tmp_path / "store"))
    fan_out_grouped(df, {1: cfg, 2: cfg, 3: cfg}, store).collect()
    paths = {r.path for r in store.current().collect()}
    assert len(paths) == 1
    assert sorted(store.get(2).collect(), key=repr) == sorted(run(df, cfg).collect(), key=repr)


def test_fan_out_table_plans_families_in_spark(spark, df, tmp_path):
    import json

    from kpimart.plans.families import config_shapes, fan_out_table

    def conf(d):
        return json.dumps({"pipeline": d})

    grouped = lambda r: conf({"filters": [{"column": "region", "value": r}], **GROUPED})
    rows = [
        (1, grouped("r1")),
        (2, grouped("r2")),
        (3, grouped("r9")),
        (4, conf({"filters": [{"column": "region", "value": 5}], **GROUPED})),  # number for a string column
        (5, "not json"),
        (6, json.dumps({"filters": ["year"], **GLOBAL})),  # flat form: a list of names is the view's
        (7, conf({"computed_fields": [{"name": "m", "expression": {"agg": "max", "arg": {"col": "sales"}}}]})),
        (8, conf({"aggregations": [{"column": "x", "operation": "median"}]})),
        (9, json.dumps({"filters": ["year"], **GLOBAL})),
    ]
    dashboards = spark.createDataFrame(rows, "dashboard_id long, config string")
    assert config_shapes(dashboards).where("not bad_json").select("shape").distinct().count() == 4  # 1-4, 6+9, 7, 8
    store = SnapshotStore(spark, str(tmp_path / "store"))
    status = {r.dashboard_id: r for r in fan_out_table(df, dashboards, store).collect()}
    assert sorted(status) == list(range(1, 10))
    for i, region in ((1, "r1"), (2, "r2"), (3, "r9")):
        assert status[i].status == "ok", status[i]
        want = sorted(run(df, _cfg(region, **GROUPED)).collect(), key=repr)
        assert sorted(store.get(i).collect(), key=repr) == want
    assert status[4].status == "error" and "Type mismatch for column region" in status[4].error
    assert status[5].status == "error" and "not valid JSON" in status[5].error
    assert status[6].status == "ok" and store.get(6).first().n == 5  # view filter names ignored
    assert store.current().where("dashboard_id in (6, 9)").select("path").distinct().count() == 1  # shared
    assert status[7].status == "ok" and store.get(7).count() == 5  # run on its own
    assert status[8].status == "error" and "median" in status[8].error


def test_many_shapes_with_manifest_compaction(spark, df, tmp_path):
    import json

    from kpimart.plans.families import fan_out_table

    rows = []
    for i, key in enumerate(["cat", "year", "region"] * 2):
        agg = {"column": "sales", "operation": "sum", "alias": f"s{i}"}
        rows.append((i, json.dumps({"pipeline": {"aggregations": [agg], "group_by": [key]}})))
    dashboards = spark.createDataFrame(rows, "dashboard_id long, config string")
    store = SnapshotStore(spark, str(tmp_path / "store"))
    status = fan_out_table(df, dashboards, store).collect()
    assert store.compact_manifest(max_entries=2)
    assert sorted(r.dashboard_id for r in status) == list(range(6)) and all(r.status == "ok" for r in status)
    assert store.current().count() == 6


def _board(**pipeline):
    import json

    return json.dumps({"pipeline": pipeline})


SUM = [{"column": "sales", "operation": "sum", "alias": "s"}]


def test_shapes_under_one_snapshot_id_do_not_touch_each_other(spark, df, tmp_path):
    from kpimart.plans.families import fan_out_table

    cats = sorted(r.cat for r in df.select("cat").distinct().collect() if r.cat is not None)[:2]
    boards = [
        *((i, _board(filters=[{"column": "cat", "value": c}], aggregations=SUM, group_by=["year"])) for i, c in enumerate(cats)),
        *((10 + i, _board(filters=[{"column": "cat", "value": c}], aggregations=SUM, group_by=["region"])) for i, c in enumerate(cats)),
        (20, _board(aggregations=SUM)),
        (21, _board(aggregations=SUM)),
    ]
    dashboards = spark.createDataFrame(boards, "dashboard_id long, config string")
    store = SnapshotStore(spark, str(tmp_path / "store"))
    for _ in range(2):  # a replay of the same snapshot id
        status = fan_out_table(df, dashboards, store, snapshot_id="run").collect()
        assert [r.status for r in status] == ["ok"] * 6
        for i, _ in boards:
            assert store.get(i).count() == store.latest_info(i).row_count > 0
    batch = store.read_batch("run")
    assert sorted(r.dashboard_id for r in batch.select("dashboard_id").distinct().collect()) == [0, 1, 10, 11]
    assert {"year", "region"} <= set(batch.columns)


def test_empty_family_fractional_value_and_missing_config(spark, df, tmp_path):
    from kpimart.plans.families import fan_out_grouped, fan_out_table

    year = df.first().year
    own = lambda v: _board(filters=[{"column": "year", "value": v}], aggregations=SUM, group_by=["cat"])
    boards = [(1, own(1)), (2, own(2)), (3, None), (4, "  "), (5, "{not json")]
    dashboards = spark.createDataFrame(boards, "dashboard_id long, config string")
    store = SnapshotStore(spark, str(tmp_path / "store"))
    status = {r.dashboard_id: r for r in fan_out_table(df, dashboards, store).collect()}
    assert (status[1].status, status[1].rows) == ("ok", 0) and store.get(2).count() == 0  # no member has a row
    assert status[3].rows == status[4].rows == df.count()  # no config: rows pass through
    assert status[5].status == "error"
    halves = spark.createDataFrame([(1, own(year + 0.5)), (2, own(year))], "dashboard_id long, config string")
    for store, rows in (
        (SnapshotStore(spark, str(tmp_path / "table")), lambda s: fan_out_table(df, halves, s)),
        (SnapshotStore(spark, str(tmp_path / "grouped")), lambda s: fan_out_grouped(df, {r.dashboard_id: r.config for r in halves.collect()}, s)),
    ):
        assert all(r.status == "ok" for r in rows(store).collect())
        assert store.get(1).count() == 0 and store.get(2).count() > 0


# ------------------------------------------------- list and range parameters


def _random_boards(rng, n):
    """Configs of one shape: a list, a range over ints and one over strings."""
    boards = {}
    for i in range(n):
        low = rng.choice([0, 3, 5, 9, 2.5])
        filters = [
            {"column": "k", "op": "in", "value": rng.sample(["a", "b", "c", "d"], rng.randrange(0, 4)) * 2},
            {"column": "x", "op": ">=", "value": low},
            {"column": "x", "op": "<", "value": rng.choice([0, 4, 8, 20])},
            {"column": "s", "op": "lt", "value": rng.choice(["m", "zz", "a"])},
        ]
        boards[i] = {"filters": filters, "aggregations": [{"column": "x", "operation": "count", "alias": "n"}], "group_by": ["k"]}
    return boards


def _rows_of(store, ids):
    out = {}
    for i in ids:
        got = store.get(i)
        out[i] = sorted(tuple(r) for r in got.collect()) if got is not None else None
    return out


@pytest.mark.parametrize("cells", [1, 3, 64])
def test_list_and_range_families_equal_single_runs(spark, tmp_path, monkeypatch, cells):
    import json
    import random

    from kpimart.plans import families
    from kpimart.plans.processing import run

    monkeypatch.setattr(families, "CELLS", cells)
    rng = random.Random(cells)
    data = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(12)]), rng.choice(["b", "n", "zy", None])) for _ in range(300)]
    df = spark.createDataFrame(data, "k string, x int, s string").repartition(3)
    boards = _random_boards(rng, 12)
    frame = spark.createDataFrame([(i, json.dumps(b)) for i, b in boards.items()], "dashboard_id long, config string")
    store = SnapshotStore(spark, str(tmp_path / "a"))
    status = families.fan_out_table(df, frame, store, stage_input=False)
    assert {r.status for r in status.collect()} == {"ok"}
    want = {}
    for i, b in boards.items():
        # a fraction compares with whole numbers as it is
        single = {**b, "filters": [f for f in b["filters"] if f["op"] != ">="]}
        low = next(f["value"] for f in b["filters"] if f["op"] == ">=")
        want[i] = sorted(tuple(r) for r in run(df.where(f"x >= {low}"), single).collect()) if low != 2.5 else None
    got = _rows_of(store, boards)
    assert all(got[i] == want[i] for i in boards if want[i] is not None)


def test_ranges_are_an_equi_join(spark):
    from kpimart.config import AggregationSpec, PipelineConfig
    from kpimart.plans.families import Param, run_family

    df = spark.range(1000).selectExpr("id", "cast(id % 50 as int) x")
    members = spark.range(40).selectExpr("id dashboard_id", "cast(id as int) __p0", "cast(id + 5 as int) __p1")
    shape = PipelineConfig(aggregations=(AggregationSpec("id", "count", "n"),), group_by=())
    out = run_family(df, shape, (Param("x", ">="), Param("x", "<=")), members)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "__row_cell" in plan and "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.dashboard_id: r.n for r in out.collect()} == {i: 20 * len(range(i, min(50, i + 6))) for i in range(40)}


def test_bad_lists_and_ranges_are_told(spark, tmp_path):
    import json

    from kpimart.plans.families import fan_out_table

    df = spark.createDataFrame([("a", 1)], "k string, x int")

    def board(op, column, value):
        return json.dumps({"filters": [{"column": column, "op": op, "value": value}], "aggregations": [], "group_by": ["k"]})

    configs = [board("in", "k", "a"), board("in", "k", ["a", 1]), board("in", "k", ["a"]), board(">", "x", "1"), board(">", "x", 0), board("in", "y", [1])]
    frame = spark.createDataFrame(list(enumerate(configs)), "dashboard_id long, config string")
    rows = {r.dashboard_id: r for r in fan_out_table(df, frame, SnapshotStore(spark, str(tmp_path)), stage_input=False).collect()}
    assert [rows[i].status for i in range(6)] == ["error", "error", "ok", "error", "ok", "error"]
    assert "Type mismatch" in rows[0].error and "Type mismatch" in rows[3].error and "y" in rows[5].error
