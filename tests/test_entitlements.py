"""ENT-1..6 and SET-1: access as set operations (admin, owner, grant)."""

import pytest

from kpimart.operators.entitlements import (
    authorize,
    dashboard_if_permitted,
    denied,
    effective_access,
    entitled_rows,
    role_gate,
    visible_dashboards,
)


@pytest.fixture()
def ent(spark):
    users = spark.createDataFrame([(1, "admin"), (2, "editor"), (3, "viewer"), (4, "viewer")], "user_id long, role string")
    dashboards = spark.createDataFrame(
        [(10, "d10", "{}", 2), (11, "d11", "{}", 3), (12, "d12", "{}", None)],
        "dashboard_id long, name string, config string, owner_id long",
    )
    # the same grant twice; a grant to a user id that is not in users
    access = spark.createDataFrame([(4, 10), (4, 10), (99, 12)], "user_id long, dashboard_id long")
    return users, dashboards, access


def _pairs(df):
    return sorted((r.user_id, r.dashboard_id) for r in df.collect())


def test_effective_access(ent):
    got = effective_access(*ent)
    assert _pairs(got.where("not sees_all")) == [(2, 10), (3, 11), (4, 10), (99, 12)]
    # that an admin sees all is one row, whatever the number of dashboards
    assert [(r.user_id, r.dashboard_id) for r in got.where("sees_all").collect()] == [(1, None)]


def test_building_a_plan_runs_no_job(spark, ent):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build-only", "plans are built, not run")
    effective_access(*ent)
    role_gate(effective_access(*ent), ent[0])
    authorize(ent[2], *ent)
    assert list(tracker.getJobIdsForGroup("build-only")) == []


def test_visible_lists_each_dashboard_once(ent):
    assert sorted(r.dashboard_id for r in visible_dashboards(*ent, user_id=4).collect()) == [10]  # duplicate grant
    assert sorted(r.dashboard_id for r in visible_dashboards(*ent, user_id=1).collect()) == [10, 11, 12]  # admin
    assert sorted(r.dashboard_id for r in visible_dashboards(*ent, user_id=2).collect()) == [10]  # owner


def test_fetch_if_permitted_absent_and_forbidden_look_the_same(ent):
    assert dashboard_if_permitted(*ent, user_id=3, dashboard_id=11).count() == 1
    assert dashboard_if_permitted(*ent, user_id=3, dashboard_id=10).count() == 0  # forbidden
    assert dashboard_if_permitted(*ent, user_id=3, dashboard_id=77).count() == 0  # absent


def test_authorize_batch(spark, ent):
    req = spark.createDataFrame(
        [(1, 500), (3, 10), (3, 11), (99, 12), (99, 10), (4, 10)], "user_id long, dashboard_id long"
    )
    got = {(r.user_id, r.dashboard_id): r.allowed for r in authorize(req, *ent).collect()}
    assert got == {(1, 500): True, (3, 10): False, (3, 11): True, (99, 12): True, (99, 10): False, (4, 10): True}
    assert sorted(denied(req, *ent).select("user_id", "dashboard_id").collect()) == [(3, 10), (99, 10)]


def test_role_gate_for_uploads(spark, ent):
    req = spark.createDataFrame(
        [(2, 10, "upload"), (3, 11, "upload"), (3, 11, "read"), (1, 11, "recompute")],
        "user_id long, dashboard_id long, action string",
    )
    got = {(r.user_id, r.action): r.allowed for r in authorize(req, *ent).collect()}
    assert got == {(2, "upload"): True, (3, "upload"): False, (3, "read"): True, (1, "recompute"): True}
    gate = {(r.user_id, r.dashboard_id): r.can_upload for r in role_gate(effective_access(*ent), ent[0]).collect()}
    assert gate[(2, 10)] and not gate[(3, 11)] and gate[(1, None)] and (99, 12) not in gate


def test_entitled_rows(spark, ent):
    rows = spark.createDataFrame([(10, 5.0), (11, 7.0)], "dashboard_id long, total double")
    for user, totals in {1: [5.0, 7.0], 2: [5.0], 3: [7.0], 4: [5.0], 5: []}.items():
        assert sorted(r.total for r in entitled_rows(rows, *ent, user_id=user).collect()) == totals


def test_no_cartesian_product_in_plans(ent):
    for df in (effective_access(*ent), visible_dashboards(*ent, user_id=1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_revoked_grant_denies(spark, ent):
    users, dashboards, access = ent
    req = spark.createDataFrame([(4, 10)], "user_id long, dashboard_id long")
    assert authorize(req, users, dashboards, access).first().allowed
    revoked = access.where("not (user_id = 4 and dashboard_id = 10)")
    assert not authorize(req, users, dashboards, revoked).first().allowed
