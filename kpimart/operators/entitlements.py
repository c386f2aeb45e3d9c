"""Access rules as set operations (ENT-1..6, SET-1).

Inputs::

    users      : user_id, role            (admin | editor | viewer)
    dashboards : dashboard_id, owner_id, ...
    access     : user_id, dashboard_id    (duplicates allowed)

A user may see a dashboard if the user is an admin, owns it, or holds a
grant. That an admin sees all stays a rule: it is one row (``sees_all``), not
one row per dashboard, so no result grows with users x dashboards. Checks
(ENT-2/3/4/6) test the role and look the request up in the owner/grant pairs;
their size follows the requests. Nothing here runs a job when a plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpimart.functions.columns import require_columns

ADMIN = "admin"
WRITE_ROLES = ("admin", "editor")
WRITE_ACTIONS = ("upload", "recompute")


def direct_access(dashboards: DataFrame, access: DataFrame) -> DataFrame:
    """Owner and explicit grants, de-duplicated: ``(user_id, dashboard_id)``."""
    require_columns(dashboards, ("dashboard_id", "owner_id"))
    require_columns(access, ("user_id", "dashboard_id"))
    owners = dashboards.where(F.col("owner_id").isNotNull()).select(
        F.col("owner_id").alias("user_id"), F.col("dashboard_id")
    )
    grants = access.select("user_id", "dashboard_id")
    return owners.unionByName(grants).distinct()


def effective_access(
    users: DataFrame, dashboards: DataFrame, access: DataFrame, admin_role: str = ADMIN
) -> DataFrame:
    """ENT-1/SET-1: what every user may see, as ``(user_id, dashboard_id,
    sees_all)``: one row per owned or granted dashboard, and one row with
    ``sees_all`` (and no dashboard) per admin."""
    require_columns(users, ("user_id", "role"))
    admins = users.where(F.col("role") == F.lit(admin_role)).select("user_id").distinct()
    ids = direct_access(dashboards, access)
    rule = admins.select("user_id", F.lit(None).cast(ids.schema["dashboard_id"].dataType).alias("dashboard_id"))
    return rule.withColumn("sees_all", F.lit(True)).unionByName(ids.withColumn("sees_all", F.lit(False)))


def _is_admin(users: DataFrame, user_id: int, admin_role: str = ADMIN) -> Column:
    """Scalar subquery: does ``user_id`` have the admin role?"""
    hit = users.where((F.col("user_id") == F.lit(user_id)) & (F.col("role") == F.lit(admin_role)))
    return hit.agg((F.count(F.lit(1)) > 0).alias("_a")).scalar()


def visible_dashboards(users: DataFrame, dashboards: DataFrame, access: DataFrame, user_id: int) -> DataFrame:
    """ENT-2: dashboards a user may see (all of them for an admin)."""
    mine = (
        direct_access(dashboards, access)
        .where(F.col("user_id") == F.lit(user_id))
        .select("dashboard_id", F.lit(True).alias("__granted"))
        .distinct()
    )
    joined = dashboards.join(mine, "dashboard_id", "left")
    return joined.where(F.col("__granted").isNotNull() | _is_admin(users, user_id)).drop("__granted")


def dashboard_if_permitted(
    users: DataFrame, dashboards: DataFrame, access: DataFrame, user_id: int, dashboard_id: int
) -> DataFrame:
    """ENT-3: the dashboard row if the user may see it, else no row; absent
    and forbidden are indistinguishable."""
    return visible_dashboards(users, dashboards, access, user_id).where(F.col("dashboard_id") == F.lit(dashboard_id))


def authorize(
    requests: DataFrame, users: DataFrame, dashboards: DataFrame, access: DataFrame, admin_role: str = ADMIN
) -> DataFrame:
    """ENT-4/ENT-6: ``requests`` plus a boolean ``allowed``.

    Admins are allowed on any id, existing or not. An unknown user is not an
    admin but may still match as owner or grantee. With an ``action`` column,
    ``upload`` and ``recompute`` also need the editor or admin role.
    """
    require_columns(requests, ("user_id", "dashboard_id"))
    roles = users.select("user_id", "role")
    pairs = direct_access(dashboards, access).withColumn("__granted", F.lit(True))
    r = requests.join(roles, "user_id", "left").join(pairs, ["user_id", "dashboard_id"], "left")
    role = F.coalesce(F.col("role"), F.lit(""))
    allowed = F.col("__granted").isNotNull() | (role == F.lit(admin_role))
    if "action" in requests.columns:
        needs_write = F.col("action").isin(list(WRITE_ACTIONS))
        allowed = allowed & (~needs_write | role.isin(list(WRITE_ROLES)))
    return r.withColumn("allowed", allowed).drop("__granted", "role").select(*requests.columns, "allowed")


def denied(requests: DataFrame, users: DataFrame, dashboards: DataFrame, access: DataFrame) -> DataFrame:
    """ENT-4: the requests that are not allowed."""
    return authorize(requests, users, dashboards, access).where(~F.col("allowed")).drop("allowed")


def entitled_rows(
    rows: DataFrame, users: DataFrame, dashboards: DataFrame, access: DataFrame, user_id: int, key: str = "dashboard_id"
) -> DataFrame:
    """ENT-5: the rows of per-dashboard aggregates that one user may see."""
    require_columns(rows, (key,))
    mine = visible_dashboards(users, dashboards, access, user_id).select(F.col("dashboard_id").alias(key))
    return rows.join(mine, key, "left_semi")


def role_gate(eff: DataFrame, users: DataFrame, alias: str = "can_upload") -> DataFrame:
    """ENT-6: for each row of ``effective_access``, whether the user may
    upload and recompute there."""
    return eff.join(users.select("user_id", "role"), "user_id").select(
        *eff.columns, F.col("role").isin(list(WRITE_ROLES)).alias(alias)
    )
