"""One input, many dashboards (AGG-12, PIP-4..6).

The input is staged once as Parquet under the shared checkpoint folder:
that cuts its lineage (a lost executor re-reads staged files, not the gzip
upload), spreads a non-splittable ``.csv.gz`` over many files, and lets each
dashboard's plan read only its own columns. Each dashboard then gets its own
lazy plan and snapshot write; jobs are submitted from a small driver thread
pool so independent dashboards run side by side. A failing dashboard is
reported and does not stop the others. This is the form for tens of
dashboards; many dashboards of one shape run as one job per shape in
``kpimart.plans.families``.
"""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpimart.config import DashboardConfig
from kpimart.operators.filters import apply_row_filters, check_permitted, to_specs
from kpimart.plans.processing import as_pipeline, run
from kpimart.session import scratch_dir
from kpimart.sinks.store import SnapshotStore, delete_path
from kpimart.sources.csv import check_admitted, load_csv

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("dashboard_id", T.LongType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("rows", T.LongType(), True),
        T.StructField("snapshot_id", T.StringType(), True),
        T.StructField("error", T.StringType(), True),
    ]
)


@dataclass(frozen=True)
class DashboardResult:
    dashboard_id: int
    status: str
    rows: int | None = None
    snapshot_id: str | None = None
    error: str | None = None


def stage(df: DataFrame, path: str | None = None, partitions: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet (under the checkpoint folder) and read it
    back. A ``rebalance`` hint spreads a non-splittable input (one gzip file
    per task) over several tasks and lets AQE size the files from the data,
    so a small upload does not become thousands of tiny files on a large
    cluster; ``partitions`` forces a fixed count instead."""
    spark = df.sparkSession
    path = path or scratch_dir(spark, "staged")
    spread = df.repartition(partitions) if partitions else df.hint("rebalance")
    spread.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fan_out(
    df: DataFrame,
    configs: Mapping[int, object],
    store: SnapshotStore,
    snapshot_id: str | None = None,
    stage_input: bool = True,
    parallelism: int = 4,
) -> list[DashboardResult]:
    """Run every dashboard's pipeline on ``df`` and replace its snapshot."""
    pipelines = {}
    results: dict[int, DashboardResult] = {}
    for dash_id, cfg in configs.items():
        try:
            pipelines[int(dash_id)] = as_pipeline(cfg)
        except ValueError as exc:
            results[int(dash_id)] = DashboardResult(int(dash_id), "error", error=str(exc))
    if not pipelines:
        return [results[k] for k in sorted(results)]
    source = stage(df) if stage_input and len(pipelines) > 1 else df
    store.ensure()

    def one(item):
        dash_id, pipeline = item
        try:
            info = store.save(dash_id, run(source, pipeline), snapshot_id=snapshot_id)
            return DashboardResult(dash_id, "ok", info.row_count, info.snapshot_id)
        except Exception as exc:  # noqa: BLE001 - reported per dashboard
            return DashboardResult(dash_id, "error", error=f"{type(exc).__name__}: {exc}")

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(pipelines)))) as pool:
        for r in pool.map(one, sorted(pipelines.items())):
            results[r.dashboard_id] = r
    return [results[k] for k in sorted(results)]


def records_processed(results: list[DashboardResult]) -> int:
    """PIP-6: total aggregate rows written over all dashboards."""
    return sum(r.rows or 0 for r in results)


def results_frame(spark: SparkSession, results: list[DashboardResult]) -> DataFrame:
    """Per-dashboard status as a DataFrame (one row per dashboard)."""
    rows = [(r.dashboard_id, r.status, r.rows, r.snapshot_id, r.error) for r in results]
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def dashboard_configs(dashboards: DataFrame) -> dict[int, DashboardConfig]:
    """Read the dashboards' JSON configs (the definitions table, one small
    row per dashboard) to the driver, where each config becomes a plan."""
    return {int(r["dashboard_id"]): DashboardConfig.from_json(r["config"]) for r in dashboards.select("dashboard_id", "config").collect()}


def upload(
    spark: SparkSession,
    path: str,
    user_id: int,
    users: DataFrame,
    dashboards: DataFrame,
    access: DataFrame,
    store: SnapshotStore,
    schema=None,
    max_bytes: int | None = None,
    clean_source: bool = False,
) -> DataFrame:
    """The upload flow: admit the file (SRC-2), load it, find the dashboards
    the uploader may recompute (ENT-4/ENT-6), run each one's config, replace
    its snapshot. Families are planned in Spark from the entitled rows of the
    dashboards table. Returns the status rows ``(dashboard_id, status, rows,
    snapshot_id, error)``. With ``clean_source`` the file is removed at the
    end, on success and on error (SNK-7)."""
    from kpimart.plans.families import fan_out_table
    from kpimart.streaming.upload import entitled_dashboards

    try:
        check_admitted(spark, path, max_bytes)
        df = load_csv(spark, path, schema)
        return fan_out_table(df, entitled_dashboards(user_id, users, dashboards, access), store)
    finally:
        if clean_source:
            delete_path(spark, path)


def trigger_processing(
    spark: SparkSession, path: str, dashboard_id: int, dashboards: DataFrame, store: SnapshotStore, schema=None
) -> DashboardResult:
    """PIP-4: load one file, run that dashboard's own config, save."""
    configs = dashboard_configs(dashboards.where(F.col("dashboard_id") == F.lit(int(dashboard_id))))
    if int(dashboard_id) not in configs:
        return DashboardResult(int(dashboard_id), "error", error="Unknown dashboard")
    return fan_out(load_csv(spark, path, schema), configs, store, stage_input=False)[0]


def get_data(
    store: SnapshotStore,
    dashboard_id: int,
    filters=None,
    mode: str = "stored",
    source: DataFrame | None = None,
    config=None,
) -> DataFrame:
    """PIP-5: a dashboard's data through request filters.

    ``stored`` (FLT-7): filter the latest saved aggregate; filters must name
    its columns. ``raw`` (FLT-6): filter ``source`` rows first, then run the
    dashboard's pipeline. The two agree when every filter column is a group
    key. When a config with a view is given, only its permitted filters are
    accepted (FLT-9). A dashboard that was never saved gives an empty result
    without columns."""
    specs = to_specs(filters)
    if isinstance(config, DashboardConfig):
        check_permitted(config.view, specs)
    if mode == "stored":
        agg = store.get(dashboard_id)
        if agg is None:
            return store.spark.createDataFrame([], T.StructType([]))
        return apply_row_filters(agg, specs)
    if mode == "raw":
        if source is None or config is None:
            raise ValueError("raw mode needs the source rows and the dashboard config")
        return run(apply_row_filters(source, specs), config)
    raise ValueError(f"Unknown mode: {mode}")
