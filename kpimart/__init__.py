"""kpimart: config-driven dashboard aggregates on Spark DataFrames.

Every operator takes and returns a lazy ``pyspark.sql.DataFrame``; planning,
pushdown, shuffles and spilling stay with Catalyst and Spark.
"""

from kpimart.config import (
    AggregationSpec,
    ChartConfig,
    ComputedField,
    DashboardConfig,
    FilterSpec,
    PipelineConfig,
    ViewConfig,
)
from kpimart.operators.aggregate import aggregate
from kpimart.operators.charts import chart_dataset, combined_datasets
from kpimart.operators.entitlements import authorize, effective_access, visible_dashboards
from kpimart.operators.filters import GlobalFilters, apply_filters, apply_row_filters
from kpimart.operators.metrics import share, share_of_parent, share_of_total, yoy
from kpimart.plans.families import fan_out_grouped, fan_out_table
from kpimart.plans.fanout import fan_out, get_data
from kpimart.plans.processing import apply_aggregations, apply_transformations, run
from kpimart.sinks.store import SnapshotStore
from kpimart.sources.csv import load_csv, validate_files
from kpimart.streaming.upload import upload_stream

__all__ = [
    "AggregationSpec",
    "ChartConfig",
    "ComputedField",
    "DashboardConfig",
    "FilterSpec",
    "GlobalFilters",
    "PipelineConfig",
    "SnapshotStore",
    "ViewConfig",
    "aggregate",
    "apply_aggregations",
    "apply_filters",
    "apply_row_filters",
    "apply_transformations",
    "authorize",
    "chart_dataset",
    "combined_datasets",
    "effective_access",
    "fan_out",
    "fan_out_grouped",
    "fan_out_table",
    "get_data",
    "load_csv",
    "run",
    "share",
    "share_of_parent",
    "share_of_total",
    "upload_stream",
    "validate_files",
    "visible_dashboards",
    "yoy",
]
