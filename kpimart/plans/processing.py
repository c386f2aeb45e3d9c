"""Pipeline runs (PIP-1..3): filters -> computed fields -> aggregate, as one
lazy plan per dashboard config."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kpimart.config import DashboardConfig, PipelineConfig
from kpimart.operators.aggregate import apply_aggregations
from kpimart.operators.computed import with_computed_fields
from kpimart.operators.filters import apply_row_filters


def as_pipeline(config: PipelineConfig | DashboardConfig | dict | str | None) -> PipelineConfig:
    """Accept a pipeline config, a dashboard config, a dict or JSON text."""
    if isinstance(config, PipelineConfig):
        return config
    if isinstance(config, DashboardConfig):
        return config.pipeline
    if isinstance(config, str) or config is None:
        return DashboardConfig.from_json(config).pipeline
    return DashboardConfig.from_dict(config).pipeline


def apply_transformations(df: DataFrame, config) -> DataFrame:
    """PIP-2: row filters in order, then computed fields in order."""
    cfg = as_pipeline(config)
    return with_computed_fields(apply_row_filters(df, cfg.filters), cfg.computed_fields)


def run(df: DataFrame, config) -> DataFrame:
    """PIP-1: ``transform`` then ``aggregate`` as one lazy plan."""
    cfg = as_pipeline(config)
    return apply_aggregations(apply_transformations(df, cfg), cfg)


__all__ = ["apply_aggregations", "apply_transformations", "as_pipeline", "run"]
