"""Chart datasets (CHT-1..8): the rows each chart type needs, as DataFrames.

Drawing is out of scope; a chart is fed by a narrow projection (or, for a
pie, one more aggregate) of an already aggregated frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpimart.config import ChartConfig, PipelineConfig
from kpimart.functions.columns import require_columns
from kpimart.functions.registry import get_mergeable
from kpimart.operators.metrics import share_of_total


def check_chart(df: DataFrame, chart: ChartConfig) -> None:
    """CHT-8: the chart's columns exist in the frame (exact case)."""
    require_columns(df, chart.columns, "chart column")


def bar_series(df: DataFrame, x: str, y: str, x_alias: str = "x") -> DataFrame:
    """CHT-1: ``(x, series, value)`` with the series named after ``y``."""
    require_columns(df, (x, y), "chart column")
    return df.select(F.col(x).alias(x_alias), F.lit(y).alias("series"), F.col(y).alias("value"))


def line_series(df: DataFrame, x: str, y: str, x_alias: str = "x", sort: bool = False) -> DataFrame:
    """CHT-3: as a bar series; ``sort=True`` orders by x for drawing."""
    out = bar_series(df, x, y, x_alias)
    return out.orderBy(x_alias) if sort else out


def dot_points(df: DataFrame, x: str, y: str, size: str | None = None, color: str | None = None) -> DataFrame:
    """CHT-2: ``(x, y[, size][, color])``."""
    cols = {"x": x, "y": y, "size": size, "color": color}
    require_columns(df, [c for c in cols.values() if c], "chart column")
    return df.select(*[F.col(c).alias(k) for k, c in cols.items() if c])


def pie_slices(df: DataFrame, x: str, y: str) -> DataFrame:
    """CHT-4: one slice per x with its value and its percent of the total."""
    require_columns(df, (x, y), "chart column")
    slices = df.groupBy(x).agg(F.sum(y).alias("value")).withColumnRenamed(x, "x")
    return share_of_total(slices, "value")


def table_rows(df: DataFrame, x: str, ys: Sequence[str]) -> DataFrame:
    """CHT-5: the x column and the y columns as they are."""
    require_columns(df, (x, *ys), "chart column")
    return df.select(x, *ys)


def multi_series(df: DataFrame, x: str, ys: Sequence[str], x_alias: str | None = None) -> DataFrame:
    """CHT-6: several y columns in long form ``(x, series, value)``; nulls kept."""
    require_columns(df, (x, *ys), "chart column")
    long = df.unpivot([x], list(ys), "series", "value")
    return long.withColumnRenamed(x, x_alias) if x_alias else long


def chart_dataset(df: DataFrame, chart: ChartConfig, x_alias: str = "x") -> DataFrame:
    """The dataset for one chart config."""
    check_chart(df, chart)
    if chart.type == "dot":
        return dot_points(df, chart.x, chart.y[0], chart.size, chart.color)
    if chart.type == "table":
        return table_rows(df, chart.x, chart.y)
    if chart.type == "pie":
        return pie_slices(df, chart.x, chart.y[0])
    if len(chart.y) > 1:
        return multi_series(df, chart.x, chart.y, x_alias)
    if chart.type == "line":
        return line_series(df, chart.x, chart.y[0], x_alias, sort=True)
    return bar_series(df, chart.x, chart.y[0], x_alias)


def _one_key_each(charts: Sequence[tuple[PipelineConfig, ChartConfig]]) -> bool:
    """Charts whose pipelines differ only in one group key each."""
    first = charts[0][0]
    keys = [p.group_by for p, _ in charts]
    return (
        len(charts) > 1
        and not first.computed_fields
        and first.aggregations
        and all(get_mergeable(a.operation) is None for a in first.aggregations)
        and all(len(k) == 1 for k in keys)
        and len({k[0] for k in keys}) == len(keys)
        and all(p.filters == first.filters and p.aggregations == first.aggregations and not p.computed_fields
                for p, _ in charts)
        and all(c.type in ("bar", "line") and len(c.y) == 1 and c.x == p.group_by[0] for p, c in charts)
    )


def _grouping_sets(df: DataFrame, charts: Sequence[tuple[PipelineConfig, ChartConfig]]) -> DataFrame:
    """One ``GROUPING SETS`` aggregate for all charts: one scan, one shuffle.
    ``grouping_id`` tells the sets apart (a real null key stays distinct from
    a rolled-up one) and maps each row to its chart."""
    from kpimart.operators.aggregate import aggregate_expression
    from kpimart.operators.filters import apply_row_filters

    pipeline = charts[0][0]
    base = apply_row_filters(df, pipeline.filters)
    keys = [p.group_by[0] for p, _ in charts]
    require_columns(base, keys, "group key")
    exprs = [aggregate_expression(base, spec) for spec in pipeline.aggregations]
    g = base.groupingSets([[k] for k in keys], *keys).agg(*exprs, F.grouping_id().alias("__gid"))
    n = len(keys)
    chart_id = x = series = value = None
    for i, (_, chart) in enumerate(charts):
        check_chart(g, chart)
        gid = sum(1 << (n - 1 - j) for j in range(n) if j != i)  # bit set = column rolled up
        hit = F.col("__gid") == F.lit(gid)
        pairs = ((F.lit(i), "chart_id"), (F.col(keys[i]).cast("string"), "x"), (F.lit(chart.y[0]), "series"), (F.col(chart.y[0]), "value"))
        built = []
        for (val, _), prev in zip(pairs, (chart_id, x, series, value)):
            built.append(F.when(hit, val) if prev is None else prev.when(hit, val))
        chart_id, x, series, value = built
    return g.select(chart_id.alias("chart_id"), x.alias("x"), series.alias("series"), value.alias("value"))


def combined_datasets(df: DataFrame, charts: Sequence[tuple[PipelineConfig, ChartConfig]]) -> DataFrame:
    """CHT-7: several charts over one (globally filtered) frame, tagged
    ``chart_id`` (their position), as ``(chart_id, x, series, value)``.

    Charts that differ only in their single group key are one grouping-sets
    aggregate (one scan); others run their own pipelines on the frame and
    are unioned."""
    from kpimart.plans.processing import run

    if charts and _one_key_each(charts):
        return _grouping_sets(df, charts)
    parts = []
    for i, (pipeline, chart) in enumerate(charts):
        if chart.type in ("dot", "table", "pie"):
            raise ValueError(f"Chart {i}: a combined view takes bar or line series, got {chart.type}")
        agg = run(df, pipeline)
        check_chart(agg, chart)
        # line and bar give the same rows; a union keeps no order, so no sort
        data = multi_series(agg, chart.x, chart.y, "x") if len(chart.y) > 1 else bar_series(agg, chart.x, chart.y[0])
        parts.append(
            data.select(F.lit(i).alias("chart_id"), F.col("x").cast("string").alias("x"), "series", "value")
        )
    if not parts:
        raise ValueError("No charts given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
