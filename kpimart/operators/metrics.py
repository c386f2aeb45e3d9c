"""Derived metrics (MET-1..4): year-over-year change, shares, custom ratios.

Metrics run on aggregated frames (one row per key tuple), so their inputs are
small, but none of them relies on that for correctness or for bounded tasks:

* YoY is computed at the ``(dims, period)`` grain. With dims it is a window
  partitioned by the dims (after aggregation a dim holds one row per period).
  Without dims it is an equi-join of the frame to itself on
  ``period = previous period + 1``; there is no window without partitioning.
* Share of a parent group joins a grouped total back (partial aggregation
  first; AQE broadcasts the totals when they are small or splits a skewed
  key when they are not).
* Share of the grand total divides by a scalar subquery.

Ratios are computed in double; a zero or null divisor gives null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpimart.functions.columns import ratio_minus_one, require_columns, safe_divide


def _as_double(c: Column) -> Column:
    return c.cast("double")


def yoy(
    df: DataFrame,
    value: str,
    period: str = "year",
    dims: Sequence[str] = (),
    alias: str = "yoy",
    prev_alias: str | None = None,
) -> DataFrame:
    """MET-1: ``value`` of each period vs the exact previous period.

    Output: ``dims, period, value, prev_value, yoy`` with one row per
    ``(dims, period)``; duplicate rows of one key are summed first. The
    previous period is ``period - 1``: a gap gives null, as does a previous
    value of 0 or null. ``yoy`` is a ratio (``cur / prev - 1``), not a percent.
    """
    dims = tuple(dims)
    require_columns(df, (*dims, period, value))
    prev_name = prev_alias or f"prev_{value}"
    cur = df.groupBy(*dims, period).agg(F.sum(value).alias(value))
    if dims:
        w = Window.partitionBy(*dims).orderBy(F.col(period)).rangeBetween(-1, -1)
        out = cur.withColumn(prev_name, F.sum(value).over(w))
    else:
        prev = cur.select((F.col(period) + F.lit(1)).alias("__next"), F.col(value).alias(prev_name))
        out = cur.join(prev, cur[period] == prev["__next"], "left").drop("__next")
    return out.withColumn(alias, ratio_minus_one(_as_double(F.col(value)), _as_double(F.col(prev_name))))


def share(df: DataFrame, value: str, total: str, alias: str = "share") -> DataFrame:
    """MET-2: ``value / total * 100`` row by row."""
    require_columns(df, (value, total))
    return df.withColumn(alias, safe_divide(_as_double(F.col(value)), _as_double(F.col(total))) * F.lit(100))


def share_of_parent(df: DataFrame, value: str, parent: Sequence[str], alias: str = "share") -> DataFrame:
    """MET-3: each row's share (percent) of the sum of ``value`` over its
    parent group. Null parent keys form a group."""
    parent = tuple(parent)
    require_columns(df, (value, *parent))
    if not parent:
        return share_of_total(df, value, alias)
    totals = df.groupBy(*parent).agg(F.sum(value).alias("__parent_total"))
    cond = [df[k].eqNullSafe(totals[k]) for k in parent]
    joined = df.join(totals, on=cond, how="left").select(df["*"], totals["__parent_total"])
    return joined.withColumn(
        alias, safe_divide(_as_double(F.col(value)), _as_double(F.col("__parent_total"))) * F.lit(100)
    ).drop("__parent_total")


def share_of_total(df: DataFrame, value: str, alias: str = "share") -> DataFrame:
    """MET-3 / CHT-4: each row's share (percent) of the grand total."""
    require_columns(df, (value,))
    total = df.agg(F.sum(value).alias("_t")).scalar()
    return df.withColumn(alias, safe_divide(_as_double(F.col(value)), _as_double(total)) * F.lit(100))


def ratio_of_sums(numerator: str, denominator: str, exact_scale: int | None = 2) -> Column:
    """An aggregate ``sum(numerator) / sum(denominator)`` in double.

    With ``exact_scale`` the sums run over ``decimal(18, exact_scale)``, so
    they are exact whatever the partitioning (double sums depend on
    summation order)."""
    def exact(name: str) -> Column:
        c = F.col(name)
        return c.cast(f"decimal(18,{exact_scale})") if exact_scale is not None else c

    return safe_divide(F.sum(exact(numerator)).cast("double"), F.sum(exact(denominator)).cast("double"))
