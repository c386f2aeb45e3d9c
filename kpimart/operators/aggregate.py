"""Grouped and global aggregation (AGG-1..11).

One ``groupBy(*keys).agg(*exprs)`` per config: Spark plans a partial
(map-side) hash aggregate, one shuffle on the keys, and a final aggregate, so
a key that holds a third of all rows is combined before the shuffle and never
reaches one task as raw rows. Every built-in operation is decomposable.

Semantics (differs from Spark's defaults where noted):

* sum of an all-null or empty group is 0, in the sum's own type;
* mean of a decimal column is ``double(exact decimal sum) / count``;
  of other numeric columns ``avg``;
* count counts rows, nulls included; its column names only the default alias;
* min / max ignore NaN in float columns;
* the default alias is ``{operation}_{column}``;
* the least and greatest of a text column is taken in two levels (see
  ``_two_levels``), as a text in an aggregate's buffer makes Spark sort its input;
* no group keys -> exactly one row, also on empty input;
* no ``aggregations`` key -> the input unchanged (even with keys);
* ``aggregations == []`` with keys -> one row per distinct key tuple.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpimart.config import AGGREGATE_OPERATIONS, AggregationSpec, PipelineConfig, check_output_names
from kpimart.functions.columns import column_type, is_numeric, nan_to_null, require_columns, safe_divide, sum_type
from kpimart.functions.registry import MergeableMetric, get_aggregate, get_mergeable
from kpimart.operators.mergeable import empty_value, merged_metrics


def _mergeable(spec: AggregationSpec) -> MergeableMetric | None:
    return None if spec.operation in AGGREGATE_OPERATIONS else get_mergeable(spec.operation)


def aggregate_expression(df: DataFrame, spec: AggregationSpec) -> Column:
    """The aggregate ``Column`` for one spec, aliased to its output name."""
    op = spec.operation
    if op == "count":
        return F.count(F.lit(1)).alias(spec.output_name)
    custom = get_aggregate(op)
    if op not in ("sum", "mean", "min", "max") and custom is not None:
        return custom(df, spec.column).alias(spec.output_name)
    if _mergeable(spec) is not None:
        raise ValueError(f"{op} is a mergeable metric: it has no aggregate expression")
    dtype = column_type(df, spec.column)
    c = F.col(spec.column)
    if op in ("sum", "mean") and not is_numeric(dtype):
        raise ValueError(f"{op} needs a numeric column, {spec.column} is {dtype.simpleString()}")
    if op == "sum":
        out = F.coalesce(F.sum(c), F.lit(0).cast(sum_type(dtype)))
    elif op == "mean":
        if isinstance(dtype, T.DecimalType):
            out = safe_divide(F.sum(c).cast("double"), F.count(c))
        else:
            out = F.avg(c)
    elif op == "min":
        out = F.min(nan_to_null(c, dtype))
    else:
        out = F.max(nan_to_null(c, dtype))
    return out.alias(spec.output_name)


def empty_group_value(df: DataFrame, spec: AggregationSpec) -> Column | None:
    """The value an operation takes on an empty group (sum and count: 0;
    others: null), in the aggregate's own type; None means null."""
    if spec.operation == "count":
        return F.lit(0).cast("bigint")
    if spec.operation == "sum":
        return F.lit(0).cast(sum_type(column_type(df, spec.column)))
    metric = _mergeable(spec)
    if metric is not None:
        return F.lit(empty_value(metric, column_type(df, spec.column))).cast(metric.result)
    return None


def _is_text(df: DataFrame, spec: AggregationSpec) -> bool:
    return spec.operation in ("min", "max") and isinstance(column_type(df, spec.column), (T.StringType, T.BinaryType))


def _levels(df: DataFrame, spec: AggregationSpec, name: str) -> tuple[list[Column], Column]:
    """One operation as partial columns (named after ``name``) and the
    aggregate that merges them."""
    op = spec.operation
    if op == "count":
        return [F.count(F.lit(1)).alias(name)], F.coalesce(F.sum(name), F.lit(0).cast("bigint"))
    dtype = column_type(df, spec.column)
    c = F.col(spec.column)
    if op in ("sum", "mean") and not is_numeric(dtype):
        raise ValueError(f"{op} needs a numeric column, {spec.column} is {dtype.simpleString()}")
    if op == "sum":
        whole = sum_type(dtype)
        return [F.sum(c).alias(name)], F.coalesce(F.sum(name).cast(whole), F.lit(0).cast(whole))
    if op == "mean":
        added = F.sum(c if isinstance(dtype, T.DecimalType) else c.cast("double"))
        counted = f"{name}_n"
        return [added.alias(name), F.count(c).alias(counted)], safe_divide(F.sum(name).cast("double"), F.sum(counted))
    least = op == "min"
    pick = F.min if least else F.max
    return [pick(nan_to_null(c, dtype)).alias(name)], pick(name)


def _two_levels(df: DataFrame, specs: Sequence[AggregationSpec], keys: Sequence[str]) -> DataFrame:
    """The aggregate with the texts whose extremes are asked for as keys of a
    first level. That level is a hash aggregate, partial before the shuffle;
    only the distinct texts of each group, not its rows, meet the sort of the
    second level, which is partial before its shuffle too."""
    texts = list(dict.fromkeys(s.column for s in specs if _is_text(df, s) and s.column not in keys))
    partial, merged = [], []
    for i, spec in enumerate(specs):
        if _is_text(df, spec):
            merged.append((F.min if spec.operation == "min" else F.max)(spec.column).alias(spec.output_name))
            continue
        columns, merge = _levels(df, spec, f"__part{i}")
        partial += columns
        merged.append(merge.alias(spec.output_name))
    first = df.groupBy(*keys, *texts)
    first = first.agg(*partial) if partial else df.select(*keys, *texts).distinct()
    return first.groupBy(*keys).agg(*merged) if keys else first.agg(*merged)


def _with_mergeable(df: DataFrame, specs: Sequence[AggregationSpec], mergeable: list, keys: Sequence[str]) -> DataFrame:
    """Mergeable metrics in Arrow batches, the other operations native; both
    have one row per key tuple and are joined on it."""
    out = merged_metrics(df, mergeable, keys)
    native = [s for s in specs if s not in mergeable]
    if not native:
        return out
    rest = aggregate(df, native, keys)
    if keys:
        named = rest.select(*[F.col(k).alias(f"__j{i}") for i, k in enumerate(keys)], *[s.output_name for s in native])
        same = [out[k].eqNullSafe(named[f"__j{i}"]) for i, k in enumerate(keys)]
        return out.join(named, same).select(*keys, *[s.output_name for s in specs])
    one = F.lit(1).alias("__one")
    both = out.select("*", one).join(rest.select("*", one), "__one")
    return both.select(*[s.output_name for s in specs])


def aggregate(
    df: DataFrame,
    aggregations: Sequence[AggregationSpec | dict] | None,
    group_by: Iterable[str] = (),
) -> DataFrame:
    """AGG-1..11 on a lazy frame."""
    if aggregations is None:
        return df  # AGG-8
    specs = tuple(a if isinstance(a, AggregationSpec) else AggregationSpec.from_dict(a) for a in aggregations)
    keys = tuple(group_by)
    check_output_names(keys, specs)
    require_columns(df, keys, "group key")
    if not specs:
        if keys:
            return df.select(*keys).distinct()  # AGG-9: partial dedup map-side
        return df.sparkSession.createDataFrame([], T.StructType([]))
    mergeable = [s for s in specs if _mergeable(s) is not None]
    if mergeable:
        return _with_mergeable(df, specs, mergeable, keys)
    plain = all(s.operation in AGGREGATE_OPERATIONS for s in specs)
    if plain and any(_is_text(df, s) and s.column not in keys for s in specs):
        return _two_levels(df, specs, keys)
    exprs = [aggregate_expression(df, s) for s in specs]
    if keys:
        return df.groupBy(*keys).agg(*exprs)  # AGG-6
    return df.agg(*exprs)  # AGG-7


def apply_aggregations(df: DataFrame, config: PipelineConfig | dict) -> DataFrame:
    """PIP-3: the aggregation half of a pipeline config."""
    cfg = config if isinstance(config, PipelineConfig) else PipelineConfig.from_dict(config)
    return aggregate(df, cfg.aggregations, cfg.group_by)
