"""Computed fields (PRJ-1..5).

Fields are applied in order; a later field may use an earlier one; a field
with an existing name replaces that column (exact-case match: ``V`` does not
replace ``v``, it is rejected, since Spark would resolve it case-insensitively).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kpimart.config import ComputedField
from kpimart.functions.expressions import compile_expression
from kpimart.session import scratch_dir


def _check_name(df: DataFrame, name: str) -> None:
    clash = [c for c in df.columns if c.lower() == name.lower() and c != name]
    if clash:
        raise ValueError(f"Computed field {name!r} differs only in case from column {clash[0]!r}")


def _written(groups: DataFrame) -> DataFrame:
    """``groups`` by way of a file, under names that any file format takes."""
    if any(isinstance(f.dataType, T.NullType) for f in groups.schema):
        return groups  # nothing to write
    path = scratch_dir(groups.sparkSession, "group-values")
    plain = groups.toDF(*[f"c{i}" for i in range(len(groups.columns))])
    plain.write.parquet(path)
    return groups.sparkSession.read.schema(plain.schema).parquet(path).toDF(*groups.columns)


def with_computed_field(df: DataFrame, spec: ComputedField) -> DataFrame:
    """One computed field. Per-group aggregates inside the expression are
    computed with ``groupBy(keys).agg`` (partial aggregation first, so a hot
    key is combined map-side) and joined back on the keys (null-safe). They are
    written first, so that Spark knows their size as it plans the join: few
    groups are broadcast, and the rows are not shuffled for them (AQE would find
    that out only once they are)."""
    _check_name(df, spec.name)
    compiled = compile_expression(df, spec.expression, spec.name)
    out = df
    for g in compiled.grouped:
        per_group = _written(out.groupBy(*g.keys).agg(g.expr.alias(g.name)))
        cond = [out[k].eqNullSafe(per_group[k]) for k in g.keys]
        out = out.join(per_group, on=cond, how="left").select(out["*"], per_group[g.name])
    out = out.withColumn(spec.name, compiled.column)
    helper = [g.name for g in compiled.grouped]
    return out.drop(*helper) if helper else out


def with_computed_fields(df: DataFrame, fields: Iterable[ComputedField | dict]) -> DataFrame:
    """PRJ-1: apply fields in order. Fields without inner aggregates are
    compiled against the frame as it stands, so chains resolve naturally."""
    out = df
    for f in fields:
        spec = f if isinstance(f, ComputedField) else ComputedField.from_dict(f)
        out = with_computed_field(out, spec)
    return out


def growth_ratio(df: DataFrame, value: str, prev: str, alias: str = "growth") -> DataFrame:
    """PRJ-3: ``value / prev - 1`` (null for a zero or null ``prev``)."""
    return with_computed_field(
        df, ComputedField(alias, {"op": "-", "args": [{"op": "/", "args": [{"col": value}, {"col": prev}]}, {"lit": 1}]})
    )


__all__ = ["growth_ratio", "with_computed_field", "with_computed_fields"]
