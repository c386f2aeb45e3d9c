"""Row filters (FLT-1..9).

All filters compile to one ``Column`` predicate per spec and are applied with
``DataFrame.filter``; Catalyst pushes them into the Parquet scan (or below
joins and aggregates, for filters on group keys).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpimart.config import FilterSpec, ViewConfig
from kpimart.functions.columns import check_value_type, column_type


def predicate(df: DataFrame, spec: FilterSpec) -> Column:
    """``spec`` as a ``Column``; checks the column exists (exact case) and the
    value's type fits the column's."""
    dtype = column_type(df, spec.column)
    c = F.col(spec.column)
    if spec.op == "in":
        for v in spec.value:
            check_value_type(spec.column, dtype, v)
        return c.isin(list(spec.value))
    check_value_type(spec.column, dtype, spec.value)
    if spec.op == "contains":
        if not isinstance(dtype, T.StringType):
            raise ValueError(f"contains needs a string column, {spec.column} is {dtype.simpleString()}")
        return c.contains(F.lit(spec.value))
    v = F.lit(spec.value)
    return {
        "==": lambda: c == v,
        "!=": lambda: c != v,
        ">": lambda: c > v,
        "<": lambda: c < v,
        ">=": lambda: c >= v,
        "<=": lambda: c <= v,
    }[spec.op]()


def apply_row_filters(df: DataFrame, filters: Iterable[FilterSpec | dict]) -> DataFrame:
    """FLT-1/2/3: config filters, in order, combined with AND."""
    out = df
    for f in filters:
        spec = f if isinstance(f, FilterSpec) else FilterSpec.from_dict(f)
        out = out.filter(predicate(out, spec))
    return out


def apply_filters(df: DataFrame, year: int | None = None, category: str | None = None, brand: str | None = None) -> DataFrame:
    """FLT-4/FLT-8: strict global filters. ``None`` = no filter; a given filter
    whose column is absent is an error; values are type-checked."""
    if year is not None and (not isinstance(year, int) or isinstance(year, bool)):
        raise ValueError(f"year must be an int, got {type(year).__name__}")
    for name, value in (("category", category), ("brand", brand)):
        if value is not None and not isinstance(value, str):
            raise ValueError(f"{name} must be a string, got {type(value).__name__}")
    specs = [FilterSpec(n, v) for n, v in (("year", year), ("category", category), ("brand", brand)) if v is not None]
    return apply_row_filters(df, specs)


@dataclass(frozen=True)
class GlobalFilters:
    """FLT-5: an immutable global filter set. Setting or clearing returns a new
    set. Applying it skips columns the frame does not have (a dashboard whose
    aggregate lacks ``brand`` simply ignores a brand filter)."""

    values: Mapping[str, Any] = field(default_factory=dict)

    def set_filter(self, name: str, value: Any) -> "GlobalFilters":
        return GlobalFilters({**self.values, name: value})

    def clear_filter(self, name: str) -> "GlobalFilters":
        return GlobalFilters({k: v for k, v in self.values.items() if k != name})

    def clear_all(self) -> "GlobalFilters":
        return GlobalFilters({})

    def get_filters(self) -> dict[str, Any]:
        return dict(self.values)

    def apply_to_dataframe(self, df: DataFrame) -> DataFrame:
        present = set(df.columns)
        return apply_row_filters(df, [FilterSpec(k, v) for k, v in self.values.items() if k in present])


def check_permitted(view: ViewConfig, filters: Mapping[str, Any] | Iterable[FilterSpec]) -> None:
    """FLT-9: a dashboard lists the global filters it accepts; others are
    rejected before any predicate is built. An empty list permits none."""
    names = [f.column for f in filters] if not isinstance(filters, Mapping) else list(filters)
    allowed = set(view.filters)
    rejected = [n for n in names if n not in allowed]
    if rejected:
        raise ValueError(f"Filter(s) not permitted on this dashboard: {', '.join(rejected)}")


def to_specs(filters: Mapping[str, Any] | Iterable[FilterSpec | dict] | None) -> list[FilterSpec]:
    """Normalise ``{name: value}``, ``[{column, value, op}]`` or specs."""
    if not filters:
        return []
    if isinstance(filters, Mapping):
        return [FilterSpec(k, v) for k, v in filters.items() if v is not None]
    return [f if isinstance(f, FilterSpec) else FilterSpec.from_dict(f) for f in filters]
