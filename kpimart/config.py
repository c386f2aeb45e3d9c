"""Dashboard configuration: frozen dataclasses parsed once on the driver.

A dashboard config has two parts that the original design mixed under one
``filters`` key: the *pipeline* (row filters, computed fields, aggregations,
group keys) and the *view* (charts and the names of permitted global filters).

All checks that need no data run here, so a bad config fails before any job.
Checks that need a schema (column existence, types) run in the operators,
against ``df.schema`` only (analysis, no job).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

# The operations, comparison operators and chart types of the
# configuration language.
AGGREGATE_OPERATIONS = ("sum", "mean", "count", "min", "max")
FILTER_OPERATORS = ("==", "!=", ">", "<", ">=", "<=", "contains", "in")
FILTER_OPERATOR_ALIASES = {"=": "==", "eq": "==", "ne": "!=", "<>": "!=", "gt": ">", "lt": "<", "ge": ">=", "le": "<="}
CHART_TYPES = ("bar", "line", "pie", "table", "dot")
PIPELINE_KEYS = ("filters", "computed_fields", "aggregations", "group_by")


@dataclass(frozen=True)
class FilterSpec:
    """One row predicate ``column <op> value``."""

    column: str
    value: Any
    op: str = "=="

    def __post_init__(self) -> None:
        op = FILTER_OPERATOR_ALIASES.get(self.op, self.op)
        if op not in FILTER_OPERATORS:
            raise ValueError(f"Unknown filter operator: {self.op}")
        object.__setattr__(self, "op", op)
        if op == "in":
            if isinstance(self.value, (str, bytes)) or not hasattr(self.value, "__iter__"):
                raise ValueError(f"Filter 'in' on {self.column} needs a list of values")
            object.__setattr__(self, "value", tuple(self.value))
        if op == "contains" and not isinstance(self.value, str):
            raise ValueError(f"Filter 'contains' on {self.column} needs a string value")

    @classmethod
    def from_dict(cls, d: dict) -> "FilterSpec":
        if "column" not in d or "value" not in d:
            raise ValueError(f"A filter needs 'column' and 'value': {d!r}")
        return cls(d["column"], d["value"], d.get("op", d.get("operator", "==")))


@dataclass(frozen=True)
class ComputedField:
    """``name = expression``; the expression is a structured tree, a SQL
    string, or a ``pyspark.sql.Column`` built in Python."""

    name: str
    expression: Any

    @classmethod
    def from_dict(cls, d: dict) -> "ComputedField":
        if "name" not in d or "expression" not in d:
            raise ValueError(f"A computed field needs 'name' and 'expression': {d!r}")
        return cls(d["name"], d["expression"])


@dataclass(frozen=True)
class AggregationSpec:
    """``operation(column) AS alias``; alias defaults to ``{operation}_{column}``."""

    column: str
    operation: str
    alias: str | None = None

    def __post_init__(self) -> None:
        from kpimart.functions.registry import aggregate_names

        if self.operation not in AGGREGATE_OPERATIONS and self.operation not in aggregate_names():
            raise ValueError(f"Unknown aggregation operation: {self.operation}")

    @property
    def output_name(self) -> str:
        return self.alias if self.alias is not None else f"{self.operation}_{self.column}"

    @classmethod
    def from_dict(cls, d: dict) -> "AggregationSpec":
        if "operation" not in d:
            raise ValueError(f"An aggregation needs 'operation': {d!r}")
        return cls(d.get("column", ""), d["operation"], d.get("alias"))


@dataclass(frozen=True)
class PipelineConfig:
    """filters -> computed fields -> aggregate.

    ``aggregations is None`` means the key was absent: rows pass through
    unchanged even if ``group_by`` is set. ``aggregations == ()`` with keys
    means one row per distinct key tuple.
    """

    filters: tuple[FilterSpec, ...] = ()
    computed_fields: tuple[ComputedField, ...] = ()
    aggregations: tuple[AggregationSpec, ...] | None = None
    group_by: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "filters", tuple(self.filters))
        object.__setattr__(self, "computed_fields", tuple(self.computed_fields))
        object.__setattr__(self, "group_by", tuple(self.group_by))
        if self.aggregations is not None:
            object.__setattr__(self, "aggregations", tuple(self.aggregations))
            check_output_names(self.group_by, self.aggregations)

    @classmethod
    def from_dict(cls, d: dict | None) -> "PipelineConfig":
        d = d or {}
        filters = d.get("filters", [])
        if filters and not all(isinstance(f, dict) for f in filters):
            raise ValueError("Pipeline filters must be a list of {column, value} objects")
        aggs = d.get("aggregations")
        return cls(
            filters=tuple(FilterSpec.from_dict(f) for f in filters),
            computed_fields=tuple(ComputedField.from_dict(c) for c in d.get("computed_fields", [])),
            aggregations=None if aggs is None else tuple(AggregationSpec.from_dict(a) for a in aggs),
            group_by=tuple(d.get("group_by", []) or []),
        )

    @classmethod
    def from_json(cls, text: str) -> "PipelineConfig":
        return cls.from_dict(_loads(text))


def check_output_names(group_by: tuple[str, ...], aggregations: tuple[AggregationSpec, ...]) -> None:
    """Duplicate keys, duplicate aliases and alias = key are errors (Spark
    would accept them silently)."""
    seen: set[str] = set()
    for key in group_by:
        if key in seen:
            raise ValueError(f"Duplicate group key: {key}")
        seen.add(key)
    for agg in aggregations:
        name = agg.output_name
        if name in group_by:
            raise ValueError(f"Aggregation alias equals a group key: {name}")
        if name in seen:
            raise ValueError(f"Duplicate aggregation alias: {name}")
        seen.add(name)


@dataclass(frozen=True)
class ChartConfig:
    """Chart data request: ``type``, ``x`` and ``y`` (a name or a list);
    dot charts may add ``size`` and ``color``."""

    type: str
    x: str
    y: tuple[str, ...]
    size: str | None = None
    color: str | None = None

    def __post_init__(self) -> None:
        if self.type not in CHART_TYPES:
            raise ValueError(f"Unknown chart type: {self.type}")
        if not self.x:
            raise ValueError("A chart needs 'x'")
        y = (self.y,) if isinstance(self.y, str) else tuple(self.y)
        if not y or not all(isinstance(v, str) and v for v in y):
            raise ValueError("A chart needs 'y' as a column name or a list of names")
        object.__setattr__(self, "y", y)

    @property
    def columns(self) -> tuple[str, ...]:
        extra = tuple(c for c in (self.size, self.color) if c)
        return (self.x, *self.y, *extra)

    @classmethod
    def from_dict(cls, d: dict) -> "ChartConfig":
        for k in ("type", "x", "y"):
            if k not in d:
                raise ValueError(f"A chart needs '{k}': {d!r}")
        return cls(d["type"], d["x"], d["y"], d.get("size"), d.get("color"))


@dataclass(frozen=True)
class ViewConfig:
    charts: tuple[ChartConfig, ...] = ()
    filters: tuple[str, ...] = ()

    @classmethod
    def from_dict(cls, d: dict | None) -> "ViewConfig":
        d = d or {}
        filters = d.get("filters", [])
        if not all(isinstance(f, str) for f in filters):
            raise ValueError("View filters must be a list of column names")
        return cls(tuple(ChartConfig.from_dict(c) for c in d.get("charts", [])), tuple(filters))


@dataclass(frozen=True)
class DashboardConfig:
    pipeline: PipelineConfig = field(default_factory=PipelineConfig)
    view: ViewConfig = field(default_factory=ViewConfig)
    name: str = "Unnamed Dashboard"

    @classmethod
    def from_dict(cls, d: dict | None) -> "DashboardConfig":
        """Accepts ``{"pipeline": {...}, "view": {...}}`` or the flat form in
        which pipeline keys sit at the top level next to ``charts``; a
        top-level ``filters`` list of names is the view's, of objects the
        pipeline's."""
        d = dict(d or {})
        name = d.get("name", "Unnamed Dashboard")
        if "pipeline" in d or "view" in d:
            return cls(PipelineConfig.from_dict(d.get("pipeline")), ViewConfig.from_dict(d.get("view")), name)
        filters = d.get("filters", [])
        view_filters = filters if filters and all(isinstance(f, str) for f in filters) else []
        pipe = {k: d[k] for k in PIPELINE_KEYS if k in d}
        if view_filters:
            pipe.pop("filters", None)
        return cls(
            PipelineConfig.from_dict(pipe),
            ViewConfig.from_dict({"charts": d.get("charts", []), "filters": view_filters}),
            name,
        )

    @classmethod
    def from_json(cls, text: str | None) -> "DashboardConfig":
        return cls.from_dict(_loads(text))


def _loads(text: str | None) -> dict:
    if text is None or text == "":
        return {}
    try:
        value = json.loads(text)
    except json.JSONDecodeError as exc:
        raise ValueError(f"Config is not valid JSON: {exc}") from exc
    if not isinstance(value, dict):
        raise ValueError("Config must be a JSON object")
    return value
