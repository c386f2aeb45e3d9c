"""Named processors (REG-1) and named custom metrics (MET-4).

Two registries, both "last registration wins":

* transformations: ``DataFrame -> DataFrame`` callables (or classes whose
  instances are such callables), applied with ``df.transform``;
* aggregates: builders ``(df, column) -> Column`` returning an aggregate
  expression, usable as an ``operation`` in a pipeline config next to the
  built-in ones, so custom metrics run in the same single aggregation pass;
* mergeable metrics: for what has no native expression, three Python steps on
  a small state (see ``kpimart.operators.mergeable``). They share the names of
  the aggregates; the last registration of a name wins over both kinds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame

_TRANSFORMATIONS: dict[str, Any] = {}
_AGGREGATES: dict[str, Callable[[DataFrame, str], Column]] = {}


@dataclass(frozen=True)
class MergeableMetric:
    """``partial`` makes a state of an Arrow array of values (an empty one
    too), ``merge`` one state of two, ``finish`` the value of a state.
    ``state`` and ``result`` are Spark types as DDL."""

    state: str
    result: str
    partial: Callable[[Any], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any]


_MERGEABLE: dict[str, MergeableMetric] = {}


def register(name: str):
    """Decorator: store a transformation under ``name`` (last one wins)."""

    def wrapper(obj):
        _TRANSFORMATIONS[name] = obj
        return obj

    return wrapper


def get_transformation(name: str):
    """The registered transformation, or None."""
    return _TRANSFORMATIONS.get(name)


def transformation_names() -> list[str]:
    return list(_TRANSFORMATIONS)


def apply_transformation(df: DataFrame, name: str, **kwargs) -> DataFrame:
    """Run a registered transformation; classes are instantiated with kwargs."""
    obj = get_transformation(name)
    if obj is None:
        raise ValueError(f"Unknown transformation: {name}")
    fn = obj(**kwargs) if isinstance(obj, type) else (lambda d: obj(d, **kwargs))
    return df.transform(fn)


def register_aggregate(name: str):
    """Decorator: store a custom aggregate builder ``(df, column) -> Column``."""

    def wrapper(fn: Callable[[DataFrame, str], Column]):
        _MERGEABLE.pop(name, None)
        _AGGREGATES[name] = fn
        return fn

    return wrapper


def get_aggregate(name: str) -> Callable[[DataFrame, str], Column] | None:
    return _AGGREGATES.get(name)


def register_mergeable(name: str, metric: MergeableMetric) -> MergeableMetric:
    """Store a mergeable metric under ``name`` (last one wins)."""
    _AGGREGATES.pop(name, None)
    _MERGEABLE[name] = metric
    return metric


def get_mergeable(name: str) -> MergeableMetric | None:
    return _MERGEABLE.get(name)


def aggregate_names() -> list[str]:
    return [*_AGGREGATES, *_MERGEABLE]


def unregister_aggregate(name: str) -> bool:
    found = _AGGREGATES.pop(name, None), _MERGEABLE.pop(name, None)
    return any(f is not None for f in found)
