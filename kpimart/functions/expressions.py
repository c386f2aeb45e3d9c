"""Computed-field expressions: structured tree / SQL string / Column -> Column.

Structured form (preferred; JSON-safe)::

    {"col": "quantity"}                      column reference (exact case)
    {"lit": 2}                               literal
    {"op": "+", "args": [e1, e2, ...]}       + - * /  (n-ary, left to right)
    {"op": "neg", "args": [e]}               unary minus
    {"cast": e, "to": "decimal(18,2)"}       cast to a Spark DDL type
    {"agg": "max", "arg": e}                 aggregate over the whole frame
    {"agg": "sum", "arg": e, "over": [k]}    aggregate per group of keys k

``/`` is ``try_divide``: a zero or null divisor gives null, under any ANSI
setting. Arithmetic operands must be numeric; this is checked against the
frame's schema at build time (analysis only, no job).

Aggregates inside a row expression are not evaluated with a window over the
whole frame (that would pull every row into one task): the whole-frame form
becomes a scalar subquery (``DataFrame.scalar()``: one partial + final
aggregate, its single value used as a literal), and the grouped form becomes
a grouped aggregate joined back on the keys (see ``kpimart.operators.computed``).

A SQL string is the trusted-author form and goes through ``F.expr``;
subqueries are rejected. A ``Column`` built in Python is used as given.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpimart.functions.columns import is_numeric, nan_to_null, require_columns, safe_divide, sum_type

ARITHMETIC = {"+", "-", "*", "/"}
AGGREGATES = {"sum", "mean", "avg", "count", "min", "max"}
_SUBQUERY = re.compile(r"\bselect\b", re.IGNORECASE)


@dataclass
class GroupedAggregate:
    """A per-group aggregate found inside an expression; computed by the
    caller as ``groupBy(keys).agg(...)`` and joined back under ``name``."""

    name: str
    keys: tuple[str, ...]
    expr: Column


@dataclass
class CompiledExpression:
    column: Column
    grouped: list[GroupedAggregate] = field(default_factory=list)


class _Context:
    """Compilation state: the frame, the per-group aggregates found so far,
    and a probe frame in which each of them exists as a typed null column
    (so operand types can be checked before the aggregates are joined in)."""

    def __init__(self, df: DataFrame, field_name: str):
        self.df = df
        self.probe = df
        self.grouped: list[GroupedAggregate] = []
        self.field_name = field_name


def compile_expression(df: DataFrame, expr, field_name: str = "expr") -> CompiledExpression:
    """Compile a computed-field expression against ``df``'s schema."""
    ctx = _Context(df, field_name)
    col = _compile(ctx, expr)
    return CompiledExpression(col, ctx.grouped)


def _dtype(df: DataFrame, c: Column) -> T.DataType:
    try:
        return df.select(c.alias("_t")).schema["_t"].dataType
    except AnalysisException as exc:
        raise ValueError(f"Invalid expression: {exc}") from exc


def _compile(ctx: _Context, node) -> Column:
    df = ctx.df
    if isinstance(node, Column):
        return node
    if isinstance(node, str):
        if _SUBQUERY.search(node):
            raise ValueError(f"Subqueries are not allowed in expressions: {node!r}")
        c = F.expr(node)
        _dtype(df, c)  # resolve now: unknown columns fail at build time
        return c
    if isinstance(node, (int, float, bool)) or node is None:
        return F.lit(node)
    if not isinstance(node, dict):
        raise ValueError(f"Unsupported expression node: {node!r}")

    if "col" in node:
        require_columns(df, [node["col"]])
        return F.col(node["col"])
    if "lit" in node:
        return F.lit(node["lit"])
    if "cast" in node:
        if "to" not in node:
            raise ValueError(f"A cast needs 'to': {node!r}")
        return _compile(ctx, node["cast"]).cast(node["to"])
    if "agg" in node:
        return _compile_aggregate(ctx, node)
    if "op" in node:
        op = node["op"]
        args = [_compile(ctx, a) for a in node.get("args", [])]
        for a in args:
            dt = _dtype(ctx.probe, a)
            if not is_numeric(dt) and not isinstance(dt, T.NullType):
                raise ValueError(f"Operator {op} needs numeric operands, got {dt.simpleString()}")
        if op == "neg":
            if len(args) != 1:
                raise ValueError("neg takes one argument")
            return -args[0]
        if op not in ARITHMETIC:
            raise ValueError(f"Unknown operator: {op}")
        if len(args) < 2:
            raise ValueError(f"Operator {op} takes at least two arguments")
        out = args[0]
        for a in args[1:]:
            if op == "+":
                out = out + a
            elif op == "-":
                out = out - a
            elif op == "*":
                out = out * a
            else:
                out = safe_divide(out, a)
        return out
    raise ValueError(f"Unsupported expression node: {node!r}")


def aggregate_column(df: DataFrame, fn: str, arg: Column) -> Column:
    """Aggregate with the engine's semantics: sum of nothing is 0, min/max
    ignore NaN, count counts rows."""
    if fn not in AGGREGATES:
        raise ValueError(f"Unknown aggregation operation: {fn}")
    if fn == "count":
        return F.count(F.lit(1))
    dt = _dtype(df, arg)
    if fn in ("sum", "mean", "avg") and not is_numeric(dt):
        raise ValueError(f"{fn} needs a numeric argument, got {dt.simpleString()}")
    if fn == "sum":
        return F.coalesce(F.sum(arg), F.lit(0).cast(sum_type(dt)))
    if fn in ("mean", "avg"):
        return F.avg(arg)
    if fn == "min":
        return F.min(nan_to_null(arg, dt))
    return F.max(nan_to_null(arg, dt))


def _compile_aggregate(ctx: _Context, node: dict) -> Column:
    df = ctx.df
    fn = node["agg"]
    arg = _compile(ctx, node.get("arg", {"lit": 1}))
    agg = aggregate_column(df, fn, arg)
    over = tuple(node.get("over", ()) or ())
    if not over:
        # Whole-frame aggregate as a scalar subquery: no join, no global window.
        return df.agg(agg.alias("_v")).scalar()
    require_columns(df, over, "group key")
    name = f"__{ctx.field_name}_agg{len(ctx.grouped)}"
    ctx.grouped.append(GroupedAggregate(name, over, agg))
    agg_type = df.select(agg.alias("_t")).schema["_t"].dataType  # analysis only
    ctx.probe = ctx.probe.withColumn(name, F.lit(None).cast(agg_type))
    return F.col(name)
