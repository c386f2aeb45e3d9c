"""Schema-level helpers: exact-case column checks, type checks, null/NaN-safe
scalar expressions. All checks read ``df.schema`` only; none starts a job."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "column") -> None:
    """Exact, case-sensitive existence check (Spark resolves names
    case-insensitively by default; the config language does not)."""
    present = set(df.columns)
    missing = [c for c in columns if c not in present]
    if missing:
        raise ValueError(f"Unknown {what}(s): {', '.join(missing)}; available: {', '.join(df.columns)}")


def column_type(df: DataFrame, name: str) -> T.DataType:
    require_columns(df, [name])
    for f in df.schema.fields:
        if f.name == name:
            return f.dataType
    raise ValueError(f"Unknown column: {name}")  # pragma: no cover


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def check_value_type(column: str, dtype: T.DataType, value: object) -> None:
    """Reject a filter value whose Python type does not fit the column type.

    Spark would silently cast ``'2023' == 2023``; the config language treats
    that as an error. ``None`` is accepted (it matches no row).
    """
    if value is None:
        return
    ok: bool
    if isinstance(dtype, T.BooleanType):
        ok = isinstance(value, bool)
    elif isinstance(dtype, T.NumericType):
        ok = isinstance(value, (int, float, Decimal)) and not isinstance(value, bool)
    elif isinstance(dtype, T.StringType):
        ok = isinstance(value, str)
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        ok = isinstance(value, (_dt.date, _dt.datetime, str))
    else:
        ok = True
    if not ok:
        raise ValueError(
            f"Type mismatch for column {column}: column is {dtype.simpleString()}, "
            f"value {value!r} is {type(value).__name__}"
        )


def sum_type(dtype: T.DataType) -> T.DataType:
    """The result type of Spark's ``sum`` over ``dtype`` (decimals widen by
    10 digits up to 38; integers sum as bigint; the rest as double)."""
    if isinstance(dtype, T.DecimalType):
        return T.DecimalType(min(38, dtype.precision + 10), dtype.scale)
    if isinstance(dtype, T.IntegralType):
        return T.LongType()
    return T.DoubleType()


def nan_to_null(c: Column, dtype: T.DataType) -> Column:
    """NaN -> null for float columns, so min/max ignore NaN."""
    if is_floating(dtype):
        return F.nanvl(c, F.lit(None).cast(dtype))
    return c


def safe_divide(a: Column, b: Column) -> Column:
    """Division that yields null for a zero or null divisor under any ANSI setting."""
    return F.try_divide(a, b)


def ratio_minus_one(cur: Column, prev: Column) -> Column:
    """Growth ratio ``cur / prev - 1``; null when prev is 0 or null."""
    return safe_divide(cur, prev) - F.lit(1)
