"""Column-level building blocks: expression compiler, schema checks, registries."""

from kpimart.functions.expressions import aggregate_column, compile_expression
from kpimart.functions.registry import (
    apply_transformation,
    get_aggregate,
    get_transformation,
    register,
    register_aggregate,
)

__all__ = [
    "aggregate_column",
    "apply_transformation",
    "compile_expression",
    "get_aggregate",
    "get_transformation",
    "register",
    "register_aggregate",
]
