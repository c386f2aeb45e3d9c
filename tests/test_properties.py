"""Property tests: random frames and configs against a pandas brute force of
the same semantics (sum of nothing is 0, min/max ignore NaN, count counts
rows, null keys form a group, filters drop nulls)."""

import math

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kpimart.config import AggregationSpec, FilterSpec
from kpimart.operators.aggregate import aggregate
from kpimart.operators.filters import apply_row_filters

KEYS = st.sampled_from(["a", "b", "c", None])
VALUES = st.one_of(st.none(), st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), st.just(float("nan")))
ROWS = st.lists(st.tuples(KEYS, KEYS, VALUES), min_size=0, max_size=25)
OPS = st.lists(st.sampled_from(["sum", "count", "min", "max", "mean"]), min_size=1, max_size=4, unique=True)
SCHEMA = "k1 string, k2 string, v double"

SETTINGS = settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _brute(rows, ops, keys):
    groups: dict = {}
    for k1, k2, v in rows:
        key = tuple({"k1": k1, "k2": k2}[k] for k in keys)
        groups.setdefault(key, []).append(v)
    if not keys:
        groups = {(): [r[2] for r in rows]}
    out = {}
    for key, vals in groups.items():
        nums = [v for v in vals if v is not None]
        finite = [v for v in nums if not math.isnan(v)]
        res = {}
        for op in ops:
            if op == "count":
                res[op] = len(vals)
            elif op == "sum":
                res[op] = sum(nums) if nums else 0.0
            elif op == "mean":
                res[op] = (sum(nums) / len(nums)) if nums else None
            elif op == "min":
                res[op] = min(finite) if finite else None
            else:
                res[op] = max(finite) if finite else None
        out[key] = res
    return out


def _close(a, b):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) and math.isnan(a):
        return isinstance(b, float) and math.isnan(b)
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-6)


@SETTINGS
@given(rows=ROWS, ops=OPS, keys=st.sampled_from([(), ("k1",), ("k1", "k2")]))
def test_aggregate_matches_brute_force(spark, rows, ops, keys):
    df = spark.createDataFrame(rows, SCHEMA)
    specs = [AggregationSpec("v", op) for op in ops]
    got = {tuple(r[k] for k in keys): r for r in aggregate(df, specs, keys).collect()}
    want = _brute(rows, ops, keys)
    if keys:
        assert set(got) == set(want)
    else:
        assert len(got) == 1  # one row even on empty input
    for key, res in want.items():
        for op in ops:
            assert _close(got[key][f"{op}_v"], res[op]), (key, op, got[key][f"{op}_v"], res[op])


@SETTINGS
@given(rows=ROWS, op=st.sampled_from(["==", "!=", ">", "<", ">=", "<="]), value=st.floats(min_value=-1e6, max_value=1e6))
def test_numeric_filters_match_pandas(spark, rows, op, value):
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(repr(tuple(r)) for r in apply_row_filters(df, [FilterSpec("v", value, op)]).collect())
    pdf = pd.DataFrame(rows, columns=["k1", "k2", "v"], dtype=object)
    cmp = {"==": lambda x: x == value, "!=": lambda x: x != value, ">": lambda x: x > value,
           "<": lambda x: x < value, ">=": lambda x: x >= value, "<=": lambda x: x <= value}[op]

    def keep(v):
        if v is None:
            return False  # comparisons with null drop the row
        if math.isnan(v):
            # Spark orders NaN above every number and NaN = NaN
            return {"==": False, "!=": True, ">": True, "<": False, ">=": True, "<=": False}[op]
        return cmp(v)

    want = sorted(repr(tuple(r)) for r in rows if keep(r[2]))
    assert got == want
    assert len(pdf) == len(rows)
