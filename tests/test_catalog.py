"""Every catalog query against its DuckDB oracle (sf0.001), plus plan checks:
no cartesian product, no nested-loop join, no window without partitioning."""

import re

import duckdb
import pytest

import __spark_entry__ as entry_mod
from kpimart.plans import catalog
from kpimart.plans.oracle import result_digest
from kpimart.sources.tables import TABLES

# the engine's own queries; the training-data operators have tests of their own
QUERIES = catalog.queries()
ORACLES = {k: v for k, v in entry_mod.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_small}/{t}.parquet')")
    yield con
    con.close()


def test_every_query_is_registered_and_has_an_oracle():
    assert set(QUERIES) <= set(entry_mod.queries())
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle_and_plan_is_sound(spark, sf_small, duck, name):
    df = QUERIES[name](spark, sf_small)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLES[name])
    o_cols = [d[0] for d in res.description]
    o_rows = [tuple(r) for r in res.fetchall()]
    assert sorted(df.columns) == sorted(o_cols)
    assert len(rows) == len(o_rows)
    assert result_digest(df.columns, rows) == result_digest(o_cols, o_rows)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"Window \[.*\], \[\], ", plan), "window without partitioning"


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["category", "year", "sales", "prev_sales", "yoy"]
    assert df.count() > 0


def _final_plan(df) -> str:
    """The executed (AQE final) plan text, initial-plan blocks removed."""
    df.collect()
    out, skip = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :|"))
        if skip is not None and depth > skip:
            continue
        skip = None
        if "== Initial Plan ==" in line:
            skip = depth
            continue
        out.append(line)
    return "\n".join(out)


FACT_QUERIES = sorted(n for n in QUERIES if n.startswith(("flt_", "prj_", "agg_", "met_", "cht_")) and n not in ("met_share_cols", "prj_growth", "prj_grouped", "met_merge"))


@pytest.mark.parametrize("name", FACT_QUERIES)
def test_one_scan_of_the_fact_per_plan(spark, sf_small, name):
    plan = _final_plan(QUERIES[name](spark, sf_small))
    scans = plan.count("FileScan parquet")
    subqueries = len(re.findall(r"Subquery subquery", plan))
    assert 1 <= scans <= 1 + subqueries, (name, scans, subqueries)
