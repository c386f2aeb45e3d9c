"""The derived inputs keep the canonical schemas (FIXTURES.md §3) and whole rows."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import pyarrow.parquet as pq
import pytest

from kpimart.plans import marts
from kpimart.sources.tables import table


def _ddl(df):
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def test_schemas(spark, sf_small):
    assert _ddl(marts.sales_fact(spark, sf_small)) == (
        "year int, category string, brand string, region string, sales decimal(18,2), quantity double, id bigint"
    )
    assert _ddl(marts.staged_sales_fact(spark, sf_small)) == _ddl(marts.sales_fact(spark, sf_small))
    assert _ddl(marts.users(spark, sf_small)) == "user_id bigint, role string"
    assert _ddl(marts.dashboards(spark, sf_small)) == "dashboard_id bigint, name string, config string, owner_id bigint"
    assert _ddl(marts.access(spark, sf_small)) == "user_id bigint, dashboard_id bigint"


def test_fact_keeps_every_lineitem_row(spark, sf_small):
    n = table(spark, sf_small, "lineitem").count()
    assert marts.sales_fact(spark, sf_small).count() == n
    assert marts.staged_sales_fact(spark, sf_small).count() == n


def test_staged_copy_is_reused_and_refreshed(spark, sf_small):
    a = marts.staged_sales_fact(spark, sf_small)
    b = marts.staged_sales_fact(spark, sf_small)
    assert a.inputFiles() == b.inputFiles()
    c = marts.staged_sales_fact(spark, sf_small, refresh=True)
    assert set(c.inputFiles()).isdisjoint(a.inputFiles())
    assert sorted(c.collect()) == sorted(a.collect())


def test_dashboard_configs_parse(spark, sf_small):
    from kpimart.plans.fanout import dashboard_configs

    configs = dashboard_configs(marts.dashboards(spark, sf_small))
    assert len(configs) == 25
    cfg = configs[3]
    assert cfg.pipeline.filters[0].column == "region" and cfg.pipeline.group_by == ("category", "year")
    assert cfg.view.filters == ("year", "category")


@pytest.fixture
def star(spark, tmp_path):
    """A star schema of a few hundred rows with repeated and null keys, and
    the fact's rows as joined by hand."""
    rnd = random.Random(6)
    key = lambda n: None if rnd.random() < 0.05 else rnd.randrange(n)
    days = [None, *(dt.datetime(y, 6, 1) for y in (1993, 1994, 1996))]
    nation = [(0, "N_0"), (1, "N_1"), (2, None)]
    supplier = [(k, key(3)) for k in (*range(9), 3, None)]
    part = [(k, rnd.choice(["PROMO", "ECONOMY", None]), f"Brand#{rnd.randrange(4)}") for k in (*range(12), 5, None)]
    orders = [(k, rnd.choice(days)) for k in (*range(60), 7, 7, None)]
    lineitem = [(key(62), key(13), key(10), rnd.randrange(100, 10**7) / 100, float(rnd.randrange(50))) for _ in range(800)]
    lineitem += lineitem[:20]
    ddl = {
        "nation": (nation, "n_nationkey int, n_name string"),
        "supplier": (supplier, "s_suppkey bigint, s_nationkey int"),
        "part": (part, "p_partkey bigint, p_type string, p_brand string"),
        "orders": (orders, "o_orderkey bigint, o_orderdate timestamp"),
        "lineitem": (lineitem, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_extendedprice double, l_quantity double"),
    }
    for name, (rows, schema) in ddl.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    same = lambda a, b: a is not None and a == b
    want = Counter(
        (o[1] and o[1].year, p[1], p[2], n[1], Decimal(f"{li[3]:.2f}"), li[4], li[0])
        for li in lineitem
        for o in orders if same(li[0], o[0])
        for p in part if same(li[1], p[0])
        for s in supplier if same(li[2], s[0])
        for n in nation if same(s[1], n[0])
    )
    return str(tmp_path), want


def test_staged_fact_has_every_joined_row(spark, star):
    folder, want = star
    assert Counter(map(tuple, marts.staged_sales_fact(spark, folder).collect())) == want


def test_each_staged_file_is_sorted(spark, star):
    keys = ["category", "brand", "region"]
    files = marts.staged_sales_fact(spark, star[0]).inputFiles()
    assert files
    for f in files:
        cells = pq.ParquetFile(f.removeprefix("file://")).read(columns=keys).to_pylist()
        found = [tuple((r[k] is not None, r[k] or "") for k in keys) for r in cells]  # nulls first
        assert found == sorted(found)


def test_the_fact_is_shuffled_by_its_order_join_only(spark, star):
    """The same at every size: one shuffle of either side, none for the write."""
    fact = marts.sales_fact(spark, star[0])
    for df in (fact, marts._sorted_files(fact, "year", ("category", "brand", "region"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1
        assert plan.count("Exchange hashpartitioning(") == plan.count("Exchange ") - plan.count("BroadcastExchange ") == 2
        assert "Exchange hashpartitioning(l_orderkey" in plan and "Exchange hashpartitioning(o_orderkey" in plan
