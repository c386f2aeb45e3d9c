"""Inputs in the engine's schemas, derived by Spark from the driver tables.

The driver tables have no year / category / brand fact, no users, no
dashboards and no grants, so these views give rows in the schemas the
operators expect (see FIXTURES.md):

    sales_fact : year int, category string, brand string, region string,
                 sales decimal(18,2), quantity double, id bigint
    users      : user_id bigint, role string
    dashboards : dashboard_id bigint, name string, config string, owner_id bigint
    access     : user_id bigint, dashboard_id bigint

They are lazy plans: Catalyst prunes every column a query does not use and
pushes filters on ``category``/``brand``/``region`` into the dimension scans
and filters on ``year`` below the join onto ``orders``. ``sales_fact`` joins
``orders`` by a shuffle at every size; the other join strategies are left to
Catalyst and AQE: the runtime size of each side decides between a broadcast
and a shuffle join (for a shuffle join with a selective dimension filter,
Spark may also inject a runtime bloom filter on ``lineitem``).
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpimart.session import scratch_dir
from kpimart.sources.tables import file_state, read_parquet, table

# The role rule of the derived users table (FIXTURES.md §3).
ADMIN_EVERY = 500
EDITOR_EVERY = 10
# Fixed value: owner of dashboard n is user 7 * n (FIXTURES.md §3).
OWNER_FACTOR = 7


def sales_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem ⋈ orders ⋈ part ⋈ supplier ⋈ nation`` in the fact schema.

    The joins are chained from ``lineitem`` so every build side is a base
    table (or its filtered scan) whose size Spark estimates from its files:
    joining two dimensions first would make Spark's size estimate of that
    pair the product of both sizes and could flip the build side onto the
    fact. ``orders`` grows with ``lineitem``, so both are shuffled on the
    order key at every size, and the bytes moved grow with the rows; its tasks
    also write the staged copy. Whether each dimension is broadcast or
    shuffle-joined is left to the planner and AQE's runtime sizes. The
    lineitem-sized stream carries only the five columns it needs; names of
    nations are joined last.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    year = F.year("o_orderdate").cast("int").alias("year")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", year).hint("merge")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = (
        li.join(supplier, li.l_suppkey == supplier.s_suppkey)
        .join(orders, li.l_orderkey == orders.o_orderkey)
        .join(part, li.l_partkey == part.p_partkey)
        .join(nation, supplier.s_nationkey == nation.n_nationkey)
    )
    return j.select(
        "year",
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.col("n_name").alias("region"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("sales"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_orderkey").alias("id"),
    )


_STAGED: dict[tuple, str] = {}
_STAGE_LOCK = threading.Lock()
FACT_SOURCES = ("lineitem", "orders", "part", "supplier", "nation")


def _fingerprint(spark: SparkSession, sf_dir: str, names) -> tuple:
    """Name, size and modification time of every source file, nested ones
    included (metadata only), so that a changed table gives a new copy."""
    states = tuple((name, file_state(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")) for name in names)
    return (spark.sparkContext.applicationId, sf_dir.rstrip("/"), states)


def _sorted_files(df: DataFrame, partition_by: str | None, sort_by: tuple[str, ...]) -> DataFrame:
    """Local sort per write task (no shuffle): Parquet row groups get narrow
    min/max ranges, so pushed filters on these columns skip row groups. The
    partition column goes first: a partitioned write sorts by it, and that
    sort replaces one that does not begin with it."""
    return df.sortWithinPartitions(*([partition_by] if partition_by else []), *sort_by)


def _stage(
    spark: SparkSession,
    key: tuple,
    purpose: str,
    build,
    refresh: bool,
    partition_by: str | None = None,
    sort_by: tuple[str, ...] = (),
) -> str:
    with _STAGE_LOCK:
        path = None if refresh else _STAGED.get(key)
        if path is None:
            path = scratch_dir(spark, purpose)
            df = build()
            if sort_by:
                df = _sorted_files(df, partition_by, sort_by)
            writer = df.write.partitionBy(partition_by) if partition_by else df.write
            writer.parquet(path)
            _STAGED[key] = path
    return path


def staged_sales_fact(spark: SparkSession, sf_dir: str, refresh: bool = False) -> DataFrame:
    """``sales_fact`` materialised once as Parquet partitioned by ``year``
    under the shared checkpoint folder, then read back.

    Dashboards aggregate a flat fact (the upload), not the star schema: the
    five-way join runs once per source state instead of once per query, its
    lineage is cut (a lost executor re-reads staged files), every query gets
    a pruned columnar scan, and a ``year`` filter becomes partition pruning.
    The copy is keyed by the source files' sizes and modification times. The
    tasks of the order join write it, a file per year each, without a further
    shuffle; AQE sizes those tasks. Each file is sorted by category, brand and
    region so filters on them skip Parquet row groups.
    """
    key = ("sales_fact", _fingerprint(spark, sf_dir, FACT_SOURCES))
    path = _stage(
        spark, key, "sales_fact", lambda: sales_fact(spark, sf_dir), refresh,
        partition_by="year", sort_by=("category", "brand", "region"),
    )
    # staged copies never change, so the path alone identifies the files
    return read_parquet(spark, path, state=()).select("year", "category", "brand", "region", "sales", "quantity", "id")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users; every 500th key admin, every 10th editor."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    role = (
        F.when(key % ADMIN_EVERY == 0, F.lit("admin"))
        .when(key % EDITOR_EVERY == 0, F.lit("editor"))
        .otherwise(F.lit("viewer"))
    )
    return c.select(key.alias("user_id"), role.alias("role"))


def dashboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as dashboards. Each dashboard's config aggregates the sales of
    its own region by category and year."""
    n = table(spark, sf_dir, "nation")
    config = F.format_string(
        '{"name": "%s", "pipeline": {"filters": [{"column": "region", "value": "%s"}], '
        '"aggregations": [{"column": "sales", "operation": "sum", "alias": "total_sales"}, '
        '{"column": "id", "operation": "count", "alias": "n"}], "group_by": ["category", "year"]}, '
        '"view": {"charts": [{"type": "bar", "x": "category", "y": "total_sales"}], '
        '"filters": ["year", "category"]}}',
        F.col("n_name"),
        F.col("n_name"),
    )
    return n.select(
        F.col("n_nationkey").cast("bigint").alias("dashboard_id"),
        F.col("n_name").alias("name"),
        config.alias("config"),
        (F.col("n_nationkey") * OWNER_FACTOR).cast("bigint").alias("owner_id"),
    )


def shaped_dashboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as dashboards of three shapes: their region's rows counted by
    category, their region's rows counted by year, and all rows by brand."""
    n = table(spark, sf_dir, "nation")
    own = '"filters": [{"column": "region", "value": "%s"}], '
    count = '"aggregations": [{"column": "id", "operation": "count", "alias": "n"}], "group_by": ["%s"]}}'
    config = (
        F.when(F.col("n_nationkey") % 3 == 0, F.format_string('{"pipeline": {' + own + count.replace("%s", "category"), "n_name"))
        .when(F.col("n_nationkey") % 3 == 1, F.format_string('{"pipeline": {' + own + count.replace("%s", "year"), "n_name"))
        .otherwise(F.lit('{"pipeline": {' + count.replace("%s", "brand")))
    )
    return n.select(F.col("n_nationkey").cast("bigint").alias("dashboard_id"), F.col("n_name").alias("name"), config.alias("config"))


def ranged_dashboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as dashboards over spans of years and of sales (one shape)."""
    config = (
        '{"pipeline": {"filters": [{"column": "year", "op": ">=", "value": %d}, {"column": "year", "op": "<", "value": %d}, '
        '{"column": "sales", "op": ">", "value": %d}], "group_by": ["category"], "aggregations": '
        '[{"column": "id", "operation": "count", "alias": "n"}, {"column": "sales", "operation": "sum", "alias": "total_sales"}]}}'
    )
    n = table(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey").cast("int"))
    first = F.lit(1992) + F.col("k") % 5
    values = (first, first + 1 + F.col("k") % 3, F.col("k") * 1000)
    return n.select(F.col("n_nationkey").cast("bigint").alias("dashboard_id"), F.format_string(config, *values).alias("config"))


def listed_dashboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as dashboards over overlapping lists of regions and years (one
    shape; a list may name a region twice)."""
    config = (
        '{"pipeline": {"filters": [{"column": "region", "op": "in", "value": ["NATION_%d", "NATION_%d", "NATION_%d"]}, '
        '{"column": "year", "op": "in", "value": [1993, %d, 1997]}], "group_by": ["brand"], "aggregations": '
        '[{"column": "id", "operation": "count", "alias": "n"}]}}'
    )
    n = table(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey").cast("int"))
    k = F.col("k")
    values = (k, (k + 1) % 25, (k + k % 2) % 25, F.lit(1992) + k % 7)
    return n.select(F.col("n_nationkey").cast("bigint").alias("dashboard_id"), F.format_string(config, *values).alias("config"))


def relative_dashboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as dashboards of one shape with aggregates inside computed
    fields: how far a sale is below the dashboard's greatest one, and above the
    least one of its brand there."""
    config = (
        '{"pipeline": {"filters": [{"column": "region", "value": "%s"}, {"column": "year", "op": ">=", "value": %d}], "computed_fields": ['
        '{"name": "below", "expression": {"op": "-", "args": [{"agg": "max", "arg": {"col": "sales"}}, {"col": "sales"}]}}, '
        '{"name": "above", "expression": {"op": "-", "args": [{"col": "sales"}, {"agg": "min", "arg": {"col": "sales"}, "over": ["brand"]}]}}], '
        '"group_by": ["category"], "aggregations": [{"column": "below", "operation": "sum", "alias": "below"}, '
        '{"column": "above", "operation": "sum", "alias": "above"}, {"column": "id", "operation": "count", "alias": "n"}]}}'
    )
    n = table(spark, sf_dir, "nation")
    first = F.lit(1992) + F.col("n_nationkey").cast("int") % 5
    return n.select(F.col("n_nationkey").cast("bigint").alias("dashboard_id"), F.format_string(config, "n_name", first).alias("config"))


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants: each customer sees the dashboards (nations) of the suppliers
    of its orders. Duplicates are left in, as in a grant table without a
    uniqueness constraint; operators de-duplicate on use."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = o.join(li, o.o_orderkey == li.l_orderkey).join(s, li.l_suppkey == s.s_suppkey)
    return j.select(F.col("o_custkey").alias("user_id"), F.col("s_nationkey").cast("bigint").alias("dashboard_id"))


def staged_access(spark: SparkSession, sf_dir: str, refresh: bool = False) -> DataFrame:
    """The grants table materialised once (de-duplicated, as a grant table
    would be stored), keyed by its source files like ``staged_sales_fact``."""
    key = ("access", _fingerprint(spark, sf_dir, ("orders", "lineitem", "supplier")))
    path = _stage(spark, key, "access", lambda: access(spark, sf_dir).distinct(), refresh)
    return read_parquet(spark, path, state=())


def access_requests(spark: SparkSession, sf_dir: str, dashboard_slots: int = 30) -> DataFrame:
    """A batch of ``(user_id, dashboard_id)`` access requests: each order asks
    for one of ``dashboard_slots`` dashboard ids, some of which do not exist."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % dashboard_slots).alias("dashboard_id")
    ).distinct()
