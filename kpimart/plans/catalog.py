"""The query catalog: one DataFrame-API query per operator group of the
survey's inventory, each built from the library's own operators on the
driver tables (``(spark, sf_dir) -> DataFrame``). Their SQL oracles live in
``kpimart.plans.oracle``.

Every query reads whole tables; none uses id subsets or row caps.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpimart.config import AggregationSpec, ChartConfig, ComputedField, FilterSpec, PipelineConfig
from kpimart.functions.registry import MergeableMetric, apply_transformation, register, register_aggregate, register_mergeable
from kpimart.operators.aggregate import aggregate
from kpimart.operators.charts import chart_dataset, combined_datasets, multi_series
from kpimart.operators.computed import growth_ratio, with_computed_fields
from kpimart.operators.entitlements import (
    authorize,
    dashboard_if_permitted,
    denied,
    effective_access,
    entitled_rows,
    role_gate,
    visible_dashboards,
)
from kpimart.operators.filters import GlobalFilters, apply_filters, apply_row_filters
from kpimart.operators.latest import latest_per_key
from kpimart.operators.metrics import ratio_of_sums, share, share_of_parent, share_of_total, yoy
from kpimart.plans import marts
from kpimart.plans.dashboards import PipelineDashboard, StoredDashboard
from kpimart.plans.families import fan_out_table
from kpimart.plans.fanout import fan_out, trigger_processing
from kpimart.plans.processing import run
from kpimart.session import scratch_dir
from kpimart.sinks.codec import from_json_lines, to_json_lines, write_json
from kpimart.sinks.store import SnapshotStore, path_exists
from kpimart.sources.csv import admit_files, list_files, load_csv, validate_files, write_csv_gz
from kpimart.sources.tables import table
from kpimart.streaming.log import UploadLog
from kpimart.streaming.upload import upload_stream

Query = Callable[[SparkSession, str], DataFrame]


def _double(df: DataFrame, *names: str) -> DataFrame:
    """Present exact decimal results as double (one rounding, at the end)."""
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def _agg(column: str, operation: str, alias: str | None = None) -> AggregationSpec:
    return AggregationSpec(column, operation, alias)


# ---------------------------------------------------------------- filters


def flt_eq(spark: SparkSession, d: str) -> DataFrame:
    """FLT-1: config equality filters, AND-ed in order."""
    cfg = PipelineConfig(filters=(FilterSpec("year", 1997), FilterSpec("category", "ECONOMY")))
    return run(marts.staged_sales_fact(spark, d), cfg).select("year", "category", "brand", "id", "quantity")


def flt_ops(spark: SparkSession, d: str) -> DataFrame:
    """FLT-2/FLT-3/SCL-2: comparisons, ``in`` and literal ``contains``."""
    cfg = PipelineConfig.from_dict(
        {
            "filters": [
                {"column": "year", "op": ">=", "value": 1996},
                {"column": "category", "op": "in", "value": ["ECONOMY", "PROMO"]},
                {"column": "brand", "op": "!=", "value": "Brand#1"},
                {"column": "quantity", "op": ">", "value": 49},
                {"column": "region", "op": "contains", "value": "N_1"},
            ]
        }
    )
    return run(marts.staged_sales_fact(spark, d), cfg).select("year", "category", "brand", "id", "quantity")


def flt_strict(spark: SparkSession, d: str) -> DataFrame:
    """FLT-4/FLT-8: strict typed global filters, then count by region."""
    f = apply_filters(marts.staged_sales_fact(spark, d), year=1998, brand="Brand#2")
    return aggregate(f, [_agg("id", "count", "n")], ["region"])


def flt_lenient(spark: SparkSession, d: str) -> DataFrame:
    """FLT-5: lenient filter set; ``channel`` is not a column and is skipped."""
    gf = GlobalFilters().set_filter("year", 1998).set_filter("channel", "web")
    return aggregate(gf.apply_to_dataframe(marts.staged_sales_fact(spark, d)), [_agg("id", "count", "n")], ["category"])


_SALES_BY_CATEGORY = PipelineConfig(aggregations=(AggregationSpec("sales", "sum", "total_sales"),), group_by=("category",))


def flt_pre_agg(spark: SparkSession, d: str) -> DataFrame:
    """FLT-6: request filter on raw rows, before the pipeline."""
    raw = apply_row_filters(marts.staged_sales_fact(spark, d), [FilterSpec("region", "NATION_3")])
    return _double(run(raw, _SALES_BY_CATEGORY), "total_sales")


def flt_post_agg(spark: SparkSession, d: str) -> DataFrame:
    """FLT-7: request filters on the aggregate (a measure and a key)."""
    agg = run(marts.staged_sales_fact(spark, d), _SALES_BY_CATEGORY)
    kept = apply_row_filters(agg, [FilterSpec("total_sales", 1000000, ">"), FilterSpec("category", "PROMO", "!=")])
    return _double(kept, "total_sales")


# ------------------------------------------------------- computed fields


def prj_chain(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-1/PRJ-2/SCL-1: chained computed fields with safe division."""
    cfg = PipelineConfig(
        computed_fields=(
            ComputedField("q2", {"op": "+", "args": [{"op": "*", "args": [{"col": "quantity"}, {"lit": 2}]}, {"lit": 1}]}),
            ComputedField("q3", {"op": "/", "args": [{"col": "q2"}, {"lit": 4}]}),
        ),
    )
    return run(marts.staged_sales_fact(spark, d), cfg).select("id", "category", "q2", "q3")


def prj_broadcast(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-4: a whole-frame aggregate inside a row expression (scalar
    subquery) over the whole fact."""
    below = ComputedField("below_max", {"op": "-", "args": [{"agg": "max", "arg": {"col": "quantity"}}, {"col": "quantity"}]})
    f = with_computed_fields(marts.staged_sales_fact(spark, d), [below])
    return f.select("id", "category", "quantity", "below_max")


def prj_grouped(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-4: a per-group aggregate inside a row expression (``over``)."""
    below = ComputedField(
        "below_max", {"op": "-", "args": [{"agg": "max", "arg": {"col": "quantity"}, "over": ["brand"]}, {"col": "quantity"}]}
    )
    return with_computed_fields(marts.staged_sales_fact(spark, d), [below]).select("id", "brand", "quantity", "below_max")


def prj_growth(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-3: growth of each order line's price over its order's total."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return growth_ratio(j, "l_extendedprice", "o_totalprice").select(
        F.col("o_orderkey").alias("id"), F.col("l_linenumber").alias("line"), "growth"
    )


# ------------------------------------------------------------ aggregates


def agg_sum(spark: SparkSession, d: str) -> DataFrame:
    """AGG-1/AGG-6: grouped exact sum."""
    return _double(run(marts.staged_sales_fact(spark, d), _SALES_BY_CATEGORY), "total_sales")


def agg_mean(spark: SparkSession, d: str) -> DataFrame:
    """AGG-2: mean over an exact decimal column (default alias)."""
    cfg = PipelineConfig(
        computed_fields=(ComputedField("quantity", {"cast": {"col": "quantity"}, "to": "decimal(18,2)"}),),
        aggregations=(_agg("quantity", "mean"),),
        group_by=("brand",),
    )
    return run(marts.staged_sales_fact(spark, d), cfg)


def agg_count(spark: SparkSession, d: str) -> DataFrame:
    """AGG-3/AGG-10: row count, default alias ``count_id``."""
    return run(marts.staged_sales_fact(spark, d), PipelineConfig(aggregations=(_agg("id", "count"),), group_by=("region",)))


def agg_min_max(spark: SparkSession, d: str) -> DataFrame:
    """AGG-4/AGG-5: NaN-ignoring min and max, two keys."""
    cfg = PipelineConfig(aggregations=(_agg("quantity", "min"), _agg("quantity", "max")), group_by=("category", "brand"))
    return run(marts.staged_sales_fact(spark, d), cfg)


def agg_multi(spark: SparkSession, d: str) -> DataFrame:
    """AGG-6: many keys and measures in one pass."""
    cfg = PipelineConfig(
        aggregations=(_agg("sales", "sum", "total_sales"), _agg("id", "count", "n"), _agg("quantity", "max")),
        group_by=("category", "region"),
    )
    return _double(run(marts.staged_sales_fact(spark, d), cfg), "total_sales")


def agg_global(spark: SparkSession, d: str) -> DataFrame:
    """AGG-7: global aggregate (no keys) -> one row."""
    cfg = PipelineConfig(aggregations=(_agg("sales", "sum"), _agg("id", "count")))
    return _double(run(marts.staged_sales_fact(spark, d), cfg), "sum_sales")


def agg_global_empty(spark: SparkSession, d: str) -> DataFrame:
    """AGG-7 on empty input: one row; the sum is 0, max is null."""
    cfg = PipelineConfig(
        filters=(FilterSpec("year", 2050),),
        aggregations=(_agg("sales", "sum"), _agg("id", "count"), _agg("quantity", "max")),
    )
    return _double(run(marts.staged_sales_fact(spark, d), cfg), "sum_sales")


def agg_passthrough(spark: SparkSession, d: str) -> DataFrame:
    """AGG-8: no ``aggregations`` key -> rows pass through despite ``group_by``."""
    cfg = PipelineConfig.from_dict({"group_by": ["category"]})
    return run(marts.staged_sales_fact(spark, d), cfg).select("year", "category", "brand", "id")


def agg_keys_only(spark: SparkSession, d: str) -> DataFrame:
    """AGG-9: ``aggregations: []`` -> distinct key tuples."""
    return run(marts.staged_sales_fact(spark, d), PipelineConfig(aggregations=(), group_by=("category", "brand")))


# --------------------------------------------------------------- metrics


def _sales_by(spark: SparkSession, d: str, keys: tuple[str, ...], filters=()) -> DataFrame:
    cfg = PipelineConfig(filters=tuple(filters), aggregations=(_agg("sales", "sum", "sales"),), group_by=keys)
    return run(marts.staged_sales_fact(spark, d), cfg)


def met_yoy(spark: SparkSession, d: str) -> DataFrame:
    """MET-1: year-over-year change of sales per category."""
    out = yoy(_sales_by(spark, d, ("category", "year")), "sales", "year", ["category"], prev_alias="prev_sales")
    return _double(out, "sales", "prev_sales").select("category", "year", "sales", "prev_sales", "yoy")


def met_yoy_gap(spark: SparkSession, d: str) -> DataFrame:
    """MET-1 with 1997 missing: 1998 has no previous year (null)."""
    a = _sales_by(spark, d, ("brand", "year"), [FilterSpec("year", 1997, "!=")])
    return yoy(a, "sales", "year", ["brand"]).select("brand", "year", "yoy")


def met_share_cols(spark: SparkSession, d: str) -> DataFrame:
    """MET-2: line price as a percent of its order's total."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return share(j, "l_extendedprice", "o_totalprice").select(
        F.col("o_orderkey").alias("id"), F.col("l_linenumber").alias("line"), "share"
    )


def met_share_parent(spark: SparkSession, d: str) -> DataFrame:
    """MET-3: each brand's share of its category."""
    a = _sales_by(spark, d, ("category", "brand"))
    return share_of_parent(a, "sales", ["category"]).select("category", "brand", "share")


def met_share_total(spark: SparkSession, d: str) -> DataFrame:
    """MET-3/CHT-4: each category's share of the grand total."""
    a = _sales_by(spark, d, ("category",))
    return _double(share_of_total(a, "sales"), "sales").select("category", "sales", "share")


@register_aggregate("unit_price")
def _unit_price(df: DataFrame, column: str):
    """Custom metric: revenue per unit, ``sum(sales) / sum(quantity)``."""
    return ratio_of_sums("sales", "quantity")


def met_custom(spark: SparkSession, d: str) -> DataFrame:
    """MET-4/REG-1: a registered custom metric used as an operation."""
    cfg = PipelineConfig.from_dict(
        {"aggregations": [{"column": "sales", "operation": "unit_price", "alias": "unit_price"}], "group_by": ["brand"]}
    )
    return run(marts.staged_sales_fact(spark, d), cfg)


#: The bands of the ``band_median`` metric: so many, each so wide; the last one is open.
BANDS, BAND_WIDTH = 128, 1000


def _band_counts(values):
    """The number of values per band (nulls have none; negative ones the first)."""
    whole = pc.cast(pc.floor(values.drop_null()), pa.int64()).to_numpy(zero_copy_only=False)
    return np.bincount(np.clip(whole // BAND_WIDTH, 0, BANDS - 1), minlength=BANDS).tolist()


def _band_median(counts):
    """The lower end of the band that holds the lower median; null without values."""
    reached = np.cumsum(counts)
    if not reached[-1]:
        return None
    return int(np.searchsorted(reached, (reached[-1] + 1) // 2)) * BAND_WIDTH


register_mergeable(
    "band_median",
    MergeableMetric("array<bigint>", "bigint", _band_counts, lambda a, b: [x + y for x, y in zip(a, b)], _band_median),
)


def met_merge(spark: SparkSession, d: str) -> DataFrame:
    """MET-4: a mergeable custom metric (the median's band) next to native ones."""
    cfg = PipelineConfig.from_dict(
        {
            "aggregations": [
                {"column": "sales", "operation": "band_median", "alias": "median_band"},
                {"column": "sales", "operation": "count", "alias": "n"},
                {"column": "region", "operation": "min", "alias": "first_region"},
            ],
            "group_by": ["category", "year"],
        }
    )
    return run(marts.staged_sales_fact(spark, d), cfg)


# -------------------------------------------------------------- pipeline


def pip_run(spark: SparkSession, d: str) -> DataFrame:
    """PIP-1..3: filter, computed field, grouped aggregate as one plan."""
    cfg = PipelineConfig.from_dict(
        {
            "filters": [{"column": "year", "value": 1996}],
            "computed_fields": [
                {"name": "q2", "expression": {"cast": {"op": "*", "args": [{"col": "quantity"}, {"lit": 2}]}, "to": "decimal(18,2)"}}
            ],
            "aggregations": [
                {"column": "q2", "operation": "sum", "alias": "sum_q2"},
                {"column": "q2", "operation": "count", "alias": "n"},
            ],
            "group_by": ["category", "brand"],
        }
    )
    return _double(run(marts.staged_sales_fact(spark, d), cfg), "sum_q2")


# ------------------------------------------------- fan-out and snapshots


def pip_fanout(spark: SparkSession, d: str) -> DataFrame:
    """AGG-12/PIP-6: one (already staged) input, three dashboards, rows
    written per dashboard as observed on each snapshot write (read from the
    manifest)."""
    configs = {
        1: PipelineConfig(aggregations=(), group_by=("category",)),
        2: PipelineConfig(aggregations=(_agg("id", "count", "n"),), group_by=("brand",)),
        3: PipelineConfig(aggregations=(_agg("sales", "sum", "total_sales"),), group_by=("category", "year")),
    }
    store = SnapshotStore(spark, scratch_dir(spark, "fanout-store"))
    # the staged fact already is a Parquet copy: no second staging
    results = fan_out(marts.staged_sales_fact(spark, d), configs, store, stage_input=False)
    failed = [r for r in results if r.status != "ok"]
    if failed:
        raise RuntimeError(f"fan-out failed: {failed}")
    return store.current().select(F.col("dashboard_id").cast("int"), F.col("row_count").alias("records"))


def pip_family(spark: SparkSession, d: str) -> DataFrame:
    """AGG-12 at scale: Spark plans the dashboards table into families; the
    25 region dashboards share one shape, so they run as one family (one
    join to their parameter table, one aggregate, one partitioned write) and
    are read back with ``dashboard_id``."""
    store = SnapshotStore(spark, scratch_dir(spark, "family-store"))
    dashboards = marts.dashboards(spark, d)
    status = fan_out_table(marts.staged_sales_fact(spark, d), dashboards, store, snapshot_id="family-run", stage_input=False)
    failed = status.where(F.col("status") != "ok").collect()
    if failed:
        raise RuntimeError(f"family fan-out failed: {failed}")
    out = store.read_batch("family-run").withColumn("dashboard_id", F.col("dashboard_id").cast("bigint"))
    return _double(out, "total_sales").select("dashboard_id", "category", "year", "total_sales", "n")


def _family_sums(store: SnapshotStore, snapshot_id: str) -> DataFrame:
    """Per dashboard: the rows of its current snapshot by the manifest, and the
    sum of ``n`` over the family rows read back (null for shared snapshots)."""
    sums = store.read_batch(snapshot_id).groupBy("dashboard_id").agg(F.sum("n").alias("n"))
    return store.current().select("dashboard_id", "row_count").join(sums, "dashboard_id", "left")


def pip_families(spark: SparkSession, d: str) -> DataFrame:
    """AGG-12: dashboards of three shapes (two with parameters, one shared)
    saved under one snapshot id and read back."""
    store = SnapshotStore(spark, scratch_dir(spark, "families-store"))
    boards = marts.shaped_dashboards(spark, d)
    status = fan_out_table(marts.staged_sales_fact(spark, d), boards, store, snapshot_id="shapes", stage_input=False)
    failed = status.where(F.col("status") != "ok").limit(5).collect()
    if failed:
        raise RuntimeError(f"family fan-out failed: {failed}")
    return _family_sums(store, "shapes")


def _family_rows(spark: SparkSession, d: str, boards: DataFrame, snapshot_id: str) -> DataFrame:
    """A table of dashboards of one shape run over the fact and read back."""
    store = SnapshotStore(spark, scratch_dir(spark, f"{snapshot_id}-store"))
    status = fan_out_table(marts.staged_sales_fact(spark, d), boards, store, snapshot_id=snapshot_id, stage_input=False)
    failed = status.where(F.col("status") != "ok").limit(5).collect()
    if failed:
        raise RuntimeError(f"family fan-out failed: {failed}")
    return store.read_batch(snapshot_id)


def pip_ranges(spark: SparkSession, d: str) -> DataFrame:
    """AGG-12: dashboards over spans of years and sales, one interval join."""
    out = _family_rows(spark, d, marts.ranged_dashboards(spark, d), "ranges")
    return _double(out, "total_sales").select("dashboard_id", "category", "n", "total_sales")


def pip_in_lists(spark: SparkSession, d: str) -> DataFrame:
    """AGG-12: dashboards over overlapping lists of regions and years, one
    equi-join; a row counts once for a dashboard, however often it is listed."""
    return _family_rows(spark, d, marts.listed_dashboards(spark, d), "lists").select("dashboard_id", "brand", "n")


def pip_family_inner(spark: SparkSession, d: str) -> DataFrame:
    """AGG-12/PRJ-4: dashboards whose computed fields hold aggregates, of their
    own rows and per brand, as one family."""
    out = _family_rows(spark, d, marts.relative_dashboards(spark, d), "inner")
    return _double(out, "below", "above").select("dashboard_id", "category", "below", "above", "n")


def pip_trigger(spark: SparkSession, d: str) -> DataFrame:
    """PIP-4: one upload processed for one dashboard by its own config."""
    folder = scratch_dir(spark, "trigger-upload")
    write_csv_gz(marts.staged_sales_fact(spark, d), folder)
    store = SnapshotStore(spark, scratch_dir(spark, "trigger-store"))
    result = trigger_processing(spark, folder, 3, marts.dashboards(spark, d), store, FACT_DDL)
    if result.status != "ok":
        raise RuntimeError(f"processing failed: {result.error}")
    return _double(store.get(3), "total_sales")


def snk_latest(spark: SparkSession, d: str) -> DataFrame:
    """SNK-1/SNK-2: save two results for one dashboard, read the latest."""
    store = SnapshotStore(spark, scratch_dir(spark, "snapshot-store"))
    fact = marts.staged_sales_fact(spark, d)
    count_by = lambda *keys: PipelineConfig(aggregations=(_agg("id", "count", "n"),), group_by=keys)
    store.save(7, run(fact, count_by("brand")))
    store.save(7, run(fact, count_by("brand", "year")))
    return store.get(7)


def snk_prune(spark: SparkSession, d: str) -> DataFrame:
    """SNK-4: three saves, the superseded two pruned, the last one read."""
    store = SnapshotStore(spark, scratch_dir(spark, "prune-store"))
    fact = marts.staged_sales_fact(spark, d)
    for keys in (("category",), ("region",), ("brand",)):
        store.save(7, run(fact, PipelineConfig(aggregations=(_agg("id", "count", "n"),), group_by=keys)), prune=False)
    removed = store.prune(7, retain=1)
    return store.get(7).withColumn("removed", F.lit(removed))


def snk_json(spark: SparkSession, d: str) -> DataFrame:
    """SNK-5/SNK-6/SCL-4: a result exported as JSON lines, through a folder and
    through a column, and parsed back."""
    cfg = PipelineConfig(aggregations=(_agg("sales", "sum", "total_sales"), _agg("id", "count", "n")), group_by=("category", "year"))
    result = run(marts.staged_sales_fact(spark, d), cfg)
    folder = scratch_dir(spark, "json-export")
    write_json(result, folder)
    back = spark.read.schema(result.schema).json(folder)
    return _double(from_json_lines(to_json_lines(back), result.schema), "total_sales")


def pip_get_data(spark: SparkSession, d: str) -> DataFrame:
    """PIP-5/FLT-7/FLT-9/REG-2: a stored dashboard (region NATION_3, sales by
    category and year) read back through its permitted ``year`` filter."""
    store = SnapshotStore(spark, scratch_dir(spark, "get-data-store"))
    config = {
        "name": "NATION_3 sales",
        "pipeline": {
            "filters": [{"column": "region", "value": "NATION_3"}],
            "aggregations": [{"column": "sales", "operation": "sum", "alias": "total_sales"},
                             {"column": "id", "operation": "count", "alias": "n"}],
            "group_by": ["category", "year"],
        },
        "view": {"charts": [{"type": "bar", "x": "category", "y": "total_sales"}], "filters": ["year"]},
    }
    store.save(3, PipelineDashboard(config, marts.staged_sales_fact(spark, d)).get_data())
    return _double(StoredDashboard(config, store, 3).get_data({"year": 1998}), "total_sales")


def srt_latest(spark: SparkSession, d: str) -> DataFrame:
    """SRT-1: latest event per user without a global sort."""
    return latest_per_key(table(spark, d, "events"), ["user_id"], "ts", ["event_type"], tiebreak="event_id", ts_alias="created_at")


FACT_DDL = "year int, category string, brand string, region string, sales decimal(18,2), quantity double, id bigint"


def src_csv(spark: SparkSession, d: str) -> DataFrame:
    """SRC-1: the fact written as gzip CSV (the upload), loaded back with a
    schema, then aggregated."""
    folder = scratch_dir(spark, "csv-upload")
    write_csv_gz(marts.staged_sales_fact(spark, d), folder)
    df = load_csv(spark, folder, FACT_DDL, multi_line=True)
    cfg = PipelineConfig(
        aggregations=(_agg("id", "count", "n"), _agg("sales", "sum", "total_sales")), group_by=("category", "brand")
    )
    return _double(run(df, cfg), "total_sales")


def src_admit(spark: SparkSession, d: str) -> DataFrame:
    """SRC-2: the fact as ``.csv.gz`` files in a folder per region; for each
    region whether all of its files are admitted, and whether a limit of one
    byte refuses them all. Files of other names are not listed."""
    folder = scratch_dir(spark, "admission")
    fact = marts.staged_sales_fact(spark, d)
    fact.hint("rebalance", "region").write.partitionBy("region").options(header="true", compression="gzip").csv(folder)
    region = F.regexp_extract("path", "/region=([^/]+)/", 1).alias("region")
    every = admit_files(spark, folder).groupBy(region).agg(F.bool_and("admitted").alias("admitted"))
    small = admit_files(spark, folder, max_bytes=1).groupBy(region).agg(F.bool_and(~F.col("admitted")).alias("refused"))
    return every.join(small, "region")


def _uploads(spark: SparkSession, d: str) -> str:
    """The fact as five uploads: as expected, with reordered columns, with an
    extra column in front, without a column, and with bad cells."""
    folder = scratch_dir(spark, "uploads")
    fact = marts.staged_sales_fact(spark, d)
    write_csv_gz(fact, f"{folder}/plain")
    write_csv_gz(fact.select(*reversed(fact.columns)), f"{folder}/reordered")
    write_csv_gz(fact.select(F.lit("x").alias("note"), *fact.columns), f"{folder}/extra")
    write_csv_gz(fact.drop("quantity"), f"{folder}/missing")
    bad = F.when(F.col("year") == 1997, F.lit("oops")).otherwise(F.col("sales").cast("string"))
    write_csv_gz(fact.withColumn("sales", bad), f"{folder}/bad")
    return folder


def src_validate(spark: SparkSession, d: str) -> DataFrame:
    """SRC-3/4/5: validation of the uploads, one row per upload."""
    report = validate_files(spark, _uploads(spark, d), FACT_DDL)
    return report.groupBy(F.regexp_extract("path", "/([^/]+)/[^/]+$", 1).alias("upload")).agg(
        F.bool_and("is_valid").alias("is_valid"), F.max("error").alias("error"), F.sum("bad_rows").alias("bad_rows")
    )


def src_reordered(spark: SparkSession, d: str) -> DataFrame:
    """SRC-1: one folder of files that order their columns differently, some
    with an extra one; columns are bound by name, malformed rows would fail."""
    folder = scratch_dir(spark, "reordered")
    fact = marts.staged_sales_fact(spark, d)
    write_csv_gz(fact.where("year <= 1994"), f"{folder}/a")
    write_csv_gz(fact.where("year > 1994").select(F.lit("x").alias("note"), *reversed(fact.columns)), f"{folder}/b")
    df = load_csv(spark, folder, FACT_DDL, multi_line=True, malformed="fail")
    cfg = PipelineConfig(
        aggregations=(_agg("id", "count", "n"), _agg("sales", "sum", "total_sales")), group_by=("category", "brand")
    )
    return _double(run(df, cfg), "total_sales")


def src_headers(spark: SparkSession, d: str) -> DataFrame:
    """SRC-1/SRC-5: uploads in folders of awkward names, one with a line break
    in its header; each header is read from the first lines of its file."""
    folder = scratch_dir(spark, "header-uploads")
    fact = marts.staged_sales_fact(spark, d)
    write_csv_gz(fact.select(F.lit("x").alias("a note,\nin two lines"), *fact.columns), f"{folder}/a b")
    write_csv_gz(fact, f"{folder}/50% off+1")
    write_csv_gz(fact.select(*reversed(fact.columns)), f"{folder}/[x]")
    bad = validate_files(spark, folder, FACT_DDL).where("not is_valid").count()
    cfg = PipelineConfig(
        aggregations=(_agg("id", "count", "n"), _agg("sales", "sum", "total_sales")), group_by=("category", "brand")
    )
    out = _double(run(load_csv(spark, folder, FACT_DDL, multi_line=True), cfg), "total_sales")
    return out.withColumn("bad_files", F.lit(bad))


def src_infer(spark: SparkSession, d: str) -> DataFrame:
    """SRC-1 without a schema: files with an extra column, without one, and
    with whole or broken numbers load as one schema by name."""
    folder = scratch_dir(spark, "inferred-uploads")
    fact = marts.staged_sales_fact(spark, d)
    write_csv_gz(fact.withColumn("quantity", F.col("quantity").cast("int")), f"{folder}/whole")
    broken = fact.withColumn("quantity", F.col("quantity") + 0.5)
    write_csv_gz(broken.select(F.lit("x").alias("note"), *reversed(fact.columns)), f"{folder}/extra")
    write_csv_gz(fact.drop("region"), f"{folder}/less")
    df = load_csv(spark, folder, multi_line=True)
    kinds = ",".join(sorted(f"{n}:{t}" for n, t in df.dtypes if n not in ("id", "brand")))
    out = df.groupBy("category").agg(
        F.count("id").alias("n"), F.count("region").alias("with_region"), F.sum("quantity").alias("quantity")
    )
    return out.withColumn("kinds", F.lit(kinds))


def _land_upload(df: DataFrame, incoming: str, name: str) -> None:
    """Write an upload of many ``.csv.gz`` parts elsewhere and rename its
    folder into ``incoming`` (it appears there at once)."""
    spark = df.sparkSession
    tmp = scratch_dir(spark, "landing")
    write_csv_gz(df.hint("rebalance"), tmp)
    jvm = spark.sparkContext._jvm
    src = jvm.org.apache.hadoop.fs.Path(tmp)
    fs = src.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(incoming))
    fs.rename(src, jvm.org.apache.hadoop.fs.Path(f"{incoming}/{name}"))


def _finish(q) -> None:
    """Wait for an available-now stream; fail if it failed."""
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(f"stream {q.name} failed: {q.exception()}")


_BY_CATEGORY_YEAR = PipelineConfig(aggregations=(AggregationSpec("id", "count", "n"),), group_by=("category", "year"))


def str_upload(spark: SparkSession, d: str) -> DataFrame:
    """STR-1: two uploads arrive one after the other (1998's rows, then the
    whole fact); each is a batch, and the second wins."""
    base = scratch_dir(spark, "stream")
    fact = marts.staged_sales_fact(spark, d)
    store = SnapshotStore(spark, f"{base}/store")
    for name, rows in (("upload-1", apply_row_filters(fact, [FilterSpec("year", 1998)])), ("upload-2", fact)):
        _land_upload(rows, f"{base}/incoming", name)
        _finish(upload_stream(spark, f"{base}/incoming", FACT_DDL, {11: _BY_CATEGORY_YEAR}, store, f"{base}/checkpoint",
                              name="str_upload", folders=True))
    return store.get(11)


def str_backlog(spark: SparkSession, d: str) -> DataFrame:
    """STR-1 with a backlog: both uploads are pending when the stream starts;
    one batch takes them and opens only the newest one's files."""
    base = scratch_dir(spark, "stream-backlog")
    fact = marts.staged_sales_fact(spark, d)
    _land_upload(apply_row_filters(fact, [FilterSpec("year", 1998)]), f"{base}/incoming", "upload-1")
    _land_upload(fact, f"{base}/incoming", "upload-2")
    store = SnapshotStore(spark, f"{base}/store")
    _finish(upload_stream(spark, f"{base}/incoming", FACT_DDL, {11: _BY_CATEGORY_YEAR}, store, f"{base}/checkpoint",
                          name="str_backlog", folders=True, latest_only=True))
    return store.get(11)


def str_table(spark: SparkSession, d: str) -> DataFrame:
    """STR-1/AGG-12: a stream over the dashboards table, three shapes in it."""
    base = scratch_dir(spark, "stream-table")
    _land_upload(marts.staged_sales_fact(spark, d), f"{base}/incoming", "upload-1")
    store = SnapshotStore(spark, f"{base}/store")
    _finish(upload_stream(spark, f"{base}/incoming", FACT_DDL, marts.shaped_dashboards(spark, d), store, f"{base}/checkpoint",
                          name="str_table", folders=True))
    return _family_sums(store, "str_table-000000000000")


def snk_consume(spark: SparkSession, d: str) -> DataFrame:
    """SNK-7: the stream removes what it consumed; the result and the number
    of upload files that are left."""
    base = scratch_dir(spark, "stream-consume")
    _land_upload(marts.staged_sales_fact(spark, d), f"{base}/incoming", "upload-1")
    store = SnapshotStore(spark, f"{base}/store")
    _finish(upload_stream(spark, f"{base}/incoming", FACT_DDL, {11: _BY_CATEGORY_YEAR}, store, f"{base}/checkpoint",
                          name="snk_consume", folders=True, clean_source=True))
    left = list_files(spark, f"{base}/incoming").count()
    return store.get(11).withColumn("left", F.lit(left))


def str_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """STR-1/SNK-7: an upload without a column lies between two good ones. The
    last one wins, the bad one is a dead letter, and no file is left."""
    base = scratch_dir(spark, "stream-quarantine")
    fact = marts.staged_sales_fact(spark, d)
    first = apply_row_filters(fact, [FilterSpec("year", 1998)])
    for name, rows in (("upload-1", first), ("upload-2", fact.drop("quantity")), ("upload-3", fact)):
        _land_upload(rows, f"{base}/incoming", name)
    store = SnapshotStore(spark, f"{base}/store")
    _finish(upload_stream(spark, f"{base}/incoming", FACT_DDL, {11: _BY_CATEGORY_YEAR}, store, f"{base}/checkpoint",
                          name="str_quarantine", folders=True, clean_source=True))
    records = UploadLog(spark, store.root).records()
    told = records.agg(
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.max("error").alias("error"),
    ).first()
    left = list_files(spark, f"{base}/incoming").count()
    return store.get(11).select("*", *(F.lit(v).alias(k) for k, v in (*told.asDict().items(), ("left", left))))


@register("top_sales")
def _top_sales(df: DataFrame, least: float) -> DataFrame:
    """A registered transformation: rows of at least ``least`` sales."""
    return df.where(F.col("sales") >= F.lit(least))


def reg_transform(spark: SparkSession, d: str) -> DataFrame:
    """REG-1: a named transformation, then a count per category."""
    kept = apply_transformation(marts.staged_sales_fact(spark, d), "top_sales", least=50000)
    return aggregate(kept, [_agg("id", "count", "n")], ["category"])


# ---------------------------------------------------------- entitlements


def _ent(spark: SparkSession, d: str):
    return marts.users(spark, d), marts.dashboards(spark, d), marts.staged_access(spark, d)


def ent_effective(spark: SparkSession, d: str) -> DataFrame:
    """ENT-1/SET-1: what every user may see; "an admin sees all" is one row."""
    return effective_access(*_ent(spark, d))


def ent_visible(spark: SparkSession, d: str) -> DataFrame:
    """ENT-2: the dashboards user 35 may see (ENT-3 narrows this to one id)."""
    return visible_dashboards(*_ent(spark, d), user_id=35).select("dashboard_id", "name")


def ent_fetch(spark: SparkSession, d: str) -> DataFrame:
    """ENT-3: dashboard 5 for user 35 if permitted, else no row."""
    return dashboard_if_permitted(*_ent(spark, d), user_id=35, dashboard_id=5).select("dashboard_id", "name")


def ent_check(spark: SparkSession, d: str) -> DataFrame:
    """ENT-4: authorise a batch of requests (ids 25-29 do not exist)."""
    return authorize(marts.access_requests(spark, d), *_ent(spark, d))


def ent_denied(spark: SparkSession, d: str) -> DataFrame:
    """ENT-4: the denied requests."""
    return denied(marts.access_requests(spark, d), *_ent(spark, d))


def ent_action(spark: SparkSession, d: str) -> DataFrame:
    """ENT-6: requests with an action; uploads also need a writing role."""
    o = table(spark, d, "orders")
    action = F.when(F.col("o_orderkey") % 2 == 0, F.lit("upload")).otherwise(F.lit("view"))
    requests = o.select(
        F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 30).alias("dashboard_id"), action.alias("action")
    ).distinct()
    return authorize(requests, *_ent(spark, d))


def ent_rows(spark: SparkSession, d: str) -> DataFrame:
    """ENT-5: the per-region aggregates that user 35 may see."""
    users, dashboards, access = _ent(spark, d)
    agg = _double(run(marts.staged_sales_fact(spark, d), PipelineConfig(
        aggregations=(_agg("sales", "sum", "total_sales"),), group_by=("region",))), "total_sales")
    rows = agg.join(dashboards.select("dashboard_id", F.col("name").alias("region")), "region")
    return entitled_rows(rows, users, dashboards, access, user_id=35).select("region", "total_sales")


def ent_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """ENT-5/SNK-2: the current snapshots of all dashboards that user 35 may
    see, out of a store of all dashboards: only their folders are opened."""
    users, dashboards, access = _ent(spark, d)
    store = SnapshotStore(spark, scratch_dir(spark, "entitled-store"))
    fan_out_table(marts.staged_sales_fact(spark, d), dashboards, store, snapshot_id="all", stage_input=False)
    mine = visible_dashboards(users, dashboards, access, user_id=35).select("dashboard_id")
    return _double(store.read_many(mine), "total_sales").select("dashboard_id", "category", "year", "total_sales", "n")


def snk_prune_family(spark: SparkSession, d: str) -> DataFrame:
    """SNK-4: three runs of a family, one snapshot retained: the folders of
    the first two are gone, and the current ones are read."""
    store = SnapshotStore(spark, scratch_dir(spark, "prune-store"))
    boards = marts.dashboards(spark, d)
    for i in (1, 2, 3):
        fan_out_table(marts.staged_sales_fact(spark, d), boards, store, f"run-{i}", stage_input=False, retain=1)
    families = [r[0] for r in store.manifest().select(F.regexp_extract("path", "^(.*)/dashboard_id=[^/]*$", 1)).distinct().collect()]
    gone = sum(not path_exists(spark, f) for f in families if f)
    out = _double(store.read_many(boards), "total_sales").withColumn("gone", F.lit(gone))
    return out.select("dashboard_id", "category", "year", "total_sales", "n", "gone")


def ent_role(spark: SparkSession, d: str) -> DataFrame:
    """ENT-6: for what each user may see, whether they may upload there."""
    users, dashboards, access = _ent(spark, d)
    return role_gate(effective_access(users, dashboards, access), users)


# ---------------------------------------------------------------- charts


def _count_by(*keys: str, alias: str = "n") -> PipelineConfig:
    return PipelineConfig(aggregations=(_agg("id", "count", alias),), group_by=keys)


def cht_bar(spark: SparkSession, d: str) -> DataFrame:
    """CHT-1: a bar series of row counts per year."""
    return chart_dataset(run(marts.staged_sales_fact(spark, d), _count_by("year")), ChartConfig("bar", "year", "n"))


def cht_line(spark: SparkSession, d: str) -> DataFrame:
    """CHT-3: a line series of row counts per year, ordered by x."""
    return chart_dataset(run(marts.staged_sales_fact(spark, d), _count_by("year")), ChartConfig("line", "year", "n"))


def cht_pie(spark: SparkSession, d: str) -> DataFrame:
    """CHT-4: pie slices of sales by category with each slice's percent."""
    pie = chart_dataset(marts.staged_sales_fact(spark, d), ChartConfig("pie", "category", "sales"))
    return _double(pie, "value")


def cht_table(spark: SparkSession, d: str) -> DataFrame:
    """CHT-5: a table of several measures per category."""
    cfg = PipelineConfig(aggregations=(_agg("sales", "sum", "total_sales"), _agg("id", "count", "n")), group_by=("category",))
    table = chart_dataset(run(marts.staged_sales_fact(spark, d), cfg), ChartConfig("table", "category", ["total_sales", "n"]))
    return _double(table, "total_sales")


def cht_dot(spark: SparkSession, d: str) -> DataFrame:
    """CHT-2: a dot chart with size and color."""
    cfg = PipelineConfig(
        aggregations=(_agg("id", "count", "n"), _agg("quantity", "max"), _agg("category", "min")), group_by=("brand",)
    )
    chart = ChartConfig("dot", "brand", "n", size="max_quantity", color="min_category")
    return chart_dataset(run(marts.staged_sales_fact(spark, d), cfg), chart)


def cht_multi(spark: SparkSession, d: str) -> DataFrame:
    """CHT-6: two y columns as long-form series."""
    cfg = PipelineConfig(aggregations=(_agg("quantity", "min", "lo"), _agg("quantity", "max", "hi")), group_by=("year",))
    return multi_series(run(marts.staged_sales_fact(spark, d), cfg), "year", ["lo", "hi"])


def cht_combined(spark: SparkSession, d: str) -> DataFrame:
    """CHT-7: two charts over one globally filtered frame."""
    g = apply_filters(marts.staged_sales_fact(spark, d), year=1998)
    charts = [
        (_count_by("category"), ChartConfig("bar", "category", "n")),
        (_count_by("brand"), ChartConfig("bar", "brand", "n")),
    ]
    return combined_datasets(g, charts).select("chart_id", "x", "value")


QUERIES: dict[str, Query] = {
    "flt_eq": flt_eq,
    "flt_ops": flt_ops,
    "flt_strict": flt_strict,
    "flt_lenient": flt_lenient,
    "flt_pre_agg": flt_pre_agg,
    "flt_post_agg": flt_post_agg,
    "prj_chain": prj_chain,
    "prj_broadcast": prj_broadcast,
    "prj_grouped": prj_grouped,
    "prj_growth": prj_growth,
    "agg_sum": agg_sum,
    "agg_mean": agg_mean,
    "agg_count": agg_count,
    "agg_min_max": agg_min_max,
    "agg_multi": agg_multi,
    "agg_global": agg_global,
    "agg_global_empty": agg_global_empty,
    "agg_passthrough": agg_passthrough,
    "agg_keys_only": agg_keys_only,
    "met_yoy": met_yoy,
    "met_yoy_gap": met_yoy_gap,
    "met_share_cols": met_share_cols,
    "met_share_parent": met_share_parent,
    "met_share_total": met_share_total,
    "met_custom": met_custom,
    "met_merge": met_merge,
    "pip_run": pip_run,
    "pip_fanout": pip_fanout,
    "pip_family": pip_family,
    "pip_families": pip_families,
    "pip_ranges": pip_ranges,
    "pip_in_lists": pip_in_lists,
    "pip_family_inner": pip_family_inner,
    "pip_trigger": pip_trigger,
    "snk_latest": snk_latest,
    "snk_prune": snk_prune,
    "snk_prune_family": snk_prune_family,
    "snk_json": snk_json,
    "snk_consume": snk_consume,
    "pip_get_data": pip_get_data,
    "srt_latest": srt_latest,
    "src_csv": src_csv,
    "src_admit": src_admit,
    "src_validate": src_validate,
    "src_reordered": src_reordered,
    "src_headers": src_headers,
    "src_infer": src_infer,
    "str_upload": str_upload,
    "str_backlog": str_backlog,
    "str_table": str_table,
    "str_quarantine": str_quarantine,
    "reg_transform": reg_transform,
    "ent_effective": ent_effective,
    "ent_visible": ent_visible,
    "ent_fetch": ent_fetch,
    "ent_check": ent_check,
    "ent_denied": ent_denied,
    "ent_action": ent_action,
    "ent_rows": ent_rows,
    "ent_snapshots": ent_snapshots,
    "ent_role": ent_role,
    "cht_bar": cht_bar,
    "cht_line": cht_line,
    "cht_pie": cht_pie,
    "cht_table": cht_table,
    "cht_dot": cht_dot,
    "cht_multi": cht_multi,
    "cht_combined": cht_combined,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)

# Queries without a SQL oracle (checked against brute force in tests instead).
NO_ORACLE: frozenset[str] = frozenset()
