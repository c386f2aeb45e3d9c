"""Dashboard families: many dashboards, one job (AGG-12 at scale).

Dashboards often share a pipeline *shape* and differ only in the values of
their equality, list and range filters (one dashboard per region, group of
brands or span of years, say). Running one job per
dashboard would make the driver loop over thousands of plans. A family
instead runs as one plan:

1. its members form a table ``(dashboard_id, __p0..__pk)`` of parameter
   values; the distinct value tuples are computed once;
2. the input (after the shape's other filters) is joined to those tuples on
   the filter columns, so each row meets the tuples it matches; AQE
   broadcasts the tuple table when its runtime size is small. A list of
   values is exploded to an equi-join. Ranges are an interval join: the line
   is cut into cells at sampled parameter values, a tuple is listed for every
   cell its range meets, a row has one cell, and the exact test follows the
   equi-join on the cell. The least and greatest parameter values bound the
   scan;
3. computed fields (an aggregate inside one is computed per tuple and joined
   back on the parameter values), then the aggregate with the parameter columns as extra
   keys (partial aggregation before the shuffle, as for a single dashboard);
   global aggregates give one row per tuple, also for tuples without rows;
4. the aggregated rows are joined back to the members (null-safe on the
   parameter values) and written once with ``partitionBy("dashboard_id")``
   after a ``rebalance`` hint, so AQE sizes the write tasks;
5. manifest rows (one per dashboard, with its row count read from the
   written files) are built by Spark and appended as one entry.

Identical configs (a shape without parameters) are run once and every member
points at the one snapshot. Shapes that cannot be shared (SQL-text or
``Column`` expressions, two equality or list filters on one column) run per dashboard through ``kpimart.plans.fanout.fan_out``.

Two entry points: ``fan_out_grouped`` takes configs held in Python;
``fan_out_table`` takes the dashboards table itself and plans families in
Spark (configs parsed as ``VARIANT``): only the distinct shapes reach the
driver, never one row per dashboard.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpimart.config import FILTER_OPERATOR_ALIASES, ComputedField, FilterSpec, PipelineConfig
from kpimart.functions.columns import check_value_type, column_type
from kpimart.operators.aggregate import aggregate, empty_group_value
from kpimart.operators.computed import with_computed_fields
from kpimart.operators.filters import apply_row_filters
from kpimart.plans.fanout import RESULT_SCHEMA, fan_out, results_frame, stage
from kpimart.plans.processing import as_pipeline, run
from kpimart.session import checkpoint_root
from kpimart.sinks.store import SnapshotStore, new_snapshot_id

# Filters whose values are parameters of a family, and all their spellings.
LOWER_OPS, UPPER_OPS = (">", ">="), ("<", "<=")
PARAM_OPS = ("==", "in", *LOWER_OPS, *UPPER_OPS)
PARAM_SPELLINGS = {**{op: op for op in PARAM_OPS}, **{k: v for k, v in FILTER_OPERATOR_ALIASES.items() if v in PARAM_OPS}}
# Cells that the interval join cuts a range column into, at most one more.
CELLS = 64
RESERVED = ("dashboard_id",)


def _pcols(k: int) -> list[str]:
    return [f"__p{i}" for i in range(k)]


class Param(str):
    """The column of a parameter, and the operator that compares it."""

    op: str

    def __new__(cls, column: str, op: str = "=="):
        made = super().__new__(cls, column)
        made.op = op
        return made

    def type_in(self, df: DataFrame) -> T.DataType:
        """The type of this parameter's value: a list has the column's type."""
        dtype = column_type(df, self)
        return T.ArrayType(dtype) if self.op == "in" else dtype


@dataclass
class Family:
    shape: PipelineConfig
    params: tuple[str, ...]
    members: dict[int, tuple] = field(default_factory=dict)


def _structured(expr) -> bool:
    """A JSON-tree expression."""
    if isinstance(expr, dict):
        return all(_structured(v) for v in expr.values() if isinstance(v, (dict, list)))
    if isinstance(expr, list):
        return all(_structured(v) for v in expr)
    return isinstance(expr, (int, float, bool, str)) or expr is None


def per_tuple(expr, pcols: list[str]):
    """The expression with its inner aggregates per parameter tuple: what is
    the whole frame (or a group of it) for one dashboard is the tuple's rows."""
    if isinstance(expr, list):
        return [per_tuple(e, pcols) for e in expr]
    if not isinstance(expr, dict):
        return expr
    out = {k: v if k == "over" else per_tuple(v, pcols) for k, v in expr.items()}
    if "agg" in expr:
        out["over"] = [*pcols, *(expr.get("over") or ())]
    return out


def shareable(cfg: PipelineConfig, params: tuple[str, ...] = ()) -> bool:
    """Can members of this shape run as one family?"""
    if not all(isinstance(c.expression, dict) and _structured(c.expression) for c in cfg.computed_fields):
        return False
    if cfg.aggregations is not None and not cfg.aggregations and not cfg.group_by:
        return False  # zero-column result
    names = set(cfg.group_by) | {a.output_name for a in cfg.aggregations or ()} | {c.name for c in cfg.computed_fields}
    single = [p for p in params if getattr(p, "op", "==") in ("==", "in")]
    return not (names & set(RESERVED)) and len(single) == len(set(single))


def plan_families(configs: Mapping[int, object]) -> tuple[list[Family], dict[int, PipelineConfig]]:
    """Split configs held in Python into families (two or more members) and
    singles."""
    groups: dict[str, Family] = {}
    singles: dict[int, PipelineConfig] = {}
    for dash_id, raw in configs.items():
        cfg = as_pipeline(raw)
        eq = tuple(f for f in cfg.filters if f.op in PARAM_OPS)
        rest = tuple(f for f in cfg.filters if f.op not in PARAM_OPS)
        params = tuple(Param(f.column, f.op) for f in eq)
        shape = PipelineConfig(rest, cfg.computed_fields, cfg.aggregations, cfg.group_by)
        if not shareable(shape, params):
            singles[int(dash_id)] = cfg
            continue
        key = json.dumps(
            [[(p, p.op) for p in params], repr(rest), [(c.name, c.expression) for c in cfg.computed_fields], repr(cfg.aggregations), cfg.group_by],
            sort_keys=True,
            default=str,
        )
        fam = groups.setdefault(key, Family(shape, params))
        fam.members[int(dash_id)] = tuple(f.value for f in eq)
    families = []
    for fam in groups.values():
        if len(fam.members) > 1:
            families.append(fam)
        else:
            (dash_id, values), = fam.members.items()
            filters = tuple(fam.shape.filters) + tuple(FilterSpec(str(c), v, c.op) for c, v in zip(fam.params, values))
            singles[dash_id] = PipelineConfig(filters, fam.shape.computed_fields, fam.shape.aggregations, fam.shape.group_by)
    return families, singles


def invalid_members(df: DataFrame, fam: Family) -> dict[int, str]:
    """Members whose parameter values do not fit the column types (schema
    check only); they are reported alone and the rest of the family runs."""
    types = [column_type(df, c) for c in fam.params]
    bad = {}
    for dash_id, values in fam.members.items():
        try:
            for c, t, v in zip(fam.params, types, values):
                for one in v if c.op == "in" else (v,):
                    check_value_type(c, t, one)
        except ValueError as exc:
            bad[dash_id] = str(exc)
    return bad


def members_frame(df: DataFrame, fam: Family) -> DataFrame:
    """``(dashboard_id, __p0..__pk)`` for members held in Python."""
    types = [c.type_in(df) for c in fam.params]
    schema = T.StructType(
        [T.StructField("dashboard_id", T.LongType(), False)]
        + [T.StructField(p, t) for p, t in zip(_pcols(len(fam.params)), types)]
    )
    # a fraction matches no row of a column of whole numbers
    def held(value, dtype):
        if isinstance(dtype, T.ArrayType):
            return sorted({v for v in (held(x, dtype.elementType) for x in value) if v is not None})
        if isinstance(dtype, T.IntegralType) and isinstance(value, float):
            return int(value) if value.is_integer() else None
        return value

    rows = [(d, *map(held, v, types)) for d, v in sorted(fam.members.items())]
    return df.sparkSession.createDataFrame(rows, schema)


def _compared(op: str, column: Column, value: Column) -> Column:
    return {">": column > value, ">=": column >= value, "<": column < value, "<=": column <= value}[op]


def _range_bounds(values: DataFrame, pcols: list[str]) -> list:
    """Parameter values to cut a column at: a hash-ordered sample of the
    distinct ones, which is even whatever their distribution and type."""
    v = values.select(F.explode(F.array(*pcols)).alias("v")).where("v is not null").distinct()
    return sorted(r.v for r in v.orderBy(F.xxhash64("v"), "v").limit(CELLS).collect())


def matching_rows(base: DataFrame, values: DataFrame, params: tuple[str, ...]) -> DataFrame:
    """Every row of ``base`` with each tuple of ``values`` that it matches,
    once, whatever the tuple's lists and ranges hold."""
    named = list(zip(_pcols(len(params)), params))
    ranges = [(p, c) for p, c in named if c.op in (*LOWER_OPS, *UPPER_OPS)]
    keyed, conditions = values, []
    for i, (p, c) in enumerate(named):
        if c.op == "==":
            conditions.append(F.col(c) == F.col(p))
        elif c.op == "in":
            keyed = keyed.withColumn(f"__v{i}", F.explode(F.array_distinct(p)))
            conditions.append(F.col(c) == F.col(f"__v{i}"))
        else:
            keyed = keyed.where(F.col(p).isNotNull())
            conditions.append(_compared(c.op, F.col(c), F.col(p)))
    # the outermost values bound the scan
    ends = [(F.min(p) if c.op in LOWER_OPS else F.max(p)).alias(p) for p, c in ranges]
    outer = values.agg(*ends).first() if ends else None
    for p, c in ranges:
        limit = F.lit(outer[p]).cast(column_type(base, c))
        base = base.where(_compared(c.op, F.col(c), limit))
    if ranges:
        column = ranges[0][1]
        lows = [p for p, c in ranges if c == column and c.op in LOWER_OPS]
        highs = [p for p, c in ranges if c == column and c.op in UPPER_OPS]
        bounds = _range_bounds(values, lows + highs)
        cuts = [F.lit(b).cast(column_type(base, column)) for b in bounds]

        def cell(x: Column) -> Column:
            """How many cuts are not above (a plain sum: no lambda in a join key)."""
            return reduce(lambda n, cut: n + F.when(cut <= x, 1).otherwise(0), cuts, F.lit(0))

        first = F.array_max(F.array(*[cell(F.col(p)) for p in lows])) if lows else F.lit(0)
        last = F.array_min(F.array(*[cell(F.col(p)) for p in highs])) if highs else F.lit(len(bounds))
        keyed = keyed.withColumn("__first", first).withColumn("__last", last).where("__first <= __last")
        keyed = keyed.withColumn("__cell", F.explode(F.sequence("__first", "__last"))).drop("__first", "__last")
        base = base.withColumn("__row_cell", cell(F.col(column)))
        conditions.append(F.col("__row_cell") == F.col("__cell"))
    joined = base.join(keyed, conditions)
    return joined.drop("__row_cell", "__cell", *[f"__v{i}" for i in range(len(params))])


def run_family(df: DataFrame, shape: PipelineConfig, params: tuple[str, ...], members: DataFrame) -> DataFrame:
    """All members' results: ``dashboard_id`` + the shape's output columns."""
    if not params:
        raise ValueError("A family without parameters is run once and shared (save_shared)")
    pcols = _pcols(len(params))
    values = members.select(*pcols).distinct()
    base = apply_row_filters(df, shape.filters)
    joined = matching_rows(base, values, tuple(c if isinstance(c, Param) else Param(c) for c in params))
    fields = [ComputedField(f.name, per_tuple(f.expression, pcols)) for f in shape.computed_fields]
    computed = with_computed_fields(joined, fields)
    aggs, keys = shape.aggregations, shape.group_by
    out = aggregate(computed, aggs, (*pcols, *keys)) if aggs is not None else computed
    if aggs and not keys:
        # One row per tuple even when no input row matched it (AGG-7).
        filled = values.join(out, [values[p].eqNullSafe(out[p]) for p in pcols], "left").select(
            values["*"], *[out[c] for c in out.columns if c not in pcols]
        )
        fills = {}
        for spec in aggs:
            empty = empty_group_value(computed, spec)
            if empty is not None:
                fills[spec.output_name] = F.coalesce(F.col(spec.output_name), empty)
        out = filled.withColumns(fills) if fills else filled
    result_cols = [c for c in out.columns if c not in pcols]
    back = members.join(out, [members[p].eqNullSafe(out[p]) for p in pcols])
    return back.select(members["dashboard_id"], *[out[c] for c in result_cols])


def save_family(store: SnapshotStore, result: DataFrame, dashboard_ids: DataFrame, snapshot_id: str | None = None) -> DataFrame:
    """Write all members' snapshots in one job, into a folder of this attempt;
    append their manifest rows last. Returns those rows (one per dashboard)."""
    spark = result.sparkSession
    store.ensure()
    sid = snapshot_id or new_snapshot_id()
    created_at = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    batch = store.batch_path(sid)
    result.hint("rebalance", "dashboard_id").write.partitionBy("dashboard_id").parquet(batch)
    empty_path = store.batch_path(f"{sid}-empty")
    spark.createDataFrame([], result.drop("dashboard_id").schema).coalesce(1).write.parquet(empty_path)
    # read with the known schema: no member may have a row
    counts = spark.read.schema(result.schema).parquet(batch).groupBy(F.col("dashboard_id").cast("bigint").alias("dashboard_id")).agg(
        F.count(F.lit(1)).alias("row_count")
    )
    rows = dashboard_ids.join(counts, "dashboard_id", "left").select(
        F.col("dashboard_id").cast("bigint"),
        F.lit(sid).alias("snapshot_id"),
        F.lit(created_at).cast("timestamp").alias("created_at"),
        F.coalesce(F.col("row_count"), F.lit(0).cast("bigint")).alias("row_count"),
        F.when(F.col("row_count").isNull(), F.lit(empty_path))
        .otherwise(F.concat(F.lit(f"{batch}/dashboard_id="), F.col("dashboard_id").cast("string")))
        .alias("path"),
    )
    return store.append_manifest(rows)


def save_shared(store: SnapshotStore, result: DataFrame, dashboard_ids: DataFrame, snapshot_id: str | None = None) -> DataFrame:
    """Identical configs: write the one result once and point every member's
    manifest row at it (no copy per dashboard). Returns the manifest rows."""
    store.ensure()
    sid = snapshot_id or new_snapshot_id()
    created_at = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    path = store.batch_path(f"{sid}-shared")
    obs = Observation(f"shared_{uuid.uuid4().hex}")
    result.observe(obs, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    rows = dashboard_ids.select(
        F.col("dashboard_id").cast("bigint"),
        F.lit(sid).alias("snapshot_id"),
        F.lit(created_at).cast("timestamp").alias("created_at"),
        F.lit(int(obs.get["rows"])).cast("bigint").alias("row_count"),
        F.lit(path).alias("path"),
    )
    return store.append_manifest(rows)


def _ok(rows: DataFrame) -> DataFrame:
    return rows.select(
        "dashboard_id", F.lit("ok").alias("status"), F.col("row_count").alias("rows"), "snapshot_id",
        F.lit(None).cast("string").alias("error"),
    )


def _errors(ids: DataFrame, message: Column | str) -> DataFrame:
    msg = F.lit(message) if isinstance(message, str) else message
    return ids.select(
        F.col("dashboard_id").cast("bigint"), F.lit("error").alias("status"), F.lit(None).cast("bigint").alias("rows"),
        F.lit(None).cast("string").alias("snapshot_id"), msg.cast("string").alias("error"),
    )


def _run_shape(source, shape, params, members, store, snapshot_id) -> DataFrame:
    ids = members.select("dashboard_id")
    if params:
        return _ok(save_family(store, run_family(source, shape, params, members), ids, snapshot_id))
    return _ok(save_shared(store, run(source, shape), ids, snapshot_id))


def fan_out_grouped(
    df: DataFrame,
    configs: Mapping[int, object],
    store: SnapshotStore,
    snapshot_id: str | None = None,
    stage_input: bool = True,
) -> DataFrame:
    """AGG-12 for many dashboards whose configs are held in Python: one job
    per family, one per single. The input is staged once when several jobs
    read it, unless it already is a columnar copy (``stage_input=False``).
    Returns ``(dashboard_id, status, rows, snapshot_id, error)`` per
    dashboard."""
    spark = df.sparkSession
    parsed, statuses = {}, []
    for dash_id, raw in configs.items():
        try:
            parsed[int(dash_id)] = as_pipeline(raw)
        except ValueError as exc:
            statuses.append((int(dash_id), "error", None, None, str(exc)))
    families, singles = plan_families(parsed)
    source = stage(df) if stage_input and len(families) + len(singles) > 1 else df
    frames = []
    for fam in families:
        try:
            bad = invalid_members(source, fam)
        except ValueError as exc:  # e.g. a parameter column the input lacks
            bad = {d: str(exc) for d in fam.members}
        statuses.extend((d, "error", None, None, msg) for d, msg in sorted(bad.items()))
        fam = Family(fam.shape, fam.params, {d: v for d, v in fam.members.items() if d not in bad})
        if not fam.members:
            continue
        try:
            frames.append(_run_shape(source, fam.shape, fam.params, members_frame(source, fam), store, snapshot_id))
        except Exception as exc:  # noqa: BLE001 - reported per dashboard
            msg = f"{type(exc).__name__}: {exc}"
            statuses.extend((d, "error", None, None, msg) for d in sorted(fam.members))
    if singles:
        frames.append(results_frame(spark, fan_out(source, singles, store, snapshot_id, stage_input=False)))
    out = spark.createDataFrame(statuses, RESULT_SCHEMA)
    for f in frames:
        out = out.unionByName(f)
    return out


# ------------------------------------------------ planning inside Spark


def config_shapes(dashboards: DataFrame) -> DataFrame:
    """Per dashboard: ``shape`` (JSON text of its pipeline with the values of
    equality, list and range filters taken out), ``values`` (those values as
    VARIANTs, in filter order) and ``bad_json``. Nested ``{"pipeline": ...}`` and flat configs
    are read; a flat top-level ``filters`` list of names belongs to the view."""
    # no config (null or blank) is the empty pipeline, as in ``as_pipeline``
    blank = F.coalesce(F.trim("config") == F.lit(""), F.lit(True))
    v = F.try_parse_json(F.when(blank, F.lit("{}")).otherwise(F.col("config")))
    nested = F.try_variant_get(v, "$.pipeline", "variant")
    pipe = F.coalesce(nested, v)
    raw = F.try_variant_get(pipe, "$.filters", "array<variant>")
    names_only = nested.isNull() & F.exists(raw, lambda f: F.try_variant_get(f, "$.column", "string").isNull())
    none = F.filter(raw, lambda f: F.lit(False))
    filters = F.when(names_only, none).otherwise(raw)

    def op(f: Column) -> Column:
        """The operator if the filter's value is a parameter, else null."""
        said = F.coalesce(F.try_variant_get(f, "$.op", "string"), F.try_variant_get(f, "$.operator", "string"), F.lit("=="))
        plain = F.create_map(*[F.lit(x) for pair in PARAM_SPELLINGS.items() for x in pair])
        return F.try_element_at(plain, said)

    eq = F.filter(filters, lambda f: op(f).isNotNull())
    rest = F.filter(filters, lambda f: op(f).isNull())
    shape = F.to_json(
        F.struct(
            F.coalesce(F.transform(eq, lambda f: F.try_variant_get(f, "$.column", "string")), F.array()).alias("params"),
            F.coalesce(F.transform(eq, op), F.array()).alias("ops"),
            F.coalesce(F.transform(eq, lambda f: F.try_variant_get(f, "$.value", "variant").isNull()), F.array()).alias("missing_value"),
            F.coalesce(F.transform(rest, lambda f: F.to_json(f)), F.array()).alias("rest"),
            F.to_json(F.try_variant_get(pipe, "$.computed_fields", "variant")).alias("computed_fields"),
            F.to_json(F.try_variant_get(pipe, "$.aggregations", "variant")).alias("aggregations"),
            F.to_json(F.try_variant_get(pipe, "$.group_by", "variant")).alias("group_by"),
        )
    )
    values = F.transform(eq, lambda f: F.try_variant_get(f, "$.value", "variant"))
    return dashboards.select(
        F.col("dashboard_id").cast("bigint").alias("dashboard_id"),
        v.isNull().alias("bad_json"),
        shape.alias("shape"),
        values.alias("values"),
    )


def _shape_config(text: str) -> tuple[PipelineConfig, tuple[str, ...]]:
    s = json.loads(text)
    if any(c is None for c in s.get("params", [])) or any(s.get("missing_value", [])):
        raise ValueError("A filter needs 'column' and 'value'")

    def load(t, default):
        return default if t is None else json.loads(t)

    d = {  # absent keys are left out of the shape text
        "filters": [json.loads(f) for f in s.get("rest", [])],
        "computed_fields": load(s.get("computed_fields"), []) or [],
        "aggregations": load(s.get("aggregations"), None),
        "group_by": load(s.get("group_by"), []) or [],
    }
    return PipelineConfig.from_dict(d), tuple(map(Param, s.get("params", []), s.get("ops", [])))


def _variant_fits(value: Column, dtype: T.DataType) -> Column:
    """The JSON type of a parameter value fits the column type (no silent
    '2023' == 2023); JSON null fits anything (it matches no row). A list
    needs a JSON array of such values."""
    if isinstance(dtype, T.ArrayType):
        items = F.try_variant_get(value, "$", "array<variant>")
        return F.coalesce(F.forall(items, lambda v: _variant_fits(v, dtype.elementType)), F.lit(False))
    t = F.schema_of_variant(value)
    if isinstance(dtype, T.BooleanType):
        ok = t == F.lit("BOOLEAN")
    elif isinstance(dtype, T.NumericType):
        ok = t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL")
    elif isinstance(dtype, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        ok = t == F.lit("STRING")
    else:
        ok = F.lit(True)
    return F.is_variant_null(value) | ok


def _param_value(value: Column, dtype: T.DataType) -> Column:
    """A parameter value in its column's type; null (which matches no row) if
    the type cannot hold it, such as 2020.5 for an int column. A list has its
    distinct values in order."""
    if isinstance(dtype, T.ArrayType):
        items = F.try_variant_get(value, "$", "array<variant>")
        typed = F.transform(items, lambda v: _param_value(v, dtype.elementType))
        return F.array_sort(F.array_distinct(F.filter(typed, lambda v: v.isNotNull())))
    typed = F.try_variant_get(value, "$", dtype.simpleString())
    if isinstance(dtype, T.IntegralType):
        exact = F.try_variant_get(value, "$", "decimal(38,10)")
        return F.when(typed.cast("decimal(38,10)") == exact, typed)
    return typed


def fan_out_table(
    df: DataFrame,
    dashboards: DataFrame,
    store: SnapshotStore,
    snapshot_id: str | None = None,
    stage_input: bool = True,
    retain: int | None = 2,
) -> DataFrame:
    """AGG-12 straight from the dashboards table ``(dashboard_id, config)``.

    Spark parses every config and splits it into a shape and its parameter
    values; only the distinct shapes are read to the driver. Each shareable
    shape runs as one family whose member table stays a DataFrame; members
    whose values do not fit the column types are reported, the rest run.
    Shapes that cannot be shared run per dashboard (their configs are read
    for that). The input is staged once when several shapes read it, unless
    it already is a columnar copy (``stage_input=False``). Family folders that
    none of the newest ``retain`` snapshots of any dashboard uses are dropped
    at the end (None: kept). Returns ``(dashboard_id, status, rows,
    snapshot_id, error)``.
    """
    spark = df.sparkSession
    frame = config_shapes(dashboards)
    shapes = [r.shape for r in frame.where(~F.col("bad_json")).select("shape").distinct().collect()]
    if len(shapes) > 1:
        # Checkpointed once (reliable, in the shared checkpoint folder): each
        # shape below selects its members from this copy instead of parsing
        # every config again.
        checkpoint_root(spark)
        frame = frame.checkpoint(eager=True)
    source = stage(df) if stage_input and len(shapes) > 1 else df
    out = _errors(frame.where(F.col("bad_json")), "Config is not valid JSON")
    for text in shapes:
        in_shape = frame.where(~F.col("bad_json") & (F.col("shape") == F.lit(text)))
        try:
            shape, params = _shape_config(text)
            types = [c.type_in(source) for c in params]
        except ValueError as exc:
            out = out.unionByName(_errors(in_shape, str(exc)))
            continue
        if not shareable(shape, params):
            keep = in_shape.select("dashboard_id")
            configs = {int(r.dashboard_id): r.config for r in dashboards.join(keep, "dashboard_id", "left_semi").collect()}
            out = out.unionByName(results_frame(spark, fan_out(source, configs, store, snapshot_id, stage_input=False)))
            continue
        pcols = _pcols(len(params))
        fits = F.lit(True)
        mismatch = F.lit(None).cast("string")
        for i, (c, t) in enumerate(zip(params, types)):
            val = F.get(F.col("values"), i)
            ok = _variant_fits(val, t)
            fits = fits & ok
            wanted = f"Type mismatch for column {c}: column is {column_type(source, c).simpleString()}, value is "
            text_of = F.concat(F.lit(wanted), F.lower(F.schema_of_variant(val)))
            mismatch = F.coalesce(mismatch, F.when(~ok, text_of))
        checked = in_shape.withColumn("__fits", fits).withColumn("__mismatch", mismatch)
        out = out.unionByName(_errors(checked.where(~F.col("__fits")), F.col("__mismatch")))
        typed = [_param_value(F.get(F.col("values"), i), t).alias(p) for i, (p, t) in enumerate(zip(pcols, types))]
        members = checked.where(F.col("__fits")).select("dashboard_id", *typed)
        try:
            out = out.unionByName(_run_shape(source, shape, params, members, store, snapshot_id))
        except Exception as exc:  # noqa: BLE001 - reported per dashboard
            out = out.unionByName(_errors(members, f"{type(exc).__name__}: {exc}"))
    if retain is not None and store.has_batches():
        store.prune_families(retain)
    return out
