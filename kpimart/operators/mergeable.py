"""Custom metrics that merge (MET-4): partial, merge, finish.

A metric without a native expression is run in Arrow batches, in three steps:

1. every task turns the values of each group of a batch into a state
   (``partial``) and merges states of one group over its batches, so a key
   that holds a third of all rows leaves a task as a few states, not as rows.
   A task holds at most ``HELD_GROUPS`` states and hands them on when full;
2. the states of a group are merged in two rounds, first dealt over ``SALTS``
   parts of the group, then together: no task reads more states of one group
   than tasks / ``SALTS`` or ``SALTS``;
3. ``finish`` makes the value.

``merge`` has to be associative and commutative. Built-in operations of the
same config stay native and are joined on the keys (null-safe). Null values
reach ``partial`` as nulls; without keys an empty input gives one row with the
value of an empty state.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kpimart.config import AggregationSpec
from kpimart.functions.columns import require_columns
from kpimart.functions.registry import MergeableMetric, get_mergeable

HELD_GROUPS = 4096
SALTS = 64


def _packed(metrics: Sequence[MergeableMetric]) -> bytes:
    """The metrics by value, so that tasks need none of the modules that define them."""
    names = {fn.__module__ for m in metrics for fn in (m.partial, m.merge, m.finish)} - {"__main__"}
    modules = [sys.modules[n] for n in names if n in sys.modules]
    for module in modules:
        cloudpickle.register_pickle_by_value(module)
    try:
        return cloudpickle.dumps([(m.partial, m.merge, m.finish) for m in metrics])
    finally:
        for module in modules:
            cloudpickle.unregister_pickle_by_value(module)


def empty_value(metric: MergeableMetric, dtype: T.DataType):
    """The value of a group without rows."""
    arrow = to_arrow_schema(T.StructType([T.StructField("v", dtype)])).field(0).type
    return metric.finish(metric.partial(pa.array([], arrow)))


def merged_metrics(df: DataFrame, specs: Sequence[AggregationSpec], keys: Sequence[str]) -> DataFrame:
    """One row per key tuple with the value of each (mergeable) spec."""
    require_columns(df, [s.column for s in specs])
    spark, n_keys, n = df.sparkSession, len(keys), len(specs)
    metrics = [get_mergeable(s.operation) for s in specs]
    packed = _packed(metrics)
    key_fields = [T.StructField(f"__k{i}", df.schema[k].dataType) for i, k in enumerate(keys)]
    values = [F.col(s.column).alias(f"__v{i}") for i, s in enumerate(specs)]
    state_type = T.StructType(key_fields + [T.StructField(f"__s{i}", T._parse_datatype_string(m.state)) for i, m in enumerate(metrics)])
    state_schema = to_arrow_schema(state_type)
    held = HELD_GROUPS

    def codes(column: pa.Array) -> np.ndarray:
        """The same number for the same key value of a batch."""
        if pa.types.is_nested(column.type):
            seen: dict = {}
            return np.array([seen.setdefault(repr(v), len(seen)) for v in column.to_pylist()], np.int64)
        return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def states_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        steps = pickle.loads(packed)
        kept: dict = {}

        def batch_of() -> pa.RecordBatch:
            rows = [(*key, *states) for key, states in kept.values()]
            columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(state_schema)]
            return pa.RecordBatch.from_arrays(columns, schema=state_schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.zeros(batch.num_rows, np.int64)
            for i in range(n_keys):
                group = np.unique(group * (batch.num_rows + 1) + codes(batch.column(i)), return_inverse=True)[1]
            order = np.argsort(group, kind="stable")
            cuts = np.flatnonzero(np.diff(group[order], prepend=-1))
            for start, end in zip(cuts, [*cuts[1:], len(order)], strict=True):
                rows = pa.array(order[start:end])
                key = tuple(batch.column(i)[int(order[start])].as_py() for i in range(n_keys))
                found = [step[0](batch.column(n_keys + i).take(rows)) for i, step in enumerate(steps)]
                name = repr(key)
                if name in kept:
                    found = [step[1](a, b) for step, a, b in zip(steps, kept[name][1], found, strict=True)]
                kept[name] = (key, found)
            if len(kept) >= held:
                yield batch_of()
                kept.clear()
        if kept:
            yield batch_of()

    def merge_groups(table: pa.Table) -> pa.Table:
        import pickle

        out = {f.name: table.column(f.name).slice(0, 1) for f in state_schema if f.name.startswith("__k")}
        for i, step in enumerate(pickle.loads(packed)):
            rows = table.column(f"__s{i}").to_pylist()
            state = rows[0]
            for other in rows[1:]:
                state = step[1](state, other)
            out[f"__s{i}"] = pa.array([state], state_schema.field(f"__s{i}").type)
        return pa.table(out, schema=state_schema)

    states = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *values).mapInArrow(states_of, state_type)
    if not keys:
        nothing = [
            m.partial(pa.array([], to_arrow_schema(T.StructType([df.schema[s.column]])).field(0).type))
            for m, s in zip(metrics, specs, strict=True)
        ]
        states = states.unionByName(spark.createDataFrame([tuple(nothing)], state_type))
    names = [f.name for f in key_fields]
    salted = states.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    once = salted.groupBy(*names, "__salt").applyInArrow(merge_groups, state_type)
    merged = once.groupBy(*(names or [F.lit(0).alias("__all")])).applyInArrow(merge_groups, state_type)

    result_type = T.StructType(key_fields + [T.StructField(f"__r{i}", T._parse_datatype_string(m.result)) for i, m in enumerate(metrics)])
    result_schema = to_arrow_schema(result_type)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        steps = pickle.loads(packed)
        for batch in batches:
            columns = [batch.column(i) for i in range(n_keys)]
            for i, step in enumerate(steps):
                values = [step[2](s) for s in batch.column(n_keys + i).to_pylist()]
                columns.append(pa.array(values, result_schema.field(n_keys + i).type))
            yield pa.RecordBatch.from_arrays(columns, schema=result_schema)

    out = merged.mapInArrow(finished, result_type)
    named = [F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)]
    return out.select(*named, *[F.col(f"__r{i}").alias(specs[i].output_name) for i in range(n)])
