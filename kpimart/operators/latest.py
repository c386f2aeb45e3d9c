"""Latest row per key (SRT-1) without a sort of the data.

An aggregate whose buffer holds text or a struct makes Spark sort its input.
So the rows are first reduced per key and value by the greatest (timestamp,
tiebreak), packed into one decimal: a fixed-width buffer, hence a hash
aggregate, partial before the shuffle. Only the few rows left per key are then
compared with ``max_by``. A key that holds a third of all rows is reduced
map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpimart.functions.columns import require_columns


def latest_per_key(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    values: Sequence[str],
    tiebreak: str | None = None,
    ts_alias: str | None = None,
) -> DataFrame:
    """For each key tuple: the greatest ``ts`` and the ``values`` of the row
    holding it. ``tiebreak`` (e.g. an id) makes equal timestamps
    deterministic: the greater tiebreak wins."""
    keys, values = tuple(keys), tuple(values)
    require_columns(df, (*keys, ts, *values, *((tiebreak,) if tiebreak else ())))
    out = ts_alias or ts
    wanted = [v for v in values if v != out]
    whole = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
    packable = isinstance(df.schema[ts].dataType, (T.TimestampType, T.DateType)) and (
        tiebreak is None or isinstance(df.schema[tiebreak].dataType, whole)
    )
    if not packable:
        order = F.struct(F.col(ts), F.col(tiebreak)) if tiebreak else F.col(ts)
        return df.groupBy(*keys).agg(F.max(ts).alias(out), *(F.max_by(F.col(v), order).alias(v) for v in wanted))
    # (micros, tiebreak) as one number of at most 38 digits; a null tiebreak is least
    micros = F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(38,0)")
    low = F.lit(0) if tiebreak is None else F.coalesce(F.col(tiebreak).cast("decimal(20,0)") + 1, F.lit(-(1 << 63)).cast("decimal(20,0)"))
    packed = (micros * F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(38,0)") + low
    reduced = (
        df.select(*keys, ts, *(v for v in wanted if v not in (*keys, ts)), packed.cast("decimal(38,0)").alias("__order"))
        .groupBy(*keys, *(v for v in wanted if v not in keys))
        .agg(F.max(ts).alias("__ts"), F.max("__order").alias("__order"))
    )
    return reduced.groupBy(*keys).agg(
        F.max("__ts").alias(out), *(F.max_by(F.col(v), F.col("__order")).alias(v) for v in wanted)
    )
