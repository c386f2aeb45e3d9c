"""Objects of this package inside Spark's Python tasks, and written tables."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from kpimart.session import scratch_dir


def share(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcast an object together with its class (by value: executors need
    not have this package). A task calls the result to get the object."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(packed.value)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written under the shared scratch folder and read again."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
