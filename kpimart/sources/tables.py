"""Parquet tables by name from a directory (the driver's test tables).

Opening a Parquet table lists its files and reads a footer on the driver
(tens of milliseconds). The resulting lazy DataFrame is reused while the
files stay the same: the cache key holds the application, the path and the
size and modification time of every file, so a changed table is read again.
"""

from __future__ import annotations

import threading
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_FRAMES: OrderedDict[tuple, DataFrame] = OrderedDict()
_LOCK = threading.Lock()
MAX_CACHED = 128


def file_state(spark: SparkSession, path: str) -> tuple:
    """``(name, size, mtime)`` of every file under ``path`` (metadata only)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    it = fs.listFiles(p, True)
    state = []
    while it.hasNext():
        st = it.next()
        state.append((st.getPath().toString(), st.getLen(), st.getModificationTime()))
    return tuple(sorted(state))


def read_parquet(spark: SparkSession, path: str, state: tuple | None = None) -> DataFrame:
    """``spark.read.parquet(path)``, reused while the files are unchanged."""
    key = (spark.sparkContext.applicationId, path, state if state is not None else file_state(spark, path))
    with _LOCK:
        df = _FRAMES.get(key)
        if df is not None:
            _FRAMES.move_to_end(key)
            return df
    df = spark.read.parquet(path)
    with _LOCK:
        _FRAMES[key] = df
        while len(_FRAMES) > MAX_CACHED:
            _FRAMES.popitem(last=False)
    return df


def table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """``{base_dir}/{name}.parquet`` as a lazy frame (pruned and pushed down)."""
    return read_parquet(spark, f"{base_dir.rstrip('/')}/{name}.parquet")
