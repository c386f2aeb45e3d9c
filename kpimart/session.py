"""Session helpers: a local session for tests and bench, and scratch folders.

Scratch data (staged uploads, checkpoints, test snapshots) always goes under
the folder the cluster names in ``spark.checkpoint.dir``. A folder of our own
is set only when the session has none, as in tests on one machine.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


# Settings for a large cluster (for example 1000 executors reading ~100 TB).
# Pass them to the session builder or spark-submit; the engine itself never
# changes the caller's session conf.
CLUSTER_CONF = {
    # AQE re-plans from runtime sizes: coalesces small shuffle partitions,
    # turns joins into broadcasts when a side turns out small, and splits
    # skewed partitions of sort-merge joins and rebalances.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Start from many shuffle partitions and let AQE merge them to ~256 MB,
    # so a 100 TB shuffle has partitions that fit executor memory without
    # spilling, while small stages collapse to a few tasks.
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    # Scan splits of ~512 MB of Parquet: fewer, larger tasks over 100 TB.
    "spark.sql.files.maxPartitionBytes": "512m",
    # Broadcast only sides AQE measured under this size at run time.
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    # Compact, fast columnar files for staged inputs and snapshots.
    "spark.sql.parquet.compression.codec": "zstd",
    # Lost executors: retry tasks, and keep shuffle files readable.
    "spark.task.maxFailures": "8",
    "spark.shuffle.service.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(
    cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "kpimart", extra_conf: dict | None = None
) -> SparkSession:
    """A local session for tests and bench (UI off, AQE on, UTC)."""
    builder = SparkSession.builder
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    spark = (
        builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("KPIMART_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder: ``spark.checkpoint.dir`` as the cluster
    names it, else the context's checkpoint folder. Only when neither is set
    and the master is ``local`` (a single machine, as in tests) is a local
    folder created and registered with ``SparkContext.setCheckpointDir`` (the
    conf itself cannot change at run time). On a cluster that would be a
    folder of the driver's own disk, so there it is an error."""
    sc = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError(f"Set {CHECKPOINT_CONF} to shared storage: the session has no checkpoint folder")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kpimart-checkpoints-"))
        root = sc.getCheckpointDir()
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh, unique folder under the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/kpimart/{purpose}-{uuid.uuid4().hex}"
