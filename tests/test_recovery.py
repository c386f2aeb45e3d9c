"""Recovery: failed task attempts are retried without duplicating or losing
rows, and a stream restarted from its checkpoint continues where it stopped."""

import gzip
import os
import subprocess
import sys
import textwrap

from kpimart.config import PipelineConfig
from kpimart.sinks.store import SnapshotStore
from kpimart.streaming.upload import upload_stream

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

RETRY_SCRIPT = textwrap.dedent(
    """
    import os, sys
    sys.path.insert(0, {repo!r})
    from pyspark import TaskContext
    from pyspark.sql import SparkSession, functions as F, types as T
    # local[4,4]: up to 4 attempts per task, as on a cluster that loses executors
    spark = (SparkSession.builder.master("local[4,4]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "4").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    spark.sparkContext.setCheckpointDir({tmp!r} + "/cp")
    from kpimart.config import PipelineConfig
    from kpimart.plans.families import fan_out_grouped
    from kpimart.plans.processing import run
    from kpimart.sinks.store import SnapshotStore

    @F.udf(T.BooleanType())
    def fail_first_attempt(x):
        ctx = TaskContext.get()
        if ctx.partitionId() == 1 and ctx.attemptNumber() == 0:
            raise RuntimeError("simulated executor loss")
        return True

    df = spark.range(0, 20000, numPartitions=4).select(
        (F.col("id") % 7).cast("string").alias("k"), (F.col("id") % 3).cast("double").alias("v")
    ).where(fail_first_attempt("id"))
    store = SnapshotStore(spark, {tmp!r} + "/store")
    cfg = PipelineConfig.from_dict({{"aggregations": [{{"column": "v", "operation": "sum", "alias": "s"}},
                                                     {{"column": "v", "operation": "count", "alias": "n"}}],
                                    "group_by": ["k"]}})
    info = store.save(1, run(df, cfg))
    total = store.get(1).agg(F.sum("n"), F.sum("s")).first()
    fam = {{i: PipelineConfig.from_dict({{"filters": [{{"column": "k", "value": str(i)}}],
                                         "aggregations": [{{"column": "v", "operation": "count", "alias": "n"}}]}})
           for i in range(7)}}
    status = fan_out_grouped(df, fam, store).collect()
    fam_total = sum(store.get(i).first().n for i in range(7))
    print("RESULT", info.row_count, total[0], total[1], fam_total, all(r.status == "ok" for r in status))
    """
)


def test_failed_task_attempts_are_retried_exactly_once(tmp_path):
    script = tmp_path / "retry.py"
    script.write_text(RETRY_SCRIPT.format(repo=REPO, tmp=str(tmp_path)))
    out = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, timeout=600)
    line = [ln for ln in out.stdout.splitlines() if ln.startswith("RESULT")]
    assert line, out.stderr[-3000:]
    _, groups, rows, total_v, fam_rows, ok = line[0].split()
    assert int(groups) == 7
    assert int(rows) == 20000  # no row lost or counted twice
    assert float(total_v) == float(sum(i % 3 for i in range(20000)))
    assert int(fam_rows) == 20000 and ok == "True"


def _gz(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt") as f:
        f.write(text)


def test_stream_restart_continues_from_its_checkpoint(spark, tmp_path):
    import time

    incoming = tmp_path / "incoming"
    cfg = {1: PipelineConfig.from_dict({"aggregations": [{"column": "sales", "operation": "sum", "alias": "s"}]})}
    store = SnapshotStore(spark, str(tmp_path / "store"))
    schema = "cat string, year int, sales double"
    _gz(incoming / "a.csv.gz", "cat,year,sales\na,2020,1.0\n")
    upload_stream(spark, str(incoming), schema, cfg, store, str(tmp_path / "cp"), name="t_restart").awaitTermination()
    assert store.get(1).first().s == 1.0
    time.sleep(1.1)
    _gz(incoming / "b.csv.gz", "cat,year,sales\nb,2020,5.0\n")
    upload_stream(spark, str(incoming), schema, cfg, store, str(tmp_path / "cp"), name="t_restart").awaitTermination()
    assert store.get(1).first().s == 5.0  # only the new file; the first is not reprocessed
    ids = sorted(r.snapshot_id for r in store.manifest().collect())
    assert ids == ["t_restart-000000000000", "t_restart-000000000001"]
