"""Benchmark the query catalog.

Runs every query of ``kpimart.plans.catalog`` on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]``: one warm-up run, then the
median of ``$BENCH_RUNS`` (default 3) timed runs. A run builds the plan and
executes it fully into Spark's ``noop`` sink (no driver-side collect).
The shared inputs (the flat sales fact and the grants table) are staged once
first; that one-time cost is reported as ``stage_inputs`` and included in
the total. Prints one JSON line; ``value`` is the sum of the per-query
medians plus the staging time. With ``$BENCH_EVENTLOG_DIR`` set, Spark's
event log and the query time marks go there for
``scripts/eventlog_report.py``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kpimart.plans import catalog, marts  # noqa: E402
from kpimart.session import local_session  # noqa: E402


def _run(spark, fn, sf_dir: str) -> float:
    t0 = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    partitions = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus if cpus != "*" else "8"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    eventlog = os.environ.get("BENCH_EVENTLOG_DIR")
    extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": eventlog} if eventlog else None
    spark = local_session(cpus, partitions, app="kpimart-bench", extra_conf=extra)
    marks = []
    results: dict[str, float] = {}
    # The one-time cost of materialising the inputs the queries share, timed
    # like a query (warm-up, then the median of fresh restagings).
    def stage() -> float:
        t0 = time.perf_counter()
        marts.staged_sales_fact(spark, sf_dir, refresh=True)
        marts.staged_access(spark, sf_dir, refresh=True)
        return time.perf_counter() - t0

    stage()
    results["stage_inputs"] = round(statistics.median(stage() for _ in range(runs)), 4)
    for name, fn in catalog.queries().items():
        if only and name not in only:
            continue
        spark.sparkContext.setJobGroup(f"warm-{name}", "warm-up")
        _run(spark, fn, sf_dir)  # warm-up
        spark.sparkContext.setJobGroup(name, name)
        t0 = time.time()
        results[name] = round(statistics.median(_run(spark, fn, sf_dir) for _ in range(runs)), 4)
        marks.append((name, t0, time.time()))
    if eventlog:
        # for scripts/eventlog_report.py: jobs per query (stream jobs run in
        # their own thread and carry no job group)
        with open(os.path.join(eventlog, "marks.json"), "w") as fh:
            json.dump(marks, fh)
    sf = sf_dir.rsplit("sf", 1)[-1]
    out = {
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(results.values()), 3),
        "unit": "sec",
        "queries": results,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "runs": runs,
        "cpus": cpus,
        "shuffle_partitions": partitions,
        "spark": spark.version,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
