"""Summarise the executed physical plan of every catalog query.

Usage: python scripts/plan_report.py [SF_DIR] > PLANS.md

Each query runs once (collected) so AQE's final plan is reported:
scans (with pushed filters, partition filters and read schema), shuffles,
broadcasts, join strategies, windows and subqueries.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kpimart.plans import catalog  # noqa: E402
from kpimart.session import local_session  # noqa: E402

OPERATORS = (
    "SortMergeJoin",
    "BroadcastHashJoin",
    "ShuffledHashJoin",
    "BroadcastNestedLoopJoin",
    "CartesianProduct",
    "Window",
    "Generate",
    "Subquery",
    "ReusedExchange",
    "AQEShuffleRead",
)


def _table(location: str) -> str:
    m = re.search(r"/([A-Za-z_]+)\.parquet", location)
    if m:
        return m.group(1)
    m = re.search(r"/kpimart/([A-Za-z_]+)-[0-9a-f]", location)
    if m:
        return f"staged {m.group(1)}"
    return location.rsplit("/", 1)[-1]


def final_only(plan: str) -> str:
    """Drop every "Initial Plan" block of an executed adaptive plan (and of
    its subqueries), keeping the final plans."""
    out, skip_depth = [], None
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :|"))
        if skip_depth is not None:
            if depth > skip_depth:
                continue
            skip_depth = None
        if "== Initial Plan ==" in line:
            skip_depth = depth
            continue
        out.append(line)
    return "\n".join(out)


def summarise(plan: str) -> dict:
    plan = final_only(plan)
    scans = []
    for line in plan.splitlines():
        if "FileScan" not in line:
            continue
        fmt = re.search(r"FileScan (\w+)", line).group(1)
        loc = re.search(r"Location: [^\[]*\[([^,\]]*)", line)
        pushed = re.search(r"PushedFilters: \[(.*?)(?:\], ReadSchema|\.\.\., ReadSchema)", line)
        parts = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", line)
        schema = re.search(r"ReadSchema: (struct<.*?>)$", line.strip())
        scans.append(
            {
                "table": _table(loc.group(1) if loc else ""),
                "format": fmt,
                "pushed": pushed.group(1) if pushed else "",
                "partition": re.sub(r"#\d+L?", "", parts.group(1)) if parts else "",
                "schema": schema.group(1) if schema else "?",
            }
        )
    counts = {op: len(re.findall(rf"\b{op}\b", plan)) for op in OPERATORS}
    counts["Exchange hashpartitioning"] = len(re.findall(r"Exchange hashpartitioning", plan))
    counts["Exchange SinglePartition"] = len(re.findall(r"Exchange SinglePartition", plan))
    counts["BroadcastExchange"] = len(re.findall(r"BroadcastExchange", plan))
    counts["Exchange RoundRobin/Range"] = len(re.findall(r"Exchange (?:RoundRobinPartitioning|rangepartitioning)", plan))
    return {"scans": scans, "counts": {k: v for k, v in counts.items() if v}}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8)
    print("# PLANS\n")
    print(f"Executed physical plans (AQE final) of the catalog queries on `{sf_dir}`, Spark {spark.version},")
    print("`local[8]`, `spark.sql.shuffle.partitions=8`. Generated by `scripts/plan_report.py`.\n")
    for name, fn in catalog.queries().items():
        df = fn(spark, sf_dir)
        df.collect()  # runs this DataFrame's own query execution, so AQE's final plan is reported
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        doc = (fn.__doc__ or "").strip().splitlines()[0]
        print(f"## `{name}`\n\n{doc}\n")
        ops = ", ".join(f"{k} ×{v}" for k, v in s["counts"].items()) or "none"
        print(f"- operators: {ops}")
        for sc in s["scans"]:
            extra = []
            if sc["pushed"]:
                extra.append(f"pushed `{sc['pushed']}`")
            if sc["partition"]:
                extra.append(f"partition filters `{sc['partition']}`")
            print(f"- scan `{sc['table']}` reads `{sc['schema']}`" + ("; " + "; ".join(extra) if extra else ""))
        print()


if __name__ == "__main__":
    main()
