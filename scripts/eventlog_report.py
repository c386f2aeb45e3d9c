"""Per-query jobs, stages and task time from a Spark event log.

Usage: python scripts/eventlog_report.py EVENTLOG_DIR

Expects jobs tagged with ``SparkContext.setJobGroup(query_name, ...)`` and a
``marks.json`` list of ``[name, start, end]`` (as written by
``python bench.py`` with ``BENCH_EVENTLOG_DIR`` set). Event logs may be plain
or zstd-compressed (Spark's default codec).
"""

from __future__ import annotations

import collections
import glob
import io
import json
import os
import sys


def _lines(path: str):
    with open(path, "rb") as fh:
        head = fh.read(4)
        fh.seek(0)
        if head == b"\x28\xb5\x2f\xfd":  # zstd frame
            import zstandard

            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
        else:
            yield from io.TextIOWrapper(fh, encoding="utf-8")


def summarise(log_dir: str) -> list[dict]:
    files = sorted(glob.glob(os.path.join(log_dir, "eventlog_v2_*", "events_*")) + glob.glob(os.path.join(log_dir, "local-*")))
    jobs: dict[int, dict] = {}
    task_s: dict[int, float] = collections.defaultdict(float)
    for f in files:
        for line in _lines(f):
            e = json.loads(line)
            ev = e.get("Event")
            if ev == "SparkListenerJobStart":
                group = (e.get("Properties") or {}).get("spark.jobGroup.id")
                jobs[e["Job ID"]] = {"group": group, "t0": e["Submission Time"], "stages": e.get("Stage IDs", [])}
            elif ev == "SparkListenerJobEnd" and e["Job ID"] in jobs:
                jobs[e["Job ID"]]["t1"] = e["Completion Time"]
            elif ev == "SparkListenerTaskEnd":
                info = e["Task Info"]
                task_s[e["Stage ID"]] += (info["Finish Time"] - info["Launch Time"]) / 1000
    per: dict[str, dict] = collections.defaultdict(lambda: {"jobs": 0, "stages": 0, "task_s": 0.0, "job_s": 0.0})
    for j in jobs.values():
        if not j["group"]:
            continue
        p = per[j["group"]]
        p["jobs"] += 1
        p["stages"] += len(j["stages"])
        p["task_s"] += sum(task_s.get(s, 0.0) for s in j["stages"])
        p["job_s"] += (j.get("t1", j["t0"]) - j["t0"]) / 1000
    marks = json.load(open(os.path.join(log_dir, "marks.json")))
    return [{"query": n, "wall_s": b - a, **per.get(n, {"jobs": 0, "stages": 0, "task_s": 0.0, "job_s": 0.0})} for n, a, b in marks]


def main() -> None:
    rows = summarise(sys.argv[1])
    print(f"{'query':18s} {'wall_s':>7s} {'jobs':>5s} {'stages':>6s} {'job_s':>7s} {'task_s':>7s}")
    for r in rows:
        print(f"{r['query']:18s} {r['wall_s']:7.2f} {r['jobs']:5d} {r['stages']:6d} {r['job_s']:7.2f} {r['task_s']:7.2f}")
    print(f"{'total':18s} {sum(r['wall_s'] for r in rows):7.2f} {sum(r['jobs'] for r in rows):5d} "
          f"{sum(r['stages'] for r in rows):6d} {sum(r['job_s'] for r in rows):7.2f} {sum(r['task_s'] for r in rows):7.2f}")


if __name__ == "__main__":
    main()
