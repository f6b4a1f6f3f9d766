"""Seconds and shuffle bytes written per headline query, from Spark's event log.

Usage: python scripts/shuffle_report.py [sf_dir] [event_log_dir]
Each query runs in its own job group (after a warm-up on sf0.001); the event log (uncompressed,
written to a scratch folder) is read back and task shuffle-write bytes are summed per group."""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from veerline.plans.registry import QUERIES, load_all  # noqa: E402
from veerline.session import local_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = sys.argv[2] if len(sys.argv) > 2 else tempfile.mkdtemp(prefix="veerline-evlog-")
    load_all()
    spark = local_session(8, 16, extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                        "spark.eventLog.compress": "false"})
    sc = spark.sparkContext
    warm = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    secs = {}
    for name in HEADLINE:
        if os.path.isdir(warm):
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
        sc.setJobGroup(name, name)
        t0 = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        secs[name] = time.perf_counter() - t0
        sc.setJobGroup("other", "other")
    app = sc.applicationId
    spark.stop()
    path = [p for p in glob.glob(os.path.join(log_dir, "*")) if app in p][0]
    files = sorted(glob.glob(os.path.join(path, "*"))) if os.path.isdir(path) else [path]
    stage_group, shuffle, stages = {}, {}, {}
    for f in files:
        for line in open(f):
            e = json.loads(line)
            if e["Event"] == "SparkListenerJobStart":
                group = (e.get("Properties") or {}).get("spark.jobGroup.id")
                for sid in e.get("Stage IDs", []):
                    stage_group[sid] = group
            elif e["Event"] == "SparkListenerTaskEnd":
                m = (e.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}
                g = stage_group.get(e["Stage ID"])
                shuffle[g] = shuffle.get(g, 0) + m.get("Shuffle Bytes Written", 0)
            elif e["Event"] == "SparkListenerStageCompleted":
                g = stage_group.get(e["Stage Info"]["Stage ID"])
                stages[g] = stages.get(g, 0) + 1
    print("| query | seconds | stages | shuffle bytes written |\n| --- | --- | --- | --- |")
    for name in HEADLINE:
        print(f"| `{name}` | {secs[name]:.1f} | {stages.get(name, 0)} | {shuffle.get(name, 0):,} |")


if __name__ == "__main__":
    main()
