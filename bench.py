"""Headline-query benchmark.

Runs each headline query over the whole tables at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS] (default 8). Each query is fully materialised through the ``noop`` sink (the
whole plan runs, nothing is collected). Prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from veerline.plans.registry import QUERIES, load_all  # noqa: E402
from veerline.session import local_session  # noqa: E402

HEADLINE = [
    "event_chunk_pairs",      # X1 on events: flag, tail, chunks, sums, carry-forward
    "timeline_features",      # X1 on conversations: + counts, cleaning, promotions
    "chunk_documents",        # X2: + token budget, ordered and shuffled chunk texts
    "clean_text",             # C10 on every document
    "encode_tokens",          # V2: vocabulary + encoding of every document
    "balanced_dataset",       # X3: leakage-free balanced splits
    "rank_by_similarity",     # T4 / V6
    "train_cv_gbt",           # M3: five boosted-tree folds
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    load_all()
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * cpus))
    # warm the JVM (class loading, JIT, codegen caches) with every query shape on the smallest data
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm) and os.path.abspath(warm) != os.path.abspath(sf_dir):
        for name in names:
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
