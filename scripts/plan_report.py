"""Summarise the physical plans of the headline queries (from ``explain("formatted")``).

Usage: python scripts/plan_report.py [sf_dir] > PLANS.md
Counts shuffles, broadcasts, joins, windows, aggregates and scans, and lists what each scan reads
and which filters reach it."""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from veerline.plans.registry import QUERIES, load_all  # noqa: E402
from veerline.session import local_session  # noqa: E402

KINDS = ["Exchange", "ReusedExchange", "BroadcastExchange", "BroadcastQueryStage", "ShuffleQueryStage", "AQEShuffleRead", "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin",
         "BroadcastNestedLoopJoin", "CartesianProduct", "Window", "WindowGroupLimit", "HashAggregate",
         "ObjectHashAggregate", "SortAggregate", "Generate", "Scan parquet", "ArrowEvalPython",
         "MapInPandas", "BatchEvalPython"]
SKIP = {"train_cv_gbt"}  # fits run eagerly inside the query function; its plan is a local table


def formatted(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def summary(text: str) -> tuple[dict, list[tuple[str, str, str]]]:
    """Operator counts and scans of the final adaptive plan (the tree under '== Final Plan ==')."""
    tree = text.split("\n\n\n")[0]
    if "== Final Plan ==" in tree:
        tree = tree.split("== Final Plan ==")[1].split("== Initial Plan ==")[0]
    ids = {}
    for name, node_id in re.findall(r"(?:\+- |:- |^ *)(?:\* )?([A-Z][A-Za-z]+)[^()\n]*\((\d+)\)", tree, flags=re.M):
        ids[node_id] = "Scan parquet" if name == "Scan" else name
    counts = {k: sum(1 for n in ids.values() if n == k) for k in KINDS}
    scans = []
    for block in re.split(r"\n(?=\(\d+\) )", text):
        m = re.match(r"\((\d+)\) Scan parquet", block)
        if m and m.group(1) in ids:
            loc = re.search(r"Location: \S+ \[(.*?)\]", block)
            pushed = re.search(r"PushedFilters: \[(.*?)\]\n", block)
            schema = re.search(r"ReadSchema: (.*)", block)
            scans.append((os.path.basename(loc.group(1)) if loc else "?",
                          pushed.group(1) if pushed else "", schema.group(1) if schema else ""))
    return {k: v for k, v in counts.items() if v}, scans


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    load_all()
    spark = local_session(8, 16)
    print("# Physical plans of the headline queries\n")
    print(f"Generated by `python scripts/plan_report.py {sf}`: each query is run, then "
          "`explain(\"formatted\")` shows the final adaptive plan (query stages, reused exchanges, "
          "joins AQE switched at run time).\n")
    for name in HEADLINE:
        if name in SKIP:
            continue
        df = QUERIES[name](spark, sf)
        df.collect()  # run it, so that the adaptive plan below is the final one
        counts, scans = summary(formatted(df))
        print(f"## `{name}`\n")
        print("| operator | count |\n| --- | --- |")
        for k, v in counts.items():
            print(f"| {k} | {v} |")
        print("\n| scan | pushed filters | read schema |\n| --- | --- | --- |")
        for loc, pushed, schema in sorted(set(scans)):
            print(f"| {loc} | {pushed or '-'} | `{schema}` |")
        print()
    spark.stop()


if __name__ == "__main__":
    main()
