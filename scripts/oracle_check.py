"""Run every registered query in Spark and its oracle SQL in DuckDB; compare rows and values.

Usage: python scripts/oracle_check.py [sf_dir] [name ...]
Prints one line per query and a summary; exit code 1 if any compared query differs.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from veerline.plans.registry import ORACLE, QUERIES, load_all  # noqa: E402
from veerline.session import local_session  # noqa: E402
from veerline.sources.tables import TABLES  # noqa: E402


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if os.environ.get("ORACLE_EXACT") else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, bool):
        return int(v)
    return v


def rows_key(rows):
    """Rows as sorted reprs: strict about types and signs (0.0 vs -0.0, 1 vs 1.0)."""
    return sorted(repr(tuple(norm(x) for x in r)) for r in rows)


def main() -> int:
    args = sys.argv[1:]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)]
    load_all()
    extra = dict(kv.split("=", 1) for kv in os.environ.get("ORACLE_SPARK_CONF", "").split(",") if kv)
    spark = local_session(8, extra=extra)  # e.g. ORACLE_SPARK_CONF=spark.sql.ansi.enabled=false
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name in names or sorted(QUERIES):
        t0 = time.time()
        try:
            sdf = QUERIES[name](spark, sf)
            cols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in ORACLE:
            print(f"ROWS  {name}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            res = con.execute(ORACLE[name])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(cols) != sorted(dcols):
            print(f"FAIL  {name}: columns spark={cols} duckdb={dcols}")
            bad += 1
            continue
        order = [dcols.index(c) for c in cols]
        drows = [tuple(r[i] for i in order) for r in drows]
        a, b = rows_key(srows), rows_key(drows)
        if a == b:
            print(f"OK    {name}: {len(a)} rows {ts:.1f}s")
        else:
            bad += 1
            diff_a = [r for r in a if r not in set(b)][:3]
            diff_b = [r for r in b if r not in set(a)][:3]
            print(f"FAIL  {name}: spark {len(a)} rows, duckdb {len(b)} rows\n   spark-only {diff_a}\n   duck-only {diff_b}")
    print(f"{len(names or QUERIES) - bad} ok / {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
