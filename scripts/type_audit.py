"""Compare result column types of every query (Spark) with its oracle (DuckDB)."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from veerline.plans.registry import ORACLE, QUERIES, load_all  # noqa: E402
from veerline.session import local_session  # noqa: E402
from veerline.sources.tables import TABLES  # noqa: E402

MAP = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
       "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def spark_to_duck(t: str) -> str:
    if t.startswith("array<"):
        return spark_to_duck(t[6:-1]) + "[]"
    return MAP.get(t, t.upper())


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    load_all()
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name in sorted(ORACLE):
        sdf = QUERIES[name](spark, sf)
        s_types = {f.name: spark_to_duck(f.dataType.simpleString()) for f in sdf.schema.fields}
        rel = con.sql(ORACLE[name])
        d_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        diffs = {c: (s_types.get(c), d_types.get(c)) for c in set(s_types) | set(d_types) if s_types.get(c) != d_types.get(c)}
        if diffs:
            bad += 1
            print(f"{name}: {diffs}")
    print(f"{bad} queries with type differences")
    return 0


if __name__ == "__main__":
    sys.exit(main())
