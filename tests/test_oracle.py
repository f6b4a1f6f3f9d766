"""Every registered query against its DuckDB oracle at sf0.001, and the entry smoke check."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_mod
from scripts.type_audit import spark_to_duck
from veerline.sources.tables import TABLES
from tests.conftest import SF_SMALL

QUERIES = entry_mod.queries()
ORACLE = entry_mod.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_entry(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert df.columns == ["user_id", "chunk_id", "n_own", "own_value", "other_chunk_id", "n_other", "other_value", "label"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    cols = sdf.columns
    s_rows = sorted(repr(tuple(_norm(x) for x in r)) for r in sdf.collect())
    rel = con.sql(ORACLE[name])
    s_types = {f.name: spark_to_duck(f.dataType.simpleString()) for f in sdf.schema.fields}
    assert s_types == dict(zip(rel.columns, map(str, rel.types)))
    res = con.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(dcols)
    idx = [dcols.index(c) for c in cols]
    d_rows = sorted(repr(tuple(_norm(r[i]) for i in idx)) for r in res.fetchall())
    assert s_rows == d_rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.columns and df.count() > 0
