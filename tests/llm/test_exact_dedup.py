"""Exact dedup against SQL on the fixture and against plain grouping on made-up rows."""

import hashlib

import duckdb

from tests.llm.helpers import clashing, docs, duck, same_rows
from tests.conftest import SF_SMALL
from veerline.llm import queries
from veerline.llm.exact_dedup import exact_dedup

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_fixture_against_sql(spark):
    out = queries.QUERIES["op1_exact_dedup"](spark, SF_SMALL).toPandas()
    assert same_rows(out, duck(queries.ORACLE["op1_exact_dedup"]), COLUMNS)


def expected(rows):
    groups = {}
    for i, t in {(r[0], r[1] or "") for r in rows}:
        groups.setdefault(t, []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def test_blocks_ties_nulls_and_long_texts(spark):
    long = "abcdefgh" * 3000
    rows = [(1, "abcdef"), (2, "abcdef"), (3, "abcde"), (4, "abcdefg"), (5, None), (6, ""), (7, long), (8, long),
            (9, long[:-1] + "x"), (10, "abcd" + "abcd"), (11, "abcd"), (11, "abcd"), (11, "other"), (None, "abcd"),
            (None, "alone"), (12, "\n\U0001f600x" * 700), (13, "\n\U0001f600x" * 700), (14, long + "abcd"), (15, " abcdef")]
    for block in (4, 1024):
        out = exact_dedup(clashing(docs(spark, rows)), block_chars=block).collect()
        assert sorted([tuple(r[c] for c in COLUMNS) for r in out], key=repr) == expected(rows)


def test_empty_table(spark):
    out = exact_dedup(docs(spark, []))
    assert out.columns == COLUMNS and out.count() == 0


def test_repeated_rows_against_sql(spark, tmp_path):
    long = "abcdefgh" * 500
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, long), (3, long), (3, long), (4, long), (5, None), (5, ""), (None, "x"),
            (None, "x"), (None, "a"), (6, long + "z")] + [(7, "many")] * 25_000
    path = str(tmp_path / "documents.parquet")
    docs(spark, rows).write.parquet(path)
    out = queries.QUERIES["op1_exact_dedup"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}/*.parquet')")
    want = con.sql(queries.ORACLE["op1_exact_dedup"]).fetchall()

    assert len(out) == len(rows)
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))


def test_a_hot_text_is_a_skewed_join(spark):
    """The sizes are written before they are joined back: the hot name's partition is split."""
    tight = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k"}
    before = {k: spark.conf.get(k) for k in tight}
    try:
        for k, v in tight.items():
            spark.conf.set(k, v)
        rows = spark.range(120_000).selectExpr("id as doc_id", "case when id % 2 = 0 then 'hot' else concat('t', id) end as text")
        out = exact_dedup(rows.repartition(8), repeated_rows=True)
        out.collect()
        assert "SortMergeJoin(skew=true)" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
