"""The bucketed hand-off: no exchange on the stored side, one file a bucket, hot accounts read as plain files."""

import uuid
from pathlib import Path

import pytest

from pyspark.sql import functions as F
from veerline.operators import sampling
from veerline.sources import bucketed


@pytest.fixture(scope="module")
def stored(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("a"), F.col("id") % 97)).alias("account_name"),
                                    "id").unionByName(spark.createDataFrame([(None, -1), (None, -2)], "account_name string, id long"))
    return bucketed.write_bucketed(rows, f"t_{uuid.uuid4().hex[:8]}", ["account_name"], 8)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_joins_and_sums_read_the_buckets(spark, stored):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        accounts = spark.createDataFrame([("a1",), ("a2",), ("zz",)], "account_name string")
        table = bucketed.read_bucketed(spark, stored)
        for join in (sampling.anti_join_accounts, sampling.semi_join_accounts):
            assert exchanges(join(table, accounts)) == 1                       # the list's
            assert exchanges(join(table, accounts).groupBy("account_name").count()) == 1
        assert exchanges(table.join(table.select("account_name", F.col("id").alias("other")), "account_name")) == 0
        plain = bucketed.read_bucketed(spark, stored, rows_per_task=1000)
        assert exchanges(sampling.anti_join_accounts(plain, accounts)) == 2
        assert sorted(map(repr, plain.collect())) == sorted(map(repr, table.collect()))
        kept = sampling.anti_join_accounts(table, accounts)
        assert kept.count() == table.count() - sampling.semi_join_accounts(table, accounts).count() and table.count() == 4002
        assert kept.where("account_name is null").count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_files_sizes_and_replacement(spark, stored):
    files = [p for p in Path(stored.path.removeprefix("file:")).iterdir() if p.name.endswith(".parquet")]
    assert 1 <= len(files) <= 8
    assert stored.largest >= 1334
    name = f"t_{uuid.uuid4().hex[:8]}"
    schema = "account_name string, id long"
    first = bucketed.write_bucketed(spark.createDataFrame([("x", 1), ("y", 2)], schema), name, ["account_name"])
    again = bucketed.write_bucketed(spark.createDataFrame([("z", 3)], schema), name, ["account_name"])
    assert first.buckets == 8 and [tuple(r) for r in bucketed.read_bucketed(spark, again).collect()] == [("z", 3)]
    empty = bucketed.write_bucketed(spark.createDataFrame([], schema), f"{name}_e", ["account_name"])
    assert empty.largest == 0 and bucketed.read_bucketed(spark, empty).count() == 0
