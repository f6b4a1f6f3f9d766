"""Ranks, shuffles and the balanced data set: invariants."""

from pyspark.sql import functions as F

from veerline.operators import sampling as S
from veerline.plans import model_queries as MQ
from veerline.plans import sampling_queries as SQ
from tests.conftest import SF_MID


def test_global_rank_matches_sort(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "k")
    ranked = S.shuffled_rank(df, ["k"], 3).collect()
    import hashlib
    expect = sorted(range(5000), key=lambda k: (hashlib.md5(f"{k}|3".encode()).hexdigest(), k))
    got = [r["k"] for r in sorted(ranked, key=lambda r: r["rank"])]
    assert got == expect
    assert sorted(r["rank"] for r in ranked) == list(range(1, 5001))


def test_union_common_columns(spark):
    a = spark.createDataFrame([(1, "x", 1.0)], "id int, s string, a double")
    b = spark.createDataFrame([("y", 2, True)], "s string, id int, b boolean")
    u = S.union_common_columns([a, b])
    assert u.columns == ["id", "s"] and u.count() == 2


def test_balanced_dataset_has_no_leak(spark):
    bal = SQ.balanced(spark, SF_MID).cache()
    test_acc = {r[0] for r in bal.where("split = 'test'").select("account_name").distinct().collect()}
    rest_acc = {r[0] for r in bal.where("split <> 'test'").select("account_name").distinct().collect()}
    assert test_acc and rest_acc and not (test_acc & rest_acc)
    counts = {(r["split"], r["label"]): r["n"] for r in S.class_counts(bal).collect()}
    pos = counts.get(("train", 1), 0) + counts.get(("valid", 1), 0)
    assert counts[("train", 1)] == int(pos * 0.8)
    bal.unpersist()


def test_folds_balanced(spark):
    rows = MQ.labelled_vectors(spark, SF_MID)
    per = rows.groupBy("label", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in per if r["label"] == label]
        assert max(sizes) - min(sizes) <= 1


def test_account_folds_keep_groups_together(spark):
    from veerline.operators import model as M
    df = spark.createDataFrame([(i, f"a{i // 3}", i % 2) for i in range(60)], "id int, acc string, label int")
    folds = M.stratified_folds(df, ["id"], "label", 5, by="acc")
    per_acc = folds.groupBy("acc").agg(F.count_distinct("fold").alias("n")).collect()
    assert all(r["n"] == 1 for r in per_acc)
