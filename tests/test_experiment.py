"""The experiment runner in both modes, decoded slices, and the encoded record."""

import pytest
from pyspark.sql import functions as F

from veerline.operators import evaluate as E
from veerline.operators import sampling as S
from veerline.operators import vectors as V
from veerline.plans import experiment as X
from veerline.plans import feature_build as FB


def _rows(spark, n_classes):
    rows = [(f"r{i:03d}", i % n_classes, [float(i % n_classes), float(i % 7)], "test" if i % 5 == 0 else "train",
             f"word{i % 4} common", "other side", f"flag {i}") for i in range(90)]
    return spark.createDataFrame(rows, "row_id string, label int, v array<double>, split string, posts_text_sorted string, "
                                       "reposts_text_sorted string, flag_text string")


@pytest.mark.parametrize("mode,names", [("two", {"tp", "fp", "fn", "tn"}), ("three", {f"{k}{c}" for k in "tf" for c in range(3)})])
def test_runner_modes_with_decoded_slices(spark, tmp_path, mode, names):
    n = 2 if mode == "two" else 3
    data, vocab = FB.encode_record(_rows(spark, n), ["row_id"])
    training = {"max_iter": 3, "max_depth": 2} if mode == "two" else {"num_trees": 5}
    res = X.run_experiment(data, ["row_id"], [], [("v", 2)], n_folds=3, slices_path=str(tmp_path / "slices"),
                           trace_cols=["flag_text"], mode=mode, vocabulary=vocab,
                           decoded=[X.DecodedColumn("posts_tokenized", "posts_decoded"),
                                    X.DecodedColumn("flag_posts_tokenized", "flag_decoded", whole=True)], **training)
    metrics = {r["metric"]: r["value"] for r in res.metrics.collect()}
    assert metrics["accuracy" if mode == "two" else "balanced_accuracy"] == 1.0   # the first component is the label
    slices = {r["outcome"]: r["n"] for r in res.slices.collect()}
    assert set(slices) <= names and sum(slices.values()) == 18
    back = spark.read.option("header", True).csv(str(tmp_path / "slices"))
    by_flag = {r["flag_text"]: r for r in back.collect()}
    assert by_flag["flag 25"]["flag_decoded"] == "[CLS] flag 25 [SEP]"
    assert "word1" in by_flag["flag 25"]["posts_decoded"] and "common" in by_flag["flag 25"]["posts_decoded"]
    assert res.fold_metrics.count() == 3
    if mode == "three":
        cells = {(r["label"], r["pred"]): r["n"] for r in res.confusion.collect()}
        assert len(cells) == 9 and sum(cells.values()) == 18
    assert X.as_report(res).where(F.col("value").isNull()).isEmpty()


def test_runner_refuses_bad_arguments(spark):
    rows = _rows(spark, 2)
    with pytest.raises(ValueError):
        X.run_experiment(rows, ["row_id"], [], [("v", 2)], mode="four")
    with pytest.raises(ValueError):
        X.run_experiment(rows, ["row_id"], [], [("v", 2)], decoded=[X.DecodedColumn("a", "b")])
    with pytest.raises(ValueError):
        FB.encode_record(rows, ["row_id"], "backwards")


def test_macro_metrics_by_fold_equal_each_fold_alone(spark):
    rows = spark.createDataFrame([(k, i % 3, (i * k) % 3) for k in range(3) for i in range(20)], "fold int, label int, pred int")
    together = {r["fold"]: r for r in E.macro_metrics(rows, by=["fold"]).collect()}
    for k in range(3):
        alone = E.macro_metrics(rows.where(F.col("fold") == k)).first()
        assert {c: together[k][c] for c in alone.asDict()} == alone.asDict()


def test_record_encodes_long_flags_whole_and_cuts_sides(spark):
    long = " ".join(f"t{i}" for i in range(700))
    rows = spark.createDataFrame([("a", 0, long, "", long), ("b", 0, None, "x", "")],
                                 "k string, chunk_id int, posts_text_sorted string, reposts_text_sorted string, flag_text string")
    record, vocab = FB.encode_record(rows, ["k", "chunk_id"], embed=V.letter_counts)
    got = {r["k"]: r for r in record.collect()}
    assert len(got["a"]["flag_posts_tokenized"]) == 702 and len(set(got["a"]["flag_posts_tokenized"])) == 702
    assert len(got["a"]["posts_tokenized"]) == 512
    assert got["a"]["posts_tokenized"][1:-1] == got["a"]["flag_posts_tokenized"][1:511]
    assert got["a"]["reposts_tokenized"] == got["b"]["posts_tokenized"] == [2, 3]
    assert vocab.count() == 701 and len(got["b"]["posts_embedding"]) == 26


def test_similarity_ranking_splits_a_hot_group(spark):
    rows = [(i, "g" if i % 3 else "h", [1.0, float(i % 40)], [1.0, 0.0]) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, v array<double>, q array<double>")
    plain = V.rank_by_similarity(df, "v", "q", ["g"], "id")
    split = V.rank_by_similarity(df, "v", "q", ["g"], "id", rows_per_task=20)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, split.collect()))
    top = V.rank_by_similarity(df, "v", "q", ["g"], "id", k=7)
    assert sorted(map(repr, top.collect())) == sorted(map(repr, plain.where("sim_rank <= 7").collect()))


def test_head_after_shuffle_is_a_prefix_of_the_whole_rank(spark):
    df = spark.range(3000).withColumn("k", F.col("id").cast("string"))
    whole = S.shuffled_rank(df, ["k"], 7)
    for n in (0, 1, 40, 5000):
        for digits in (1, 3):
            head = S.head_after_shuffle(df, ["k"], 7, n, hex_digits=digits)
            assert {r["id"] for r in head.collect()} == {r["id"] for r in whole.where(F.col("rank") <= n).collect()}


def test_ranked_form_puts_the_nearest_sentence_first(spark):
    posts = spark.createDataFrame([("u", 0, True, "@u", "aaa", "1", "1"), ("u", 1, False, "@u", "zzz", "1", "1"),
                                   ("u", 2, False, "@u", "drop aab", "1", "1"), ("u", 3, False, "@v", "aa", "1", "1")],
                                  "account string, pos int, flag boolean, handle string, text string, likes string, reposts string")
    dist = lambda a, b: V.cosine_distance(V.letter_counts(a), V.letter_counts(b))
    row = FB.build_features(posts, p=FB.FeatureParams(strip_words=("drop",)), distance=dist).first()
    assert row["posts_text_sorted"] == "zzz[SEP]drop aab"
    assert [t.strip() for t in row["posts_text_ranked"].split("[SEP]")] == ["aab", "zzz"]
    assert row["reposts_text_ranked"] == "aa" and row["posts_n_ranked"] == 2
