"""Thresholds of unrounded means, file names that need escaping, no keyword gate, checkpoint folders, whole decoding."""

import pytest
from pyspark.sql import functions as F

from veerline import session
from veerline.operators import docs as D
from veerline.operators import evaluate as E
from veerline.operators import model as M
from veerline.plans import feature_build as FB
from veerline.sources import io


def test_threshold_before_rounding(spark):
    preds = spark.createDataFrame([(1, 0.5000002), (1, 0.5000002)], "id int, prob double")
    raw = E.fold_average(preds, ["id"], digits=None).select(E.threshold_prediction("prob_avg")).first()[0]
    shown = E.fold_average(preds, ["id"]).select(E.threshold_prediction("prob_avg")).first()[0]
    assert (raw, shown) == (1, 0)


def test_account_of_an_escaped_file_name(spark, tmp_path):
    for name in ("a b é", "c+d", "e%20f"):
        (tmp_path / f"{name}.csv").write_text("x\n1\n")
    got = {r.account for r in io.read_timelines(spark, str(tmp_path), "x string").collect()}
    assert got == {"a b é", "c+d", "e%20f"}


def test_no_keywords_is_no_gate(spark):
    rows = [("a", 1, True, "@a", "said so", "1", "1"), ("a", 2, False, "@a", "own", "2", "1"), ("a", 3, False, "@b", "other", "3", "1")]
    df = spark.createDataFrame(rows, "account string, pos int, flag boolean, handle string, text string, likes string, reposts string")
    assert FB.build_features(df, with_text=False).count() == 1
    assert FB.build_features(df, p=FB.FeatureParams(keywords=("none",)), with_text=False).count() == 0


def test_folders(spark):
    df = spark.range(1)
    assert M.model_dir(df, "m") != M.model_dir(df, "m")

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815
        getConf = staticmethod(Conf)  # noqa: N815

    class Session:
        sparkContext, conf = Context, Conf()  # noqa: N815

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session)


def test_long_texts_are_decoded_whole(spark):
    words = [f"w{i}" for i in range(1500)]
    docs = spark.createDataFrame([(1, words)], "id int, tokens array<string>")
    vocab, ids = D.vocabulary_and_ids(docs, "id", "tokens")
    whole = ids.select("id", D.with_specials("ids").alias("ids"))
    assert D.decode_whole(whole, "id", "ids", vocab).first().decoded == " ".join(["[CLS]", *words, "[SEP]"])
    assert D.decode_pieces(whole, "id", "ids", vocab).first().decoded == "".join(words) + " "
    assert whole.select(F.size(D.attention_mask("ids")).alias("n")).first().n == 1502


def test_gain_agrees_with_importances(spark):
    from veerline.plans import model_queries as Q
    from tests.conftest import SF_SMALL
    cv, _ = Q.cv_and_test(spark, SF_SMALL)
    one = M.train_cv_gbt(cv, n_folds=5, max_iter=1)[0]
    paths = M.save_models([one], M.model_dir(spark.range(1), "gain"))
    gain = {r.feature: r.gain for r in M.gain_importance(spark, paths, Q.NAMES).collect()}
    total = sum(gain.values())
    for i, name in enumerate(Q.NAMES):
        assert abs(gain.get(name, 0.0) / total - one.featureImportances[i]) < 1e-9
