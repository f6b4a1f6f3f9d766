"""Model training and evaluation invariants."""

from pyspark.sql import functions as F

from veerline.operators import evaluate as E
from veerline.operators import model as M
from veerline.plans import model_queries as MQ
from tests.conftest import SF_SMALL


def test_train_predict_importance(spark):
    models, test = MQ.trained(spark, SF_SMALL)
    assert len(models) == 5
    preds = MQ.M.predict_folds(models, test, ["vec_id"])
    stats = preds.agg(F.min("prob"), F.max("prob"), F.count_distinct("fold")).first()
    assert 0.0 <= stats[0] <= stats[1] <= 1.0 and stats[2] == 5
    import tempfile
    paths = MQ.M.save_models(models, tempfile.mkdtemp(prefix="veerline-test-"))
    ratios = E.importance_mean_ratio(MQ.M.gain_importance(spark, paths, MQ.NAMES), 5, digits=12)
    assert abs(ratios.agg(F.sum("importance_ratio")).first()[0] - 1.0) < 1e-9


def test_confusion_keeps_zero_cells(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "label int, pred int")
    cm = {(r["label"], r["pred"]): r["n"] for r in E.confusion_matrix(df, [0, 1, 2]).collect()}
    assert len(cm) == 9 and cm[(0, 0)] == 1 and cm[(1, 0)] == 1 and cm[(2, 2)] == 0


def test_macro_metrics_labels_only_predicted(spark):
    # label 2 only predicted: counts in macro precision / f1, not in balanced accuracy
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 1), (1, 0)], "label int, pred int")
    m = E.macro_metrics(df).first()
    assert m["balanced_accuracy"] == 0.5
    assert abs(m["macro_precision"] - round((0.5 + 1.0 + 0.0) / 3, 6)) < 1e-9


def test_first_fit_is_long_enough_to_stop_early(spark, monkeypatch):
    rounds, classifier = [], M.GBTClassifier
    monkeypatch.setattr(M, "GBTClassifier", lambda **kw: (rounds.append(kw["maxIter"]), classifier(**kw))[1])
    rows = spark.range(40).selectExpr("array(cast(id % 10 as double)) as a", "cast(id % 10 < 5 as int) as label", "cast(id % 2 as int) as fold")
    M.train_cv_gbt(M.assemble_features(rows, [], ["a"]), n_folds=2, max_iter=6, early_stopping_rounds=2, max_depth=1)
    assert rounds[:2] == [6, 6]                                  # not 3, 3, 6, 6


def test_best_round_patience():
    from veerline.operators.model import best_round
    assert best_round([3, 2, 1, 1.5, 1.2, 1.1], 3) == (3, True)
    assert best_round([3, 2, 1, 0.9], 3) == (4, False)
    assert best_round([1.0] * 5, 2) == (1, True)


def test_empty_experiment_report(spark):
    from veerline.plans import experiment as X
    empty = spark.createDataFrame([], "k int, label int, split string, v array<double>")
    res = X.run_experiment(empty, ["k"], [], [("v", 2)])
    assert res.models == [] and X.as_report(res).count() == 0
