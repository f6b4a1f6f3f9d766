"""The flags that the model queries return: true on a sound result, false on a broken one."""

import pytest
from pyspark.sql import functions as F

from veerline.plans import eval_queries as EQ
from veerline.plans import experiment as X
from veerline.plans import model_queries as MQ

TWO = [("metric", "accuracy", 0.7), ("metric", "precision", 0.75), ("metric", "recall", 0.6), ("metric", "f1", 0.666667),
       ("metric", "tp", 3.0), ("metric", "fp", 1.0), ("metric", "fn", 2.0), ("metric", "tn", 4.0),
       ("slice", "tp", 3.0), ("slice", "fp", 1.0), ("slice", "fn", 2.0), ("slice", "tn", 4.0),
       ("fold_metric", "f1@fold0", 0.5), ("fold_metric", "f1@fold1", 1.0),
       ("importance", "a", 0.25), ("importance", "b", 0.75)]
GOOD = {("rows", "0"): 5.0, ("rows", "1"): 5.0, ("slices", "0"): 5.0, ("slices", "1"): 5.0, ("folds", "scored"): 2.0,
        ("check", "metrics"): 1.0, ("check", "importance"): 1.0}


def checks(spark, rows, **kw):
    report = spark.createDataFrame(rows, "section string, name string, value double")
    return {(r["section"], r["name"]): r["value"] for r in X.report_checks(report, **kw).collect()}


def test_sound_report(spark):
    assert checks(spark, TWO, labels=[0, 1], slices=True) == GOOD


@pytest.mark.parametrize("name,value,broken", [
    (("metric", "recall"), 0.61, ("check", "metrics")), (("metric", "accuracy"), None, ("check", "metrics")),
    (("metric", "tn"), 5.0, ("rows", "0")), (("metric", "tp"), None, ("rows", "1")),
    (("slice", "fn"), 1.0, ("slices", "1")), (("fold_metric", "f1@fold1"), 1.5, ("folds", "scored")),
    (("importance", "b"), 0.5, ("check", "importance"))])
def test_broken_report(spark, name, value, broken):
    rows = [(s, n, value if (s, n) == name else v) for s, n, v in TWO]
    assert checks(spark, rows, labels=[0, 1], slices=True)[broken] != GOOD[broken]


def test_empty_report_passes_nothing(spark):
    got = checks(spark, [], labels=[0, 1], slices=True)
    assert set(got) == set(GOOD) and all(got[k] != GOOD[k] for k in GOOD)


def test_three_class_report(spark):
    cells = {(0, 0): 2, (0, 1): 1, (0, 2): 0, (1, 0): 0, (1, 1): 3, (1, 2): 0, (2, 0): 1, (2, 1): 0, (2, 2): 1}
    rows = [("confusion", f"{t}->{p}", float(n)) for (t, p), n in cells.items()]
    rows += [("metric", "balanced_accuracy", 0.722222), ("metric", "macro_precision", (2 / 3 + 3 / 4 + 1) / 3),
             ("metric", "macro_recall", 0.722222), ("metric", "macro_f1", (4 / 6 + 6 / 7 + 2 / 3) / 3)]
    got = checks(spark, rows, labels=[0, 1, 2], mode="three")
    assert [got["rows", str(k)] for k in range(3)] == [3.0, 3.0, 2.0] and got["check", "metrics"] == 1.0
    wrong = [(s, n, 0.5 if n == "macro_f1" else v) for s, n, v in rows]
    assert checks(spark, wrong, labels=[0, 1, 2], mode="three")["check", "metrics"] == 0.0


def test_importance_agreement(spark):
    expected = spark.createDataFrame([(0, "a", 0.75), (0, "b", 0.25), (0, "c", 0.0)], "fold int, feature string, share double")
    gains = lambda a: spark.createDataFrame([(0, "a", a), (0, "b", 10.0)], "fold int, feature string, gain double")
    flags = lambda g: {r["feature"]: r["agrees"] for r in MQ.importance_agreement(g, expected).collect()}
    assert flags(gains(30.0)) == {"a": True, "b": True, "c": True}
    assert flags(gains(20.0)) == {"a": False, "b": False, "c": True}
    assert flags(gains(30.0).limit(0)) == {"a": False, "b": False, "c": False}


def test_component_checks(spark):
    def flags(rows):
        df = spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, reduced array<double>")
        return {(r["section"], r["key"]): r["ok"] for r in EQ.component_checks(df, 2).collect()}

    good = [[2.0, 1.0], [-2.0, 1.0], [2.0, -1.0], [-2.0, -1.0]]
    assert all(flags(good).values())
    assert not flags([[x, x + y] for x, y in good])["pair", 1]          # correlated
    assert not flags([[y, x] for x, y in good])["order", 0]             # the wrong way round
    assert not flags([*good, [1.0]])["row", 4]                          # a component is missing


def test_sound_is_false_for_missing_values(spark):
    rows = spark.createDataFrame([(0.5,), (1.5,), (None,)], "prob double")
    assert [r[0] for r in rows.select(MQ.sound(F.col("prob").between(0, 1))).collect()] == [True, False, False]
