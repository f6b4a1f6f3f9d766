"""X4 for any split feature table: assemble -> stratified folds -> k-fold boosted trees with
fold-mean early stopping -> fold predictions on the test split -> averaged, thresholded
predictions -> metrics and importance shares (and, if asked, the saved fold models).

Mode "three": multiclass fold models, class probabilities averaged over folds, first maximum,
t<k> / f<k> slices, the confusion matrix of all classes and macro metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veerline.operators import boosting as B
from veerline.operators import docs as D
from veerline.operators import evaluate as E
from veerline.operators import model as M
from veerline.sources import io


@dataclass
class ExperimentResult:
    models: list
    predictions: DataFrame | None   # key..., label, prob_avg, pred (test rows)
    metrics: DataFrame | None       # metric, value
    importance: DataFrame | None    # feature, importance, importance_ratio, rank
    shares: DataFrame | None        # prefix, ratio
    slices: DataFrame | None = None  # outcome, n (rows written per confusion cell)
    fold_metrics: DataFrame | None = None  # fold, accuracy, precision, recall, f1, tp, fp, fn, tn (three: macro)
    confusion: DataFrame | None = None  # label, pred, n (mode "three")


FOLD_METRICS = {"two": ("accuracy", "precision", "recall", "f1"),
                "three": ("balanced_accuracy", "macro_precision", "macro_recall", "macro_f1")}


@dataclass(frozen=True)
class DecodedColumn:
    """A trace column of decoded ids (V3): piece by piece, or as one text (``whole``)."""
    ids: str
    name: str
    whole: bool = False


def decode_columns(rows: DataFrame, key: Sequence[str], columns: Sequence[DecodedColumn], vocabulary: DataFrame) -> DataFrame:
    """``rows`` with the decoded text of each of ``columns`` (ids columns) added, joined on ``key``."""
    for d in columns:
        ids = rows.select(F.struct(*key).alias("_key"), F.col(d.ids).alias("_ids"))
        text = (D.decode_whole if d.whole else D.decode_pieces)(ids, "_key", "_ids", vocabulary)
        rows = rows.join(text.select(*[F.col(f"_key.{k}").alias(k) for k in key], F.col("decoded").alias(d.name)), list(key))
    return rows


def run_experiment(data: DataFrame, key: Sequence[str], scalar_cols: Sequence[str],
                   vector_cols: Sequence[tuple[str, int]], label: str = "label", split: str = "split",
                   n_folds: int = 5, model_path: str | None = None, slices_path: str | None = None,
                   trace_cols: Sequence[str] = (), metrics_path: str | None = None, run: str = "run",
                   mode: str = "two", n_classes: int = 3, decoded: Sequence[DecodedColumn] = (),
                   vocabulary: DataFrame | None = None, trainer: str = "depthwise", **training) -> ExperimentResult:
    """Train on the rows whose ``split`` is not 'test', evaluate on 'test'. ``vector_cols`` are
    (array column, length) pairs; importance needs ``model_path`` (the fold models are saved
    there, S9) because raw gains are read from the saved trees. With ``slices_path`` the test
    rows' ``trace_cols`` are written with label and prediction, one CSV folder per confusion
    cell (J6 -> P15 -> S7). Each fold model is also scored on the test rows on its own (A6); with
    ``metrics_path`` those per-fold accuracy / precision / recall / F1 rows are appended there
    under ``run`` (S6), as every run of the original adds a line per metric.

    ``mode`` "three" trains on labels 0 to ``n_classes`` - 1. ``decoded`` ids columns are decoded with
    ``vocabulary`` and written beside the trace columns. ``training`` goes to the fold training: the
    ``trainer`` "leafwise" boosts best-first trees (softmax in mode "three") and takes the fields of
    ``BoostParams``; "depthwise" takes Spark ML's boosted trees, in mode "three" its forest."""
    if mode not in FOLD_METRICS:
        raise ValueError(f"unknown mode {mode!r}")
    if trainer not in ("leafwise", "depthwise"):
        raise ValueError(f"unknown trainer {trainer!r}")
    if decoded and vocabulary is None:
        raise ValueError("decoded columns need a vocabulary")
    two = mode == "two"
    names = M.feature_names(scalar_cols, vector_cols)
    rows = M.assemble_features(data, scalar_cols, [c for c, _ in vector_cols])
    cv = M.stratified_folds(rows.where(F.col(split) != "test"), list(key), label, n_folds)
    test = rows.where(F.col(split) == "test")
    if trainer == "leafwise":
        params = B.BoostParams(classes=2 if two else n_classes, **training)
        fit = B.start_boosting(cv, list(key), label=label, n_folds=n_folds, params=params)
        models = [fit.run().model()] if sum(fit.sizes) else []
    else:
        models = (M.train_cv_gbt if two else M.train_cv_multiclass)(cv, label=label, n_folds=n_folds, **training)
    if not models:
        return ExperimentResult([], None, None, None, None)
    if trainer == "leafwise":
        preds = models[0].predict(test, [*key, label])
    else:
        preds = M.predict_folds(models, test, [*key, label], n_classes=None if two else n_classes)
    confusion = None
    if two:
        avg = (E.fold_average(preds, [*key, label], digits=None).withColumn("pred", E.threshold_prediction("prob_avg"))
               .withColumn("prob_avg", F.round("prob_avg", 6)))
        per_fold = E.fold_metrics(preds.withColumn("pred", E.threshold_prediction("prob")), "fold", label, "pred")
    else:
        avg = E.fold_average_classes(preds, [*key, label], n_classes).withColumn("pred", E.argmax_prediction("probs_avg"))
        per_fold = E.macro_metrics(preds.withColumn("pred", E.argmax_prediction("probs")), label, "pred", by=["fold"])
        confusion = E.confusion_matrix(avg, range(n_classes), label, "pred")
    metrics = E.evaluate_run(avg, mode, label)
    if metrics_path is not None:
        long = per_fold.select("fold", F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in FOLD_METRICS[mode]
        ])).alias("m")).select("fold", "m.metric", "m.value")
        io.append_fold_metrics(long, metrics_path, run)
    importance = shares = None
    if model_path is not None:
        if trainer == "leafwise":
            models[0].save(data.sparkSession, model_path)
            gains = models[0].gain_importance(data.sparkSession, names)
        else:
            gains = M.gain_importance(data.sparkSession, M.save_models(models, model_path), names)
        importance = E.importance_mean_ratio(gains, n_folds, digits=12)
        shares = E.importance_by_prefix(importance)
    slices = None
    if slices_path is not None:
        traced = test.select(*key, *trace_cols, *[d.ids for d in decoded])
        if decoded:
            traced = decode_columns(traced, key, decoded, vocabulary)
        traced = E.attach_predictions(traced, avg.select(*key, label, "pred"), key)
        traced = traced.withColumn("outcome", (E.outcome_binary if two else E.outcome_multiclass)(label, "pred"))
        io.write_outcome_slices(traced, slices_path, [*trace_cols, *[d.name for d in decoded], label, "pred"])
        slices = (data.sparkSession.read.options(**io.CSV_OPTIONS).csv(slices_path)
                  .groupBy("outcome").agg(F.count(F.lit(1)).alias("n")))
    return ExperimentResult(models, avg, metrics, importance, shares, slices, per_fold, confusion)


def as_report(result: ExperimentResult, sizes: DataFrame | None = None) -> DataFrame:
    """One long (section, name, value) table: split sizes, metrics, importance shares."""
    parts = []
    if sizes is not None:
        parts.append(sizes)
    if result.metrics is not None:
        parts.append(result.metrics.select(F.lit("metric").alias("section"), F.col("metric").alias("name"), "value"))
    if result.fold_metrics is not None:
        f1 = "f1" if "f1" in result.fold_metrics.columns else "macro_f1"
        parts.append(result.fold_metrics.select(
            F.lit("fold_metric").alias("section"),
            F.concat(F.lit(f1 + "@fold"), F.col("fold").cast("string")).alias("name"), F.col(f1).alias("value")))
    if result.confusion is not None:
        parts.append(result.confusion.select(
            F.lit("confusion").alias("section"),
            F.concat(F.col("label").cast("string"), F.lit("->"), F.col("pred").cast("string")).alias("name"),
            F.col("n").cast("double").alias("value")))
    if result.slices is not None:
        parts.append(result.slices.select(F.lit("slice").alias("section"), F.col("outcome").alias("name"),
                                          F.col("n").cast("double").alias("value")))
    if result.shares is not None:
        parts.append(result.shares.select(F.lit("importance").alias("section"), F.col("prefix").alias("name"),
                                          F.col("ratio").alias("value")))
    if not parts:  # no training rows and no sizes asked for: an empty report
        return SparkSession.active().createDataFrame([], "section string, name string, value double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report_checks(report: DataFrame, labels: Sequence[int], mode: str = "two", slices: bool = False) -> DataFrame:
    """What must hold in a report, as (section, name, value), in one pass over its few rows.

    ``rows``: test rows of each label, summed from the confusion cells; ``slices`` (if asked): the same from
    the written slices; ``folds``: fold models scored with an F1 in 0 to 1; ``check``: 1 if the metrics equal
    those recomputed from the cells, 1 if the importance shares add up to 1, else 0. A missing value never
    passes."""
    def total(section: str, *names: str) -> Column:
        hit = (F.col("section") == section) & F.col("name").isin(*names)
        return F.sum(F.when(hit, F.col("value")))

    two = mode == "two"
    cell = ((lambda t, p: total("metric", ("tn", "fp", "fn", "tp")[2 * t + p])) if two
            else (lambda t, p: total("confusion", f"{t}->{p}")))
    cells = {(t, p): F.coalesce(cell(t, p), F.lit(-1.0)) for t in labels for p in labels}
    in_label = {t: sum((cells[t, p] for p in labels[1:]), cells[t, labels[0]]) for t in labels}
    pred_as = {p: sum((cells[t, p] for t in labels[1:]), cells[labels[0], p]) for p in labels}
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    if two:
        recomputed = {"accuracy": ratio(cells[0, 0] + cells[1, 1], in_label[0] + in_label[1]),
                      "precision": ratio(cells[1, 1], pred_as[1]), "recall": ratio(cells[1, 1], in_label[1]),
                      "f1": ratio(2 * cells[1, 1], in_label[1] + pred_as[1])}
    else:
        # a class with neither true nor predicted rows is not a class of the run
        seen = sum((F.when(in_label[k] + pred_as[k] > 0, 1).otherwise(0) for k in labels), F.lit(0))
        mean = lambda part, n=seen: ratio(sum((part(k) for k in labels), F.lit(0.0)), n)
        present = sum((F.when(in_label[k] > 0, 1).otherwise(0) for k in labels), F.lit(0))
        recomputed = {"balanced_accuracy": mean(lambda k: ratio(cells[k, k], in_label[k]), present),
                      "macro_precision": mean(lambda k: ratio(cells[k, k], pred_as[k])),
                      "macro_recall": mean(lambda k: ratio(cells[k, k], in_label[k])),
                      "macro_f1": mean(lambda k: ratio(2 * cells[k, k], in_label[k] + pred_as[k]))}
    off = [F.abs(total("metric", m) - x) < 1e-5 for m, x in recomputed.items()]
    flag = lambda ok: F.when(F.coalesce(ok, F.lit(False)), 1.0).otherwise(0.0)
    all_off = off[0]
    for x in off[1:]:
        all_off = all_off & x
    f1 = (F.col("section") == "fold_metric") & F.col("value").between(0, 1)
    share = F.sum(F.when(F.col("section") == "importance", F.col("value")))
    out = [("rows", str(t), in_label[t]) for t in labels]
    if slices:
        names = (lambda t: ("tp", "fn") if t else ("fp", "tn")) if two else (lambda t: (f"t{t}", f"f{t}"))
        out += [("slices", str(t), F.coalesce(total("slice", *names(t)), F.lit(0.0))) for t in labels]
    out += [("folds", "scored", F.sum(F.when(f1, 1.0).otherwise(0.0))), ("check", "metrics", flag(all_off)),
            ("check", "importance", flag(F.abs(share - 1) < 1e-4))]
    row = F.array(*[F.struct(F.lit(a).alias("section"), F.lit(b).alias("name"), v.cast("double").alias("value")) for a, b, v in out])
    return report.agg(row.alias("r")).select(F.explode("r").alias("r")).select("r.section", "r.name", "r.value")
