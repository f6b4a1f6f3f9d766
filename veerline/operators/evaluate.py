"""Evaluation as DataFrame jobs: thresholds, outcome slices, confusion matrices, binary / per-fold /
macro metrics, fold averages, feature-importance ratios.

Predictions are a long table (row key, fold, prob) - never a dense fold x row matrix on the
driver. All aggregates are single group-bys with map-side combine; the importance tables have
one row per feature, which is small by nature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Feature-name prefixes the importance report sums over.
IMPORTANCE_PREFIXES = ("posts_embedding", "reposts_embedding", "posts_like", "reposts_like",
                       "posts_repost", "reposts_repost")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def threshold_prediction(prob: Column | str) -> Column:
    """Round half to even, then int (0.5 -> 0, 0.51 -> 1)."""
    return F.bround(_c(prob), 0).cast("int")


def argmax_prediction(probs: Column | str) -> Column:
    """Index of the first maximum (0-based)."""
    p = _c(probs)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def outcome_binary(label: Column | str, pred: Column | str) -> Column:
    """P15, two classes: tp / fp / fn / tn."""
    y, p = _c(label), _c(pred)
    return (F.when((y == 1) & (p == 1), "tp").when((y == 0) & (p == 1), "fp")
            .when((y == 1) & (p == 0), "fn").when((y == 0) & (p == 0), "tn"))


def outcome_multiclass(label: Column | str, pred: Column | str) -> Column:
    """P15, several classes: 't<k>' when right, 'f<k>' when wrong (k = true label)."""
    y, p = _c(label), _c(pred)
    return F.concat(F.when(y == p, F.lit("t")).otherwise(F.lit("f")), y.cast("string"))


def fold_average(preds: DataFrame, key: Sequence[str], prob: str = "prob", digits: int | None = 6) -> DataFrame:
    """Mean probability over folds per row, rounded for display (None: as it is, for thresholds)."""
    mean = F.avg(prob) if digits is None else F.round(F.avg(prob), digits)
    return preds.groupBy(*key).agg(mean.alias("prob_avg"))


def fold_average_classes(preds: DataFrame, key: Sequence[str], n_classes: int, probs: str = "probs") -> DataFrame:
    """A8 for several classes: mean probability of each class over folds per row (``probs_avg``)."""
    means = [F.avg(F.get(probs, k)) for k in range(n_classes)]
    return preds.groupBy(*key).agg(F.array(*means).alias("probs_avg"))


def confusion_matrix(df: DataFrame, labels: Sequence[int], label: str = "label", pred: str = "pred") -> DataFrame:
    """A4: one row per (label, pred) of the given labels, zeros kept."""
    lits = F.array(*[F.lit(v) for v in labels])
    counts = df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    grid = (df.sparkSession.range(1).select(F.explode(lits).alias("label"))
            .select("label", F.explode(lits).alias("pred")))
    return (grid.join(counts, ["label", "pred"], "left")
            .select("label", "pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def binary_metric_aggs(label: str = "label", pred: str = "pred", digits: int = 6) -> list[Column]:
    """A5 aggregate expressions: accuracy, and precision / recall / F1 of class 1 (0 when undefined)."""
    y, p = F.col(label), F.col(pred)
    tp = F.count_if((y == 1) & (p == 1))
    fp = F.count_if((y != 1) & (p == 1))
    fn = F.count_if((y == 1) & (p != 1))
    n = F.count(F.lit(1))
    prec = _ratio(tp, tp + fp)
    rec = _ratio(tp, tp + fn)
    return [F.round(_ratio(F.count_if(y == p), n), digits).alias("accuracy"),
            F.round(prec, digits).alias("precision"), F.round(rec, digits).alias("recall"),
            F.round(_ratio(2 * tp, 2 * tp + fp + fn), digits).alias("f1"),
            tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.count_if((y != 1) & (p != 1)).alias("tn")]


def binary_metrics(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """A5."""
    return df.agg(*binary_metric_aggs(label, pred))


def fold_metrics(df: DataFrame, fold: str = "fold", label: str = "label", pred: str = "pred") -> DataFrame:
    """A5 per fold."""
    return df.groupBy(fold).agg(*binary_metric_aggs(label, pred))


def macro_metrics(df: DataFrame, label: str = "label", pred: str = "pred", digits: int = 6,
                  by: Sequence[str] = ()) -> DataFrame:
    """Balanced accuracy (mean recall over labels present in the truth) and macro precision,
    recall, F1 over labels in truth or prediction; per-label values are 0 when undefined. ``by``: one
    row per value of these columns (a fold)."""
    per_true = df.groupBy(*by, F.col(label).alias("k")).agg(F.count(F.lit(1)).alias("n_true"),
                                                         F.count_if(F.col(label) == F.col(pred)).alias("tp"))
    per_pred = df.groupBy(*by, F.col(pred).alias("k")).agg(F.count(F.lit(1)).alias("n_pred"))
    per = per_true.join(per_pred, [*by, "k"], "full").select(
        *by, "k", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_true", "tp", "n_pred")])
    prec = _ratio(F.col("tp"), F.col("n_pred"))
    rec = _ratio(F.col("tp"), F.col("n_true"))
    f1 = _ratio(2 * F.col("tp"), F.col("n_true") + F.col("n_pred"))
    return per.groupBy(*by).agg(
        F.round(F.avg(F.when(F.col("n_true") > 0, rec)), digits).alias("balanced_accuracy"),
        F.round(F.avg(prec), digits).alias("macro_precision"),
        F.round(F.avg(rec), digits).alias("macro_recall"),
        F.round(F.avg(f1), digits).alias("macro_f1"))


def importance_mean_ratio(gains: DataFrame, n_folds: int, fold: str = "fold", feature: str = "feature",
                          gain: str = "gain", digits: int = 6) -> DataFrame:
    """A9 + T5: mean gain per feature over all folds (a fold without the feature counts as 0),
    its share of the total, and the rank in descending order. One row per feature."""
    mean = gains.groupBy(feature).agg((F.sum(gain) / F.lit(n_folds)).alias("importance"))
    total = Window.partitionBy()
    order = Window.orderBy(F.desc("importance"), feature)
    return (mean.withColumn("importance_ratio", _ratio(F.col("importance"), F.sum("importance").over(total)))
            .withColumn("rank", F.row_number().over(order))
            .select(feature, F.round("importance", digits).alias("importance"),
                    F.round("importance_ratio", digits).alias("importance_ratio"), "rank"))


def importance_by_prefix(ratios: DataFrame, feature: str = "feature", ratio: str = "importance_ratio",
                         prefixes: Sequence[str] = IMPORTANCE_PREFIXES, digits: int = 6) -> DataFrame:
    """A10: importance ratio summed by feature-name prefix (anchored at the start)."""
    pattern = "^(" + "|".join(prefixes) + ")"
    return (ratios.withColumn("prefix", F.regexp_extract(feature, pattern, 1))
            .where(F.col("prefix") != "")
            .groupBy("prefix").agg(F.round(F.sum(ratio), digits).alias("ratio")))


def attach_predictions(rows: DataFrame, preds: DataFrame, key: Sequence[str]) -> DataFrame:
    """Predictions joined to rows on a real row key (never by position)."""
    return rows.join(preds, list(key))


def evaluate_run(df: DataFrame, mode: str = "two", label: str = "label", pred: str = "pred") -> DataFrame:
    """M7: the run's metrics as one long (metric, value) table."""
    if mode == "two":
        wide = binary_metrics(df, label, pred)
    else:
        wide = macro_metrics(df, label, pred)
    cols = wide.columns
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                                  for c in cols]))
    return wide.select(stacked.alias("m")).select("m.metric", "m.value")
