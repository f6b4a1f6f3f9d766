"""Model training and evaluation as Spark ML jobs: feature assembly, stratified folds, k-fold
boosted trees cut at the fold-mean early-stopping round, fold predictions, multiclass training,
per-fold gain importance, and model persistence.

Folds are independent fits; they are submitted from a small thread pool (as CrossValidator's
``parallelism`` does; threads inherit the caller's job group), so the cluster runs them side by
side. Each fit is a distributed job over training rows checkpointed once; the driver only gets
the fitted trees, per-fold row counts and per-round held-out losses (bounded by the round count)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veerline.operators.sampling import shuffled_rank
from veerline.session import ensure_checkpoint_dir


def assemble_features(df: DataFrame, scalar_cols: Sequence[str], vector_cols: Sequence[str],
                      out: str = "features") -> DataFrame:
    """M1: scalars and array columns concatenated into one ``VectorUDT`` column."""
    parts: list[Column] = []
    if scalar_cols:
        parts.append(F.array(*[F.col(c).cast("double") for c in scalar_cols]))
    parts += [F.col(c).cast("array<double>") for c in vector_cols]
    return df.withColumn(out, array_to_vector(F.concat(*parts)))


def feature_names(scalar_cols: Sequence[str], vector_cols: Sequence[tuple[str, int]]) -> list[str]:
    """Names of the assembled positions: scalars, then prefix_1..prefix_dim per vector column."""
    names = list(scalar_cols)
    for prefix, dim in vector_cols:
        names += [f"{prefix}_{i + 1}" for i in range(dim)]
    return names


def stratified_folds(df: DataFrame, key: Sequence[str], label: str = "label", n_folds: int = 5,
                     seed: int = 42, by: str | None = None, hex_digits: int = 3) -> DataFrame:
    """M2: fold = rank within label (seeded shuffle order) mod n_folds: balanced to +-1 per label.

    With ``by`` (e.g. the account column) whole groups go to one fold, so no group is both in a
    fold's training and validation part; groups are ranked in seeded order within their label."""
    if by is None:
        ranked = shuffled_rank(df, list(key), seed, "_r", partition_by=[label], hex_digits=hex_digits)
        return ranked.withColumn("fold", ((F.col("_r") - 1) % n_folds).cast("int")).drop("_r")
    groups = df.groupBy(by).agg(F.max(label).alias("_gl"))
    ranked = shuffled_rank(groups, [by], seed, "_r", partition_by=["_gl"], hex_digits=hex_digits)
    folds = ranked.select(by, ((F.col("_r") - 1) % n_folds).cast("int").alias("fold"))
    return df.join(folds, by)


def stratified_group_folds(df: DataFrame, group: str, label: str = "label", n_folds: int = 5, seed: int = 42,
                           hex_digits: int = 3) -> DataFrame:
    """M2 with whole groups (accounts), balanced in rows: no group is in two folds, and when a group has rows of
    one label only, the rows of a label differ between two folds by at most that label's largest group.

    A group's type is its number of rows by label. Within a group's main label (most rows; ties: the smallest)
    types are ordered by size, the largest first, and dealt to the folds in turn: a type starts where the sizes of the types before
    it (prefix sums over the table of types) end, and its groups follow in seeded order. Rows without a group form one
    group. Groups are counted with map-side combine; a hot group is one row."""
    rows = df.groupBy(F.col(group).alias("_g"), F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    sized = rows.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("_l", "_n"))).alias("_type"), F.sum("_n").alias("_rows"))
    most = F.array_max(F.transform("_type", lambda x: x["_n"]))
    sized = sized.withColumn("_main", F.coalesce(F.get(F.filter("_type", lambda x: x["_n"] == most), 0)["_l"].cast("string"), F.lit("")))
    typed = sized.select("_g", "_main", most.alias("_most"), "_rows", F.to_json("_type").alias("_type"))
    types = typed.groupBy("_main", "_most", "_rows", "_type").agg(F.count(F.lit(1)).alias("_k"))
    before = (Window.partitionBy("_main").orderBy(F.desc("_most"), F.desc("_rows"), "_type").rowsBetween(Window.unboundedPreceding, -1))
    starts = types.select(F.col("_main").alias("_m"), F.col("_type").alias("_t"), F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_start"))
    ranked = shuffled_rank(typed.select(F.coalesce(F.col("_g").cast("string"), F.lit("")).alias("_name"), "*"), ["_name"], seed, "_r",
                           partition_by=["_main", "_type"], hex_digits=hex_digits)
    joined = ranked.join(starts, (F.col("_main") == F.col("_m")) & (F.col("_type") == F.col("_t")))
    folds = joined.select("_g", ((F.col("_start") + F.col("_r") - 1) % n_folds).cast("int").alias("fold"))
    return df.join(folds, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def best_round(mean_losses: Sequence[float], patience: int) -> tuple[int, bool]:
    """Early stopping on the fold-mean held-out loss: the 1-based round with the lowest loss, and
    whether the rule fired (``patience`` rounds without a new best were seen)."""
    best, best_loss = 0, float("inf")
    for r, loss in enumerate(mean_losses):
        if loss < best_loss:
            best, best_loss = r, loss
        elif r - best >= patience:
            return best + 1, True
    return best + 1, False


def train_cv_gbt(df: DataFrame, features: str = "features", label: str = "label", fold: str = "fold",
                 n_folds: int = 5, max_iter: int = 1000, early_stopping_rounds: int = 20,
                 step_size: float = 0.1, max_depth: int = 5, seed: int = 42, parallelism: int = 5
                 ) -> list[GBTClassificationModel]:
    """M3: one boosted-tree model per fold, trained on the other folds, all cut at the round where
    the fold-mean held-out log-loss stopped improving for ``early_stopping_rounds`` rounds
    (k-fold early stopping). Depth-5 trees have at most 32 leaves.

    Fits are independent jobs run side by side. The number of rounds grows by doubling until the
    stopping rule fires (or ``max_iter``), each fold's loss per round comes from
    ``evaluateEachIteration`` on its held-out rows, and the folds are refit to the chosen round
    (same seed, no subsampling: the same first trees). The training rows are written once to the
    shared checkpoint folder, so repeated fits do not recompute their lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    data = df.select(features, label, fold).checkpoint(eager=True)
    sizes = {r[0]: r[1] for r in data.groupBy(fold).count().collect()}  # at most n_folds rows
    if not sizes:
        return []
    total = sum(sizes.values())

    def fit(k: int, rounds: int) -> GBTClassificationModel:
        train = data.where(F.col(fold) != k) if 0 < sizes.get(k, 0) < total else data
        return GBTClassifier(featuresCol=features, labelCol=label, stepSize=step_size, maxDepth=max_depth,
                             maxIter=rounds, seed=seed, checkpointInterval=10).fit(train)

    def fit_all(rounds: int) -> list[GBTClassificationModel]:
        with ThreadPoolExecutor(max_workers=max(1, min(parallelism, n_folds))) as pool:
            # fits inherit the caller's job group / scheduler pool (cancellable together)
            return list(pool.map(inheritable_thread_target(data.sparkSession)(lambda k: fit(k, rounds)), range(n_folds)))

    held = [k for k in range(n_folds) if 0 < sizes.get(k, 0) < total]
    rounds = min(max_iter, 2 * (early_stopping_rounds + 1))      # half of it suffices only if the first round is the best
    while True:
        models = fit_all(rounds)
        if not held:
            return models
        with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(held)))) as pool:
            losses = list(pool.map(inheritable_thread_target(data.sparkSession)(
                lambda k: models[k].evaluateEachIteration(data.where(F.col(fold) == k))), held))
        mean = [sum(fl[r] for fl in losses) / len(losses) for r in range(rounds)]
        best, stopped = best_round(mean, early_stopping_rounds)
        if stopped or rounds >= max_iter:
            break
        rounds = min(2 * rounds, max_iter)
    return models if best == rounds else fit_all(best)


def predict_folds(models: Sequence, rows: DataFrame, key: Sequence[str], features: str = "features",
                  n_classes: int | None = None) -> DataFrame:
    """M4: every fold model applied to the rows in one pass (each model adds its own probability
    column), then unpivoted to a long table (key..., fold, prob of class 1). With ``n_classes``:
    (key..., fold, probs of all classes); a class that a fold never saw has probability 0."""
    scored = rows.select(*key, features)
    for k, m in enumerate(models):
        mk = m.copy()
        mk.setFeaturesCol(features).setPredictionCol(f"_pred{k}").setProbabilityCol(f"_prob{k}")
        mk.setRawPredictionCol(f"_raw{k}")
        scored = mk.transform(scored).drop(f"_pred{k}", f"_raw{k}")

    def values(k: int):
        at = vector_to_array(f"_prob{k}")
        if n_classes is None:
            return F.get(at, 1).alias("prob")
        return F.array(*[F.coalesce(F.get(at, i), F.lit(0.0)) for i in range(n_classes)]).alias("probs")

    probs = F.array(*[F.struct(F.lit(k).alias("fold"), values(k)) for k in range(len(models))])
    return scored.select(*key, F.explode(probs).alias("_fp")).select(*key, "_fp.fold",
                                                                     "_fp.prob" if n_classes is None else "_fp.probs")


def multiclass_train(df: DataFrame, features: str = "features", label: str = "label", num_trees: int = 50,
                     max_depth: int = 5, seed: int = 42):
    """M5: a true multiclass model (random forest over all labels)."""
    return RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=num_trees, maxDepth=max_depth,
                                  seed=seed).fit(df)


def train_cv_multiclass(df: DataFrame, features: str = "features", label: str = "label", fold: str = "fold",
                        n_folds: int = 5, num_trees: int = 50, max_depth: int = 5, seed: int = 42,
                        parallelism: int = 5) -> list:
    """M3 for several classes: one multiclass model (M5) per fold, trained on the other folds. The
    training rows are written once to the shared checkpoint folder; the fits run side by side."""
    ensure_checkpoint_dir(df.sparkSession)
    data = df.select(features, label, fold).checkpoint(eager=True)
    sizes = {r[0]: r[1] for r in data.groupBy(fold).count().collect()}  # at most n_folds rows
    if not sizes:
        return []
    total = sum(sizes.values())

    def fit(k: int):
        train = data.where(F.col(fold) != k) if 0 < sizes.get(k, 0) < total else data
        return multiclass_train(train, features, label, num_trees, max_depth, seed)

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, n_folds))) as pool:
        return list(pool.map(inheritable_thread_target(data.sparkSession)(fit), range(n_folds)))


def model_dir(df: DataFrame, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (``spark.checkpoint.dir``) for saved models."""
    return f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/models/{name}-{uuid.uuid4().hex[:12]}"


def save_models(models: Sequence, path: str) -> list[str]:
    """Each fold model saved to ``path/fold=k`` (overwrite)."""
    paths = []
    for k, m in enumerate(models):
        p = f"{path}/fold={k}"
        m.write().overwrite().save(p)
        paths.append(p)
    return paths


def gain_importance(spark, model_paths: Sequence[str], names: Sequence[str]) -> DataFrame:
    """M6: total split gain per feature per fold, read from the saved trees' node data: a node's gain is
    per row, so it counts times the node's rows."""
    name_arr = F.array(*[F.lit(n) for n in names])
    parts = []
    for k, p in enumerate(model_paths):
        nodes = spark.read.parquet(f"{p}/data").select("nodeData.gain", "nodeData.rawCount", "nodeData.split.featureIndex")
        parts.append(nodes.where(F.col("featureIndex") >= 0)
                     .groupBy("featureIndex").agg(F.sum(F.col("gain") * F.col("rawCount")).alias("gain"))
                     .select(F.lit(k).alias("fold"), F.get(name_arr, F.col("featureIndex")).alias("feature"), "gain"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
