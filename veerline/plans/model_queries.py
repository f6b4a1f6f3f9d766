"""Model queries on ``embeddings``.

Mapping: binary label = label < 5; the 64 components are the features (named posts_embedding_1..32
and reposts_embedding_1..32); stratified folds 0-4 (seeded) are the cross-validation folds and an
extra sixth fold is the test set. Training is a Spark ML job whose numbers SQL cannot state, so the
trained queries return what SQL can: the test rows with a flag that each value is sound, and sums
that must add up to the sizes of the test split. A flag is false (never null) when a value is missing."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veerline.operators import boosting as B
from veerline.operators import evaluate as E
from veerline.operators import model as M
from veerline.plans import experiment as X
from veerline.plans.registry import register
from veerline.sources import io
from veerline.sources.tables import read_table

N_FOLDS = 5
NAMES = M.feature_names([], [("posts_embedding", 32), ("reposts_embedding", 32)])


def _sql_test(label: str) -> str:
    """The test rows (the sixth of six folds stratified by ``label``) with all label columns."""
    return f"""folds as (
  select *, (row_number() over (partition by {label} order by md5(concat_ws('|', cast(vec_id as varchar), '42')), vec_id) - 1) % 6 as f
  from (select vec_id, case when label < 5 then 1 else 0 end as label2, label % 3 as label3 from embeddings)),
test as (select * from folds where f = 5)"""


_SQL_TEST = _sql_test("label2")


def sound(condition: Column) -> Column:
    """A flag that is false, not null, when a value is missing."""
    return F.coalesce(condition, F.lit(False))


def labelled_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "embeddings").select(
        "vec_id", (F.col("label") < 5).cast("int").alias("label"), (F.col("label") % 3).alias("label3"),
        F.slice("embedding", 1, 32).alias("posts_embedding"), F.slice("embedding", 33, 32).alias("reposts_embedding"))
    e = M.assemble_features(e, [], ["posts_embedding", "reposts_embedding"])
    return M.stratified_folds(e, ["vec_id"], "label", N_FOLDS + 1, seed=42)


def cv_and_test(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = labelled_vectors(spark, sf)
    return rows.where(F.col("fold") < N_FOLDS), rows.where(F.col("fold") == N_FOLDS)


def trained(spark: SparkSession, sf: str):
    cv, test = cv_and_test(spark, sf)
    return M.train_cv_gbt(cv, n_folds=N_FOLDS), test


@register("assemble_features", sql="""
select vec_id, 66 as n_features, list_concat([label::double, vec_id::double], embedding::double[]) as features from embeddings""")
def assemble_features(spark: SparkSession, sf: str) -> DataFrame:
    """M1: two scalar columns and two array columns as one vector; all its values."""
    e = read_table(spark, sf, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    arr = vector_to_array("features")
    return M.assemble_features(e, ["label", "vec_id"], ["a", "b"]).select("vec_id", F.size(arr).alias("n_features"), arr.alias("features"))


@register("stratified_group_folds", sql="""
with rows as (select vec_id, 'u' || (vec_id * vec_id % 97)::varchar as account, (vec_id * vec_id % 97 % 3)::int as label from embeddings),
per as (select account, label, count(*) as n from rows group by account, label),
grp as (select account, max(label) as label, sum(n) as n from per group by account),
dealt as (select account, (row_number() over (partition by label order by n desc,
                 md5(concat_ws('|', account, '42')), account) - 1) % 5 as fold from grp)
select r.vec_id, r.account, r.label, d.fold::int as fold from rows r join dealt d using (account)""")
def stratified_group_folds(spark: SparkSession, sf: str) -> DataFrame:
    """M2 by account, balanced in rows: accounts of unequal size, each of one of three labels."""
    no = F.col("vec_id") * F.col("vec_id") % 97
    rows = read_table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("u"), no.cast("string")).alias("account"), (no % 3).cast("int").alias("label"))
    return M.stratified_group_folds(rows, "account").select("vec_id", "account", "label", "fold")


@register("train_cv_gbt", sql="select unnest(range(5))::int as fold, true as has_trees")
def train_cv_gbt(spark: SparkSession, sf: str) -> DataFrame:
    """M3: five boosted-tree fits cut at the fold-mean early-stopping round; every fold's model has trees."""
    models, _ = trained(spark, sf)
    return spark.createDataFrame([(k, m.getNumTrees >= 1) for k, m in enumerate(models)], "fold int, has_trees boolean")


@register("predict_folds", sql=f"""with {_SQL_TEST}
select vec_id, fold::int as fold, true as in_range from test, (select unnest(range(5)) as fold)""")
def predict_folds(spark: SparkSession, sf: str) -> DataFrame:
    """M4: every fold model on every test row; the probability lies in 0 to 1."""
    models, test = trained(spark, sf)
    return M.predict_folds(models, test, ["vec_id"]).select("vec_id", "fold", sound(F.col("prob").between(0, 1)).alias("in_range"))


@register("multiclass_train", sql=f"with {_SQL_TEST} select vec_id, label3 as label, true as known_label from test")
def multiclass_train(spark: SparkSession, sf: str) -> DataFrame:
    """M5: softmax boosting of three classes (label % 3) on the CV rows: the class probabilities of each test row,
    averaged over the folds, add up to 1 and give one of the labels."""
    cv, test = cv_and_test(spark, sf)
    probs = E.fold_average_classes(softmax_model(cv).predict(test, ["vec_id", "label3"]), ["vec_id", "label3"], 3)
    one = F.abs(F.aggregate("probs_avg", F.lit(0.0), lambda a, x: a + x) - 1) < 1e-5
    return probs.select("vec_id", F.col("label3").alias("label"),
                        sound(one & E.argmax_prediction("probs_avg").isin(0, 1, 2)).alias("known_label"))


def softmax_model(cv: DataFrame) -> B.BoostedModel:
    return B.start_boosting(cv, ["vec_id"], label="label3", n_folds=N_FOLDS, params=B.BoostParams(classes=3)).run().model()


def importance_agreement(gains: DataFrame, expected: DataFrame) -> DataFrame:
    """(fold, feature, agrees): the feature's share of its fold's total gain equals ``expected`` (fold, feature, share)."""
    total = F.sum("gain").over(Window.partitionBy("fold"))
    shares = expected.join(gains, ["fold", "feature"], "left").withColumn("got", F.coalesce("gain", F.lit(0.0)) / F.nullif(total, F.lit(0.0)))
    return shares.select("fold", "feature", sound(F.abs(F.col("got") - F.col("share")) < 1e-6).alias("agrees"))


@register("gain_importance", sql="select f.fold::int as fold, n.feature, true as agrees from (select unnest(range(5)) as fold) f, (select unnest(["
          + ", ".join(f"'{n}'" for n in NAMES) + "]) as feature) n")
def gain_importance(spark: SparkSession, sf: str) -> DataFrame:
    """M6 (+ S9): fold models saved, total gain per feature read back from the saved trees; its shares are
    Spark's ``featureImportances`` (folds x features numbers of the models, from the driver)."""
    models, _ = trained(spark, sf)
    paths = M.save_models(models, M.model_dir(read_table(spark, sf, "embeddings"), "gain_importance"))
    expected = [(k, n, float(x)) for k, m in enumerate(models) for n, x in zip(NAMES, m.featureImportances.toArray(), strict=True)]
    return importance_agreement(M.gain_importance(spark, paths, NAMES),
                                spark.createDataFrame(expected, "fold int, feature string, share double"))


@register("save_model", sql=f"""with {_SQL_TEST}
select fold::int as fold, true as has_trees, count(*) as n_rows, count(*) as n_equal
from test, (select unnest(range(5)) as fold) group by fold""")
def save_model(spark: SparkSession, sf: str) -> DataFrame:
    """The fold ensemble written one model per fold and loaded again: the saved trees, and the test rows
    on which the loaded model gives the same probability."""
    models, test = trained(spark, sf)
    paths = M.save_models(models, M.model_dir(read_table(spark, sf, "embeddings"), "save_model"))
    loaded = [GBTClassificationModel.load(p) for p in paths]
    before = M.predict_folds(models, test, ["vec_id"])
    after = M.predict_folds(loaded, test, ["vec_id"]).withColumnRenamed("prob", "again")
    trees = spark.createDataFrame([(k, m.getNumTrees >= 1) for k, m in enumerate(loaded)], "fold int, has_trees boolean")
    rows = before.join(after, ["vec_id", "fold"], "left").groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("prob") == F.col("again")).alias("n_equal"))
    return rows.join(trees, "fold").select("fold", "has_trees", "n_rows", "n_equal")


@register("train_and_evaluate", sql=f"""with {_SQL_TEST}
select 'rows' as section, cast(label2 as varchar) as name, count(*)::double as value from test group by label2
union all select 'folds', 'scored', 5 union all select 'check', 'metrics', 1 union all select 'check', 'importance', 1""")
def train_and_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    """M1 -> M2 -> M3 -> M4 -> A8 -> P13 -> M7 (+ S9 -> M6 -> A9 / A10), checked (``X.report_checks``)."""
    return X.report_checks(two_class_report(spark, sf), [0, 1])


def two_class_report(spark: SparkSession, sf: str) -> DataFrame:
    """The run's long result table (section, name, value)."""
    e = read_table(spark, sf, "embeddings").select(
        "vec_id", (F.col("label") < 5).cast("int").alias("label"),
        F.slice("embedding", 1, 32).alias("posts_embedding"), F.slice("embedding", 33, 32).alias("reposts_embedding"))
    ranked = M.stratified_folds(e, ["vec_id"], "label", N_FOLDS + 1, seed=42)
    data = ranked.withColumn("split", F.when(F.col("fold") == N_FOLDS, "test").otherwise("train")).drop("fold")
    result = X.run_experiment(data, ["vec_id"], [], [("posts_embedding", 32), ("reposts_embedding", 32)],
                              n_folds=N_FOLDS, model_path=M.model_dir(e, "train_and_evaluate"), trainer="leafwise")
    return X.as_report(result)


@register("train_and_evaluate_three", sql=f"""with {_sql_test("label3")}
select 'rows' as section, cast(label3 as varchar) as name, count(*)::double as value from test group by label3
union all select 'slices', cast(label3 as varchar), count(*)::double from test group by label3
union all select 'folds', 'scored', 5 union all select 'check', 'metrics', 1 union all select 'check', 'importance', 1""")
def train_and_evaluate_three(spark: SparkSession, sf: str) -> DataFrame:
    """X4 in three-class mode (label % 3): fold models, averaged class probabilities, first maximum,
    macro metrics, 3x3 confusion matrix, t<k> / f<k> slices, importance shares, checked (``X.report_checks``)."""
    return X.report_checks(three_class_report(spark, sf), [0, 1, 2], mode="three", slices=True)


def three_class_report(spark: SparkSession, sf: str) -> DataFrame:
    """The run's long result table (section, name, value)."""
    e = read_table(spark, sf, "embeddings").select(
        "vec_id", (F.col("label") % 3).cast("int").alias("label"),
        F.slice("embedding", 1, 32).alias("posts_embedding"), F.slice("embedding", 33, 32).alias("reposts_embedding"))
    ranked = M.stratified_folds(e, ["vec_id"], "label", N_FOLDS + 1, seed=42)
    data = ranked.withColumn("split", F.when(F.col("fold") == N_FOLDS, "test").otherwise("train")).drop("fold")
    result = X.run_experiment(data, ["vec_id"], [], [("posts_embedding", 32), ("reposts_embedding", 32)],
                              n_folds=N_FOLDS, model_path=M.model_dir(e, "train_and_evaluate_three"),
                              slices_path=io.scratch_dir(spark, "outcome_slices_three"), trace_cols=["vec_id"],
                              mode="three", trainer="leafwise")
    return X.as_report(result)


@register("multiclass_evaluate", sql=f"""with {_SQL_TEST}
select 'rows' as section, cast(label3 as varchar) as name, count(*)::double as value from test group by label3
union all select 'check', 'metrics', 1""")
def multiclass_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    """Three-class run (M5 -> P14 -> A4 -> A7): class scores from the multiclass model, first-max
    label, 3x3 confusion matrix with zero cells kept, balanced accuracy and macro P / R / F1; checked."""
    cv, test = cv_and_test(spark, sf)
    model = softmax_model(cv)
    scored = E.fold_average_classes(model.predict(test, ["vec_id", "label3"]), ["vec_id", "label3"], 3).select(
        F.col("label3").alias("label"), E.argmax_prediction("probs_avg").alias("pred"))
    result = X.ExperimentResult([model], scored, E.evaluate_run(scored, "three"), None, None,
                                confusion=E.confusion_matrix(scored, [0, 1, 2]))
    return X.report_checks(X.as_report(result), [0, 1, 2], mode="three").where(F.col("section").isin("rows", "check")
                                                                              & (F.col("name") != "importance"))
