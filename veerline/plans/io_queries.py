"""Source / sink round trips (S1, S3-S8): each query writes data derived from the fixture tables
to a fresh folder under the shared checkpoint folder and returns what reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veerline.operators import evaluate as E
from veerline.operators import sampling
from veerline.plans import docs_queries, eval_queries, sampling_queries
from veerline.plans.registry import ORACLE, register
from veerline.sources import bucketed, io
from veerline.sources.tables import read_table


@register("read_timelines", sql="""
select conv_id as account, turn, role, text, (row_number() over (partition by conv_id order by turn) - 1)::int as seq
from conversations""")
def read_timelines(spark: SparkSession, sf: str) -> DataFrame:
    """Per-account CSV files (texts with newlines and quotes) read back; file order = seq."""
    path = io.scratch_dir(spark, "timelines")
    io.write_timelines(read_table(spark, sf, "conversations"), path, "conv_id", "turn")
    df = io.read_timelines(spark, path, "turn bigint, role string, text string", account_col="conv_id")
    w = Window.partitionBy("account").orderBy("pos")
    return df.select(F.col("account").cast("bigint").alias("account"), "turn", "role", "text",
                     (F.row_number().over(w) - 1).alias("seq"))


_X1_SCHEMA = ("account_name string, chunk_id int, posts_like bigint, reposts_like bigint, posts_repost bigint, "
              "reposts_repost bigint, label int")


@register("read_feature_json", sql=ORACLE["timeline_features"])
def read_feature_json(spark: SparkSession, sf: str) -> DataFrame:
    """S5 + S3: feature rows exported as JSON and read back with an explicit schema."""
    path = io.scratch_dir(spark, "features")
    io.write_features(docs_queries.timeline_features(spark, sf), path, fmt="json")
    return io.read_feature_json(spark, path, _X1_SCHEMA)


@register("read_account_list", sql=f"""with {sampling_queries.SQL_SOURCES}
select account_name from oc where account_name in (select account_name from test_acc)
union all select account_name from onc where account_name in (select account_name from test_acc)""")
def read_account_list(spark: SparkSession, sf: str) -> DataFrame:
    """Two account-list CSVs read as one list."""
    oc, onc, _ = sampling_queries.labelled_sources(spark, sf)
    acc = sampling_queries.test_accounts(spark, sf)
    paths = []
    for name, src in (("oc_accounts", oc), ("onc_accounts", onc)):
        p = io.scratch_dir(spark, name)
        src.join(acc, "account_name", "left_semi").select("account_name").write.options(**io.CSV_OPTIONS).csv(p)
        paths.append(p)
    return io.read_account_list(spark, paths)


def long_fold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    p = eval_queries.fold_predictions(spark, sf).withColumn("pred", E.threshold_prediction("prob"))
    return E.fold_metrics(p).select("fold", F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(name).alias("value"))
        for name in ("accuracy", "precision", "recall", "f1")])).alias("m")
    ).select("fold", "m.metric", "m.value")


@register("append_fold_metrics", sql="""
with fp as (select vec_id, case when label < 5 then 1 else 0 end as label, f.fold, ((vec_id * 7 + f.fold) % 11) / 10.0 as prob
            from embeddings, (select unnest(range(5)) as fold) f),
p as (select fold, label, cast(round_even(prob, 0) as int) as pred from fp),
m as (select fold, round(count_if(label = pred) / count(*), 6) as accuracy,
             round(case when count_if(pred = 1) = 0 then 0.0 else count_if(label = 1 and pred = 1) / count_if(pred = 1) end, 6) as precision,
             round(case when count_if(label = 1) = 0 then 0.0 else count_if(label = 1 and pred = 1) / count_if(label = 1) end, 6) as recall,
             round(case when count_if(label = 1) + count_if(pred = 1) = 0 then 0.0
                        else 2 * count_if(label = 1 and pred = 1) / (count_if(label = 1) + count_if(pred = 1)) end, 6) as f1
      from p group by fold),
l as (select fold, 'accuracy' as metric, accuracy as value from m union all select fold, 'precision', precision from m
      union all select fold, 'recall', recall from m union all select fold, 'f1', f1 from m),
runs as (select unnest(['r1', 'r2']) as run)
select run, metric, max(case when fold = 0 then value end) as "0", max(case when fold = 1 then value end) as "1",
       max(case when fold = 2 then value end) as "2", max(case when fold = 3 then value end) as "3",
       max(case when fold = 4 then value end) as "4"
from l, runs group by run, metric""")
def append_fold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Per-fold accuracy, precision, recall and F1 appended by two runs, read back in wide form
    (one row per run and metric, one column per fold)."""
    long = long_fold_metrics(spark, sf)
    path = io.scratch_dir(spark, "fold_metrics")
    for run in ("r1", "r2"):
        io.append_fold_metrics(long, path, run)
    return io.read_fold_metrics(spark, path, 5)


@register("write_outcome_slices", sql=f"""with {eval_queries._SQL_PRED}
select case when label = 1 and pred = 1 then 'tp' when label = 0 and pred = 1 then 'fp'
            when label = 1 and pred = 0 then 'fn' else 'tn' end as outcome, count(*) as n, sum(vec_id)::bigint as id_sum
from pr group by 1""")
def write_outcome_slices(spark: SparkSession, sf: str) -> DataFrame:
    """One CSV folder per confusion cell, read back and counted."""
    df = eval_queries.averaged(spark, sf).withColumn("outcome", E.outcome_binary("label", "pred"))
    path = io.scratch_dir(spark, "slices")
    io.write_outcome_slices(df, path, ["vec_id", "label", "pred"])
    back = spark.read.options(**io.CSV_OPTIONS).schema("vec_id bigint, label int, pred int, outcome string").csv(path)
    return back.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("id_sum"))


@register("write_importance", sql=ORACLE["importance_mean_ratio"])
def write_importance(spark: SparkSession, sf: str) -> DataFrame:
    """The importance table written as CSV with a header and read back."""
    imp = E.importance_mean_ratio(eval_queries.feature_gains(spark, sf), eval_queries.N_FOLDS).drop("rank")
    path = io.scratch_dir(spark, "importance")
    io.write_importance(imp, path)
    return (spark.read.options(**io.CSV_OPTIONS)
            .schema("feature string, importance double, importance_ratio double").csv(path))


@register("write_features", sql=ORACLE["timeline_features"])
def write_features(spark: SparkSession, sf: str) -> DataFrame:
    """Feature rows written as Parquet between stages (the format stages exchange) and read back."""
    path = io.scratch_dir(spark, "features_parquet")
    io.write_features(docs_queries.timeline_features(spark, sf), path, fmt="parquet")
    return spark.read.parquet(path)


@register("repeat_run_metrics", sql="select * from (" + ORACLE["append_fold_metrics"] + ") where true")
def repeat_run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """S6, run again: two runs, the first of them written three times (once with other values and folds); each
    has one row per fold and metric."""
    long, path = long_fold_metrics(spark, sf), io.scratch_dir(spark, "runs")
    io.replace_run(long.withColumn("fold", F.col("fold") + 3).withColumn("value", -F.col("value")), path, "r1")
    for run in ("r1", "r2", "r1"):
        io.replace_run(long, path, run)
    wide = spark.read.schema("fold int, metric string, value double, run string").parquet(path)
    return wide.groupBy("run", "metric").pivot("fold", list(range(5))).agg(F.sum("value"))


@register("repeat_run_slices", sql=f"""with {eval_queries._SQL_PRED}
select run, case when label = 1 and pred = 1 then 'tp' when label = 0 and pred = 1 then 'fp'
            when label = 1 and pred = 0 then 'fn' else 'tn' end as outcome, count(*) as n, sum(vec_id)::bigint as id_sum
from pr, (select unnest(['r1', 'r2']) as run) group by all""")
def repeat_run_slices(spark: SparkSession, sf: str) -> DataFrame:
    """S7, run again: the slices of two runs; the first run's earlier attempt, all in one cell, leaves nothing behind."""
    df = eval_queries.averaged(spark, sf).withColumn("outcome", E.outcome_binary("label", "pred")).select("vec_id", "label", "pred", "outcome")
    path = io.scratch_dir(spark, "run_slices")
    io.replace_run(df.withColumn("outcome", F.lit("old")), path, "r1")
    for run in ("r1", "r2", "r1"):
        io.replace_run(df, path, run)
    back = spark.read.schema("vec_id bigint, label int, pred int, outcome string, run string").parquet(path)
    return back.groupBy("run", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("id_sum"))


_IDS = ("posts_tokenized", "reposts_tokenized", "flag_posts_tokenized")


def _record_trip(spark: SparkSession, sf: str, fmt: str) -> DataFrame:
    """The whole record, its ids nested and the flagged post's ids null where its label is 3, written and read back."""
    record = docs_queries.feature_record(spark, sf)
    record = record.withColumn("flag_posts_tokenized", F.when(F.col("label") != 3, F.col("flag_posts_tokenized")))
    nested = io.nest_ids(record, *_IDS)
    path = io.scratch_dir(spark, f"records_{fmt}")
    io.write_features(nested, path, fmt=fmt)
    back = io.read_feature_json(spark, path, nested.schema) if fmt == "json" else spark.read.parquet(path)
    return back.withColumns({c: sampling.unwrap_first(c) for c in _IDS}).select(record.columns)


_SQL_RECORD = "select * replace (case when label <> 3 then flag_posts_tokenized end as flag_posts_tokenized) from (" + ORACLE["feature_record"] + ")"


@register("read_record_json", sql=_SQL_RECORD)
def read_record_json(spark: SparkSession, sf: str) -> DataFrame:
    """S5 + S3, P10: whole records (texts, nested and nullable ids, both vectors) as JSON lines and back."""
    return _record_trip(spark, sf, "json")


@register("write_record_parquet", sql=_SQL_RECORD)
def write_record_parquet(spark: SparkSession, sf: str) -> DataFrame:
    """The same through Parquet, the format between stages."""
    return _record_trip(spark, sf, "parquet")


@register("bucketed_hand_off", sql=f"""with {sampling_queries.SQL_SOURCES}
select account_name, count(*) as n, sum(n_chars)::bigint as chars, min(doc_id) as first_doc
from (select doc_id, account_name, n_chars from onc union all select doc_id, account_name, n_chars from rnd)
where account_name not in (select account_name from test_acc) group by account_name""")
def bucketed_hand_off(spark: SparkSession, sf: str) -> DataFrame:
    """Features stored by account; the anti join and the sums by account read them without an exchange."""
    _, onc, rnd = sampling_queries.labelled_sources(spark, sf)
    both = sampling.union_common_columns([onc, rnd])
    name = f"hand_off_{uuid.uuid4().hex[:12]}"
    stored = bucketed.write_bucketed(both.select("doc_id", "account_name", "n_chars"), name, ["account_name"])
    rest = sampling.anti_join_accounts(bucketed.read_bucketed(spark, stored), sampling_queries.test_accounts(spark, sf))
    return rest.groupBy("account_name").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first_doc"))
