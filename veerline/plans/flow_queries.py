"""The whole flow as the original runs it, on data Spark derives from ``conversations``:
feature build for changers, non-changers and random users (X1 + X2) -> chunk texts to vectors
(V7) -> balanced, leakage-free splits (X3) -> k-fold boosted trees, fold-averaged predictions on
the test split, metrics and importance shares (X4). SQL states the sizes of the splits and what must add
up in the report (model numbers are beyond it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veerline.operators import model as M
from veerline.operators import sampling as S
from veerline.operators import vectors as V
from veerline.plans import docs_queries as DQ
from veerline.plans import experiment as X
from veerline.plans import feature_build as FB
from veerline.plans.registry import ORACLE, register
from veerline.plans.sampling_queries import SQL_SPLITS
from veerline.sources import io
from veerline.sources.tables import read_table

N_FOLDS = 5
RANDOM_KEYWORDS = ["e"]
TRACE_DECODED = [X.DecodedColumn("posts_tokenized", "posts_decoded"), X.DecodedColumn("reposts_tokenized", "reposts_decoded"),
                 X.DecodedColumn("flag_posts_tokenized", "flag_posts_decoded", whole=True)]
COUNTS = ["posts_like", "reposts_like", "posts_repost", "reposts_repost"]


def feature_source(spark: SparkSession, sf: str, name: str, **kw) -> DataFrame:
    rows = DQ.feature_rows(spark, sf, with_text=True, **kw)
    return rows.select(
        F.concat_ws(":", F.lit(name), "account_name", F.col("chunk_id").cast("string")).alias("row_id"),
        "account_name", "label", *COUNTS,
        V.letter_counts("posts_text_random").alias("posts_embedding"),
        V.letter_counts("reposts_text_random").alias("reposts_embedding"),
        "flag_text", "posts_text_sorted", "reposts_text_sorted")


def splits(spark: SparkSession, sf: str) -> DataFrame:
    oc = feature_source(spark, sf, "oc")
    onc = feature_source(spark, sf, "onc", first_label=2, later_label=0, keywords=DQ.KEYWORDS_OTHERS,
                         account_handle=DQ.path_account_handle())
    rnd = feature_source(spark, sf, "rnd", first_label=0, later_label=0, keywords=RANDOM_KEYWORDS)
    accounts = (read_table(spark, sf, "conversations")
                .select(F.concat(F.lit("user_"), F.col("conv_id").cast("string")).alias("account_name")).distinct())
    test_accounts = accounts.where(F.substring(F.md5("account_name"), 1, 1).isin(*"01234567"))
    return S.balanced_dataset(oc, onc, rnd, test_accounts, ["row_id"], "account_name")


def _sql_run() -> str:
    rows = lambda name, sql: (f"{name} as (select concat('{name}:', account_name, ':', cast(chunk_id as varchar)) as doc_id, "  # noqa: E731
                              f"account_name, label, 0 as n_chars from ({sql}))")
    rnd = (f"with {DQ.sql_chunks(RANDOM_KEYWORDS)} select replace(fl.flag_handle, '@', '') as account_name, pairs.chunk_id, 0 as label "
           "from pairs join fl on pairs.conv_id = fl.conv_id")
    return f"""with {rows("oc", ORACLE["timeline_features"])}, {rows("onc", ORACLE["timeline_features_others"])}, {rows("rnd", rnd)},
test_acc as (select account_name from (select distinct concat('user_', cast(conv_id as varchar)) as account_name from conversations)
             where substr(md5(account_name), 1, 1) between '0' and '7'),
{SQL_SPLITS},
per as (select l, (select count(*) from bal where split = 'test' and label = l)::double as n from (select unnest([0, 1]) as l)),
checks as (select 'rows' as section, cast(l as varchar) as name, n as value from per
           union all select 'slices', cast(l as varchar), n from per
           union all select 'folds', 'scored', {N_FOLDS} union all select 'check', 'metrics', 1 union all select 'check', 'importance', 1)
select 'rows' as section, split as name, count(*)::double as value from bal group by split
union all select * from checks where (select count(*) from bal where split <> 'test') > 0"""


@register("end_to_end_run", sql=_sql_run())
def end_to_end_run(spark: SparkSession, sf: str) -> DataFrame:
    """(section, name, value): rows of each split and, when there are rows to train on, the checks of the
    run's report (``X.report_checks``)."""
    result, sizes = flow_run(spark, sf)
    if not result.models:
        return sizes
    return sizes.unionByName(X.report_checks(X.as_report(result), [0, 1], slices=True))


def flow_run(spark: SparkSession, sf: str) -> tuple[X.ExperimentResult, DataFrame]:
    """The run (metrics, appended fold metrics, tp / fp / fn / tn CSVs with the trace columns, importance
    shares) and the rows of each split (section, name, value)."""
    data = S.materialise_sources([splits(spark, sf)])[0]
    sizes = (data.groupBy("split").agg(F.count(F.lit(1)).cast("double").alias("value"))
             .select(F.lit("rows").alias("section"), F.col("split").alias("name"), "value"))
    record, vocabulary = FB.encode_record(data, ["row_id"])
    result = X.run_experiment(record, ["row_id"], COUNTS, [("posts_embedding", 26), ("reposts_embedding", 26)],
                              n_folds=N_FOLDS, model_path=M.model_dir(data, "end_to_end_run"),
                              slices_path=io.scratch_dir(spark, "outcome_slices"),
                              trace_cols=["account_name", "true_label", "flag_text", "posts_text_sorted",
                                          "reposts_text_sorted"],
                              metrics_path=io.scratch_dir(spark, "fold_metrics"), run="end_to_end_run",
                              decoded=TRACE_DECODED, vocabulary=vocabulary)
    return result, sizes
