"""Sampling and data-set queries (T1, T3, W6, J1, J2, U1-U5, P8-P11, A3, X3) on ``labels`` joined
with ``documents``.

Mapping: a feature row = a labelled document; account = 'u' || (doc_id div 4), so an account owns
up to four rows and leakage removal matters. Changers: toxic = 1 (label 1 when quality = 1, else 3);
non-changers: quality = 0 and toxic = 0 (label 2 for long texts, else 0); random users:
quality = 1 and toxic = 0 (label 0). The test account list is every account whose md5 starts with
0, 1 or 2 (about 3/16 of the accounts), read from ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veerline.operators import sampling as S
from veerline.plans.registry import register
from veerline.sources.tables import read_table

SEED = 42
TEST_SEED = 0
HOLDOUT = 23


def _account(doc_id) -> F.Column:
    return F.concat(F.lit("u"), (doc_id / 4).cast("bigint").cast("string"))


def labelled_sources(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = (read_table(spark, sf, "labels")
            .join(read_table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
            .select("doc_id", _account(F.col("doc_id")).alias("account_name"), "quality", "toxic", "n_chars"))
    oc = rows.where(F.col("toxic") == 1).select(
        "doc_id", "account_name", F.when(F.col("quality") == 1, 1).otherwise(3).alias("label"), "n_chars", "quality")
    onc = rows.where((F.col("quality") == 0) & (F.col("toxic") == 0)).select(
        "doc_id", "account_name", F.when(F.col("n_chars") > 1000, 2).otherwise(0).alias("label"), "n_chars", "toxic")
    rnd = rows.where((F.col("quality") == 1) & (F.col("toxic") == 0)).select(
        "doc_id", "account_name", F.lit(0).alias("label"), "n_chars")
    return oc, onc, rnd


def test_accounts(spark: SparkSession, sf: str) -> DataFrame:
    acc = read_table(spark, sf, "documents").select(_account(F.col("doc_id")).alias("account_name")).distinct()
    return acc.where(F.substring(F.md5("account_name"), 1, 1).isin("0", "1", "2"))


def balanced(spark: SparkSession, sf: str) -> DataFrame:
    oc, onc, rnd = labelled_sources(spark, sf)
    return S.balanced_dataset(oc, onc, rnd, test_accounts(spark, sf), ["doc_id"], "account_name",
                              seed=SEED, test_seed=TEST_SEED, train_share=0.8)


def _md5(seed: int) -> str:
    return f"md5(concat_ws('|', cast(doc_id as varchar), '{seed}'))"


SQL_SOURCES = """
rows as (select l.doc_id, concat('u', cast(l.doc_id // 4 as varchar)) as account_name, l.quality, l.toxic, d.n_chars
         from labels l join documents d on l.doc_id = d.doc_id),
oc as (select doc_id, account_name, case when quality = 1 then 1 else 3 end as label, n_chars, quality from rows where toxic = 1),
onc as (select doc_id, account_name, case when n_chars > 1000 then 2 else 0 end as label, n_chars, toxic
        from rows where quality = 0 and toxic = 0),
rnd as (select doc_id, account_name, 0 as label, n_chars from rows where quality = 1 and toxic = 0),
test_acc as (select distinct account_name from (select concat('u', cast(doc_id // 4 as varchar)) as account_name from documents)
             where substr(md5(account_name), 1, 1) in ('0', '1', '2'))
"""

# the splits of any sources oc, onc, rnd (doc_id, account_name, label, n_chars) and test_acc (account_name)
SQL_SPLITS = f"""
oc2 as (select doc_id, account_name, label, label as true_label, n_chars from oc),
onc2 as (select doc_id, account_name, 0 as label, label as true_label, n_chars from onc),
rnd2 as (select doc_id, account_name, label, label as true_label, n_chars from rnd),
tpos as (select * from oc2 where label = 1 and account_name in (select account_name from test_acc)),
nn as (select count(*) // 2 as h from tpos),
tonc as (select doc_id, account_name, label, true_label, n_chars from
         (select *, row_number() over (order by {_md5(TEST_SEED)}, doc_id) as r from onc2
          where account_name in (select account_name from test_acc)) where r <= (select h from nn)),
trnd as (select doc_id, account_name, label, true_label, n_chars from
         (select *, row_number() over (order by {_md5(TEST_SEED)}, doc_id) as r from rnd2) where r <= (select h from nn)),
test as (select * from tpos union all select * from tonc union all select * from trnd),
tacc as (select distinct account_name from test),
pos as (select * from oc2 where label = 1 and account_name not in (select account_name from tacc)),
mm as (select count(*) as m from pos),
nonc as (select doc_id, account_name, label, true_label, n_chars from
         (select *, row_number() over (order by {_md5(TEST_SEED)}, doc_id) as r from onc2
          where account_name not in (select account_name from tacc)) where r <= (select m // 2 from mm)),
nrnd as (select doc_id, account_name, label, true_label, n_chars from
         (select *, row_number() over (order by {_md5(TEST_SEED)}, doc_id) as r from rnd2
          where account_name not in (select account_name from tacc)) where r <= (select m // 2 from mm)),
neg as (select * from nonc union all select * from nrnd),
kk as (select cast(floor(m * 0.8) as bigint) as k from mm),
posr as (select *, row_number() over (order by {_md5(SEED)}, doc_id) as r from pos),
negr as (select *, row_number() over (order by {_md5(TEST_SEED)}, doc_id) as r from neg),
bal as (select doc_id, account_name, label, true_label, n_chars, 'test' as split from test
        union all select doc_id, account_name, label, true_label, n_chars,
                         case when r <= (select k from kk) then 'train' else 'valid' end from posr
        union all select doc_id, account_name, label, true_label, n_chars,
                         case when r <= (select k from kk) then 'train' else 'valid' end from negr)
"""

SQL_BALANCED = f"{SQL_SOURCES},{SQL_SPLITS}"


@register("balanced_dataset", sql=f"with {SQL_BALANCED} select * from bal")
def balanced_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Test, train and valid rows with ``split``; no account in both test and the rest."""
    return balanced(spark, sf).select("doc_id", "account_name", "label", "true_label", "n_chars", "split")


@register("split_train_valid", sql=f"with {SQL_BALANCED} select doc_id, label, split from bal where split <> 'test'")
def split_train_valid(spark: SparkSession, sf: str) -> DataFrame:
    """First int(0.8 m) of each class (shuffle order) train, the rest valid."""
    return balanced(spark, sf).where(F.col("split") != "test").select("doc_id", "label", "split")


@register("class_counts", sql=f"with {SQL_BALANCED} select split, label, count(*) as n from bal group by split, label")
def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return S.class_counts(balanced(spark, sf))


@register("select_drop_columns", sql=f"with {SQL_BALANCED} select doc_id, n_chars from bal")
def select_drop_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Feature matrix columns: drop label columns, then the account name if present."""
    x = balanced(spark, sf).drop("label", "true_label", "split", "posts_tokenized", "reposts_tokenized")
    return S.drop_if_present(x, "account_name")


@register("seeded_shuffle", sql=f"select doc_id, row_number() over (order by {_md5(SEED)}, doc_id) as rank from labels")
def seeded_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    """Position of each row in the seeded shuffle."""
    return S.shuffled_rank(read_table(spark, sf, "labels").select("doc_id"), ["doc_id"], SEED)


@register("global_rank", sql=f"select doc_id, row_number() over (order by {_md5(7)}, doc_id) as rank from documents")
def global_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Exact global rank in md5 order with bucketed counts (no single-task window)."""
    return S.shuffled_rank(read_table(spark, sf, "documents").select("doc_id"), ["doc_id"], 7)


@register("downsample_head", sql=f"""with {SQL_SOURCES}
select doc_id from (select doc_id, row_number() over (order by {_md5(TEST_SEED)}, doc_id) as r from rnd)
where r <= (select count(*) // 2 from oc where label = 1)""")
def downsample_head(spark: SparkSession, sf: str) -> DataFrame:
    """The first n//2 shuffled random-user rows, n = number of label-1 changer rows."""
    oc, _, rnd = labelled_sources(spark, sf)
    n = oc.where(F.col("label") == 1).count()
    return S.head_after_shuffle(rnd, ["doc_id"], TEST_SEED, n // 2).select("doc_id")


@register("semi_join_accounts", sql=f"""with {SQL_SOURCES}
select doc_id, account_name, label from oc where account_name in (select account_name from test_acc)""")
def semi_join_accounts(spark: SparkSession, sf: str) -> DataFrame:
    oc, _, _ = labelled_sources(spark, sf)
    return S.semi_join_accounts(oc, test_accounts(spark, sf)).select("doc_id", "account_name", "label")


@register("anti_join_accounts", sql=f"""with {SQL_SOURCES}
select doc_id, account_name, label from (select doc_id, account_name, label from onc union all
                                         select doc_id, account_name, label from rnd)
where account_name not in (select account_name from test_acc)""")
def anti_join_accounts(spark: SparkSession, sf: str) -> DataFrame:
    _, onc, rnd = labelled_sources(spark, sf)
    both = S.union_common_columns([onc, rnd])
    return S.anti_join_accounts(both, test_accounts(spark, sf)).select("doc_id", "account_name", "label")


@register("union_common_columns", sql=f"""with {SQL_SOURCES}
select doc_id, account_name, label, n_chars from oc union all select doc_id, account_name, label, n_chars from onc
union all select doc_id, account_name, label, n_chars from rnd""")
def union_common_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns in every source only (quality and toxic fall away)."""
    return S.union_common_columns(list(labelled_sources(spark, sf)))


@register("union_all", sql=f"""with {SQL_SOURCES}
select account_name from oc where account_name in (select account_name from test_acc)
union all select account_name from onc where account_name in (select account_name from test_acc)""")
def union_all(spark: SparkSession, sf: str) -> DataFrame:
    """Two account lists concatenated (duplicates kept)."""
    oc, onc, _ = labelled_sources(spark, sf)
    acc = test_accounts(spark, sf)
    return S.union_all([S.semi_join_accounts(oc, acc).select("account_name"),
                        S.semi_join_accounts(onc, acc).select("account_name")])


@register("holdout_extra_negatives", sql=f"""with {SQL_SOURCES}
select doc_id, 0 as label, case when r <= {HOLDOUT} then 'holdout' else 'rest' end as part
from (select doc_id, row_number() over (order by {_md5(TEST_SEED)}, doc_id) as r from oc where label = 3)""")
def holdout_extra_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """U4: label-3 changer rows, shuffled, relabelled 0; the first 23 held out."""
    oc, _, _ = labelled_sources(spark, sf)
    ranked = S.shuffled_rank(oc.where(F.col("label") == 3), ["doc_id"], TEST_SEED, "r")
    return ranked.select("doc_id", F.lit(0).alias("label"),
                         F.when(F.col("r") <= HOLDOUT, "holdout").otherwise("rest").alias("part"))


@register("relabel_classes", sql=f"with {SQL_SOURCES} select doc_id, 0 as label, label as true_label from onc")
def relabel_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Non-changers keep their label as true_label and get label 0."""
    _, onc, _ = labelled_sources(spark, sf)
    return S.relabel(onc, constant=0).select("doc_id", "label", "true_label")


@register("filter_label", sql=f"""with {SQL_SOURCES}
select doc_id, account_name, label from oc where label = 1""")
def filter_label(spark: SparkSession, sf: str) -> DataFrame:
    oc, _, _ = labelled_sources(spark, sf)
    return oc.where(F.col("label") == 1).select("doc_id", "account_name", "label")


@register("unwrap_first", sql="""
select conv_id, turn, len([string_split(text, ' ')][1])::int as n_words, [string_split(text, ' ')][1][1] as first_word
from conversations""")
def unwrap_first(spark: SparkSession, sf: str) -> DataFrame:
    """P10: the first element of a nested list ([[words]] -> [words])."""
    c = read_table(spark, sf, "conversations")
    nested = F.array(F.split("text", " "))
    inner = S.unwrap_first(nested)
    return c.select("conv_id", "turn", F.size(inner).alias("n_words"), S.unwrap_first(inner).alias("first_word"))
