"""Vector and evaluation queries on ``embeddings``.

Mapping: row = vector; binary label = label < 5; three-class label = label % 3; query vector of
a group (label) = the group's vector with the smallest vec_id (equi-join on the group key);
fold predictions are deterministic pseudo-probabilities ((vec_id * 7 + fold) % 11) / 10, which
include exact 0.5 ties; three-class scores = the first three embedding components. Feature gains
per fold come from the embedding positions: |x_i| summed per (vec_id % 5, feature of position i)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veerline.operators import evaluate as E
from veerline.operators import sampling as S
from veerline.operators import vectors as V
from veerline.plans.registry import register
from veerline.sources.tables import read_table

N_FOLDS = 5
DIM = 64
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def emb(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings")


def with_query_vector(spark: SparkSession, sf: str) -> DataFrame:
    e = emb(spark, sf)
    # the smallest id is a hash aggregate over two columns; the vectors of those ids come by a join
    first = e.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    q = e.select("vec_id", F.col("embedding").alias("qvec")).join(first, "vec_id").select("label", "qvec")
    return e.join(q, "label")


def fold_predictions(spark: SparkSession, sf: str) -> DataFrame:
    e = emb(spark, sf).select("vec_id", (F.col("label") < 5).cast("int").alias("label"))
    folds = e.select("vec_id", "label", F.explode(F.sequence(F.lit(0), F.lit(N_FOLDS - 1))).alias("fold"))
    return folds.withColumn("prob", ((F.col("vec_id") * 7 + F.col("fold")) % 11) / 10.0)


def averaged(spark: SparkSession, sf: str) -> DataFrame:
    p = fold_predictions(spark, sf)
    avg = E.fold_average(p, ["vec_id", "label"])
    return avg.withColumn("pred", E.threshold_prediction("prob_avg"))


def three_class(spark: SparkSession, sf: str) -> DataFrame:
    """The first maximum of the whole score array, as one of three classes (position mod 3)."""
    best = E.argmax_prediction(F.col("embedding").cast("array<double>"))
    return emb(spark, sf).select("vec_id", (F.col("label") % 3).alias("label"), (best % 3).alias("pred"))


def feature_gains(spark: SparkSession, sf: str) -> DataFrame:
    e = emb(spark, sf).select("vec_id", F.posexplode("embedding").alias("i", "x"))
    tail_names = F.array(*[F.lit(n) for n in ("posts_like", "reposts_like", "posts_repost", "reposts_repost")])
    feature = (F.when(F.col("i") < 30, F.concat(F.lit("posts_embedding_"), (F.col("i") + 1).cast("string")))
               .when(F.col("i") < 60, F.concat(F.lit("reposts_embedding_"), (F.col("i") - 29).cast("string")))
               .otherwise(F.get(tail_names, F.col("i") - 60)))
    return (e.select((F.col("vec_id") % N_FOLDS).alias("fold"), feature.alias("feature"),
                     F.abs(F.col("x").cast("double")).alias("gain"))
            .groupBy("fold", "feature").agg(F.sum("gain").alias("gain")))


_SQL_Q = """
q as (select label, arg_min(embedding, vec_id) as qvec from embeddings group by label),
eq as (select e.vec_id, e.label, e.embedding::double[] as a, q.qvec::double[] as b from embeddings e join q on e.label = q.label),
dist as (select vec_id, label, round(1 - list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) + 0.0 as distance from eq)
"""
_SQL_PRED = """
fp as (select vec_id, case when label < 5 then 1 else 0 end as label, f.fold, ((vec_id * 7 + f.fold) % 11) / 10.0 as prob
       from embeddings, (select unnest(range(5)) as fold) f),
av as (select vec_id, label, round(avg(prob), 6) as prob_avg from fp group by vec_id, label),
pr as (select vec_id, label, prob_avg, cast(round_even(prob_avg, 0) as int) as pred from av),
t64 as (select vec_id, label, list_position(embedding::double[], list_max(embedding::double[])) - 1 as pred from embeddings),
t3 as (select vec_id, label % 3 as label, pred % 3 as pred from t64)
"""


@register("cosine_distance", sql=f"with {_SQL_Q} select vec_id, distance from dist")
def cosine_distance(spark: SparkSession, sf: str) -> DataFrame:
    """V6: distance of each vector to its group's query vector."""
    e = with_query_vector(spark, sf)
    return e.select("vec_id", F.round(V.cosine_distance("embedding", "qvec"), 6).alias("distance"))


@register("rank_by_similarity", sql=f"""with {_SQL_Q}
select vec_id, label, distance, (row_number() over (partition by label order by distance, vec_id))::int as sim_rank from dist""")
def rank_by_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """T4: vectors of each group re-ordered by distance to the group's query vector."""
    ranked = V.rank_by_similarity(with_query_vector(spark, sf), "embedding", "qvec", ["label"], "vec_id", digits=6)
    return ranked.select("vec_id", "label", "distance", "sim_rank")


@register("embedding_to_columns", sql="select vec_id, " + ", ".join(
    f"embedding[{i + 1}]::double as e_{i + 1}" for i in range(DIM)) + " from embeddings")
def embedding_to_columns(spark: SparkSession, sf: str) -> DataFrame:
    return emb(spark, sf).select("vec_id", *V.embedding_to_columns("embedding", "e", DIM))


N_COMPONENTS = 4


def component_checks(reduced: DataFrame, k: int = N_COMPONENTS) -> DataFrame:
    """(section, key, ok) of ``reduced`` (vec_id, reduced): ``row``: every vector has ``k`` components; ``pair`` i * k + j
    (i < j): components i and j are uncorrelated; ``order`` i: component i varies no less than i + 1, which varies."""
    c = [F.get("reduced", i) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    stats = reduced.agg(*[F.var_pop(c[i]).alias(f"v{i}") for i in range(k)],
                        *[F.covar_pop(c[i], c[j]).alias(f"c{i}_{j}") for i, j in pairs])
    ok = lambda x: F.coalesce(x, F.lit(False)).alias("ok")
    entry = lambda section, key, x: F.struct(F.lit(section).alias("section"), F.lit(key).cast("bigint").alias("key"), ok(x))
    flags = F.array(*[entry("pair", i * k + j, F.abs(F.col(f"c{i}_{j}")) < 1e-6 * F.col("v0")) for i, j in pairs],
                    *[entry("order", i, (F.col(f"v{i}") >= F.col(f"v{i + 1}")) & (F.col(f"v{i + 1}") > 0)) for i in range(k - 1)])
    rows = reduced.select(F.lit("row").alias("section"), F.col("vec_id").alias("key"), ok(F.size("reduced") == k))
    return rows.unionByName(stats.select(F.explode(flags).alias("f")).select("f.*"))


@register("reduce_embeddings", sql=f"""
select 'row' as section, vec_id as key, true as ok from embeddings
union all select 'pair', i * {N_COMPONENTS} + j, true from range({N_COMPONENTS}) a(i), range({N_COMPONENTS}) b(j) where i < j
union all select 'order', i, true from range({N_COMPONENTS - 1}) a(i)""")
def reduce_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """V8: 4 principal components per vector; SQL states that they are uncorrelated and ordered."""
    e = emb(spark, sf).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return component_checks(V.reduce_embeddings(e, "embedding", N_COMPONENTS).select("vec_id", "reduced"))


def _letter_encoder(texts: list[str]) -> np.ndarray:
    """A small stand-in model: how often each letter occurs (one C-level count per text and letter)."""
    return np.array([[t.count(ch) for ch in LETTERS] for t in texts], dtype=np.float32).reshape(len(texts), len(LETTERS))


@register("embed_text", sql="select doc_id, [" + ", ".join(
    f"(length(coalesce(text, '')) - length(replace(coalesce(text, ''), '{c}', '')))::float" for c in LETTERS) + "] as embedding from documents")
def embed_text(spark: SparkSession, sf: str) -> DataFrame:
    """V7: every document's whole text to a vector, in batches of 64."""
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    return V.embed_text(d, "text", _letter_encoder, len(LETTERS)).select("doc_id", "embedding")


@register("hashed_embedding", sql="""
select doc_id, 1024 as dim, regexp_matches(coalesce(text, ''), '\\S') as unit_norm from documents""")
def hashed_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """V7 default without a model: hashed token counts -> L2 norm; a text with a token has norm 1, one without is zero."""
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    v = V.hashed_embedding(d, "text", dim=1024).select("doc_id", "embedding")
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return v.select("doc_id", F.size("embedding").alias("dim"), F.coalesce(F.abs(norm - 1) < 1e-4, F.lit(False)).alias("unit_norm"))


@register("fold_average", sql=f"with {_SQL_PRED} select vec_id, label, prob_avg from av")
def fold_average(spark: SparkSession, sf: str) -> DataFrame:
    return E.fold_average(fold_predictions(spark, sf), ["vec_id", "label"])


@register("threshold_prediction", sql=f"with {_SQL_PRED} select vec_id, prob_avg, pred from pr")
def threshold_prediction(spark: SparkSession, sf: str) -> DataFrame:
    return averaged(spark, sf).select("vec_id", "prob_avg", "pred")


@register("argmax_prediction", sql=f"with {_SQL_PRED} select vec_id, pred from t64")
def argmax_prediction(spark: SparkSession, sf: str) -> DataFrame:
    """The first maximum of all 64 scores."""
    return emb(spark, sf).select("vec_id", E.argmax_prediction(F.col("embedding").cast("array<double>")).alias("pred"))


@register("outcome_slices", sql=f"""with {_SQL_PRED}
select pr.vec_id,
  case when pr.label = 1 and pr.pred = 1 then 'tp' when pr.label = 0 and pr.pred = 1 then 'fp'
       when pr.label = 1 and pr.pred = 0 then 'fn' when pr.label = 0 and pr.pred = 0 then 'tn' end as outcome,
  concat(case when t3.label = t3.pred then 't' else 'f' end, cast(t3.label as varchar)) as outcome3
from pr join t3 on pr.vec_id = t3.vec_id""")
def outcome_slices(spark: SparkSession, sf: str) -> DataFrame:
    two = averaged(spark, sf).select("vec_id", E.outcome_binary("label", "pred").alias("outcome"))
    three = three_class(spark, sf).select("vec_id", E.outcome_multiclass("label", "pred").alias("outcome3"))
    return two.join(three, "vec_id")


@register("confusion_matrix", sql=f"""with {_SQL_PRED},
g2 as (select a.l as label, b.p as pred from (select unnest([0, 1]) as l) a, (select unnest([0, 1]) as p) b),
g3 as (select a.l as label, b.p as pred from (select unnest([0, 1, 2]) as l) a, (select unnest([0, 1, 2]) as p) b),
c2 as (select label, pred, count(*) as n from pr group by 1, 2),
c3 as (select label, pred, count(*) as n from t3 group by 1, 2)
select 'two' as mode, g2.label, g2.pred, coalesce(c2.n, 0) as n from g2 left join c2 on g2.label = c2.label and g2.pred = c2.pred
union all
select 'three' as mode, g3.label, g3.pred, coalesce(c3.n, 0) as n from g3 left join c3 on g3.label = c3.label and g3.pred = c3.pred""")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    two = E.confusion_matrix(averaged(spark, sf), [0, 1]).select(F.lit("two").alias("mode"), "label", "pred", "n")
    three = E.confusion_matrix(three_class(spark, sf), [0, 1, 2]).select(F.lit("three").alias("mode"), "label", "pred", "n")
    return two.unionByName(three)


_SQL_BIN = """
round(count_if(label = pred) / count(*), 6) as accuracy,
round(case when count_if(label = 1 and pred = 1) + count_if(label <> 1 and pred = 1) = 0 then 0.0
      else count_if(label = 1 and pred = 1) / (count_if(label = 1 and pred = 1) + count_if(label <> 1 and pred = 1)) end, 6) as precision,
round(case when count_if(label = 1 and pred = 1) + count_if(label = 1 and pred <> 1) = 0 then 0.0
      else count_if(label = 1 and pred = 1) / (count_if(label = 1 and pred = 1) + count_if(label = 1 and pred <> 1)) end, 6) as recall,
round(case when 2 * count_if(label = 1 and pred = 1) + count_if(label <> 1 and pred = 1) + count_if(label = 1 and pred <> 1) = 0 then 0.0
      else 2 * count_if(label = 1 and pred = 1) / (2 * count_if(label = 1 and pred = 1) + count_if(label <> 1 and pred = 1)
                                                  + count_if(label = 1 and pred <> 1)) end, 6) as f1,
count_if(label = 1 and pred = 1)::bigint as tp, count_if(label <> 1 and pred = 1)::bigint as fp,
count_if(label = 1 and pred <> 1)::bigint as fn, count_if(label <> 1 and pred <> 1)::bigint as tn
"""


@register("binary_metrics", sql=f"with {_SQL_PRED} select {_SQL_BIN} from pr")
def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return E.binary_metrics(averaged(spark, sf))


@register("fold_metrics", sql=f"""with {_SQL_PRED}
select fold::int as fold, {_SQL_BIN} from (select fold, label, cast(round_even(prob, 0) as int) as pred from fp) group by fold""")
def fold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Each fold's own thresholded predictions scored."""
    p = fold_predictions(spark, sf).withColumn("pred", E.threshold_prediction("prob"))
    return E.fold_metrics(p)


@register("macro_metrics", sql=f"""with {_SQL_PRED},
pt as (select label as k, count(*) as n_true, count_if(label = pred) as tp from t3 group by 1),
pp as (select pred as k, count(*) as n_pred from t3 group by 1),
per as (select coalesce(pt.k, pp.k) as k, coalesce(n_true, 0) as n_true, coalesce(tp, 0) as tp, coalesce(n_pred, 0) as n_pred
        from pt full join pp on pt.k = pp.k)
select round(avg(case when n_true > 0 then tp / n_true end), 6) as balanced_accuracy,
       round(avg(case when n_pred = 0 then 0.0 else tp / n_pred end), 6) as macro_precision,
       round(avg(case when n_true = 0 then 0.0 else tp / n_true end), 6) as macro_recall,
       round(avg(case when n_true + n_pred = 0 then 0.0 else 2 * tp / (n_true + n_pred) end), 6) as macro_f1
from per""")
def macro_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return E.macro_metrics(three_class(spark, sf))


_SQL_GAINS = """
px as (select vec_id % 5 as fold, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as i from embeddings),
gains as (select fold, case when i < 30 then concat('posts_embedding_', cast(i + 1 as varchar))
                            when i < 60 then concat('reposts_embedding_', cast(i - 29 as varchar))
                            else ['posts_like', 'reposts_like', 'posts_repost', 'reposts_repost'][i - 59] end as feature,
                 sum(abs(x)) as gain from px group by 1, 2),
mean as (select feature, sum(gain) / 5 as importance from gains group by feature),
ratio as (select feature, importance, importance / sum(importance) over () as importance_ratio,
                 (row_number() over (order by importance desc, feature))::int as rank from mean)
"""


@register("importance_mean_ratio", sql=f"""with {_SQL_GAINS}
select feature, round(importance, 6) as importance, round(importance_ratio, 6) as importance_ratio from ratio""")
def importance_mean_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return E.importance_mean_ratio(feature_gains(spark, sf), N_FOLDS).drop("rank")


@register("importance_sort", sql=f"with {_SQL_GAINS} select feature, rank from ratio")
def importance_sort(spark: SparkSession, sf: str) -> DataFrame:
    """T5: features by mean gain, descending (rank column; ties by name)."""
    return E.importance_mean_ratio(feature_gains(spark, sf), N_FOLDS).select("feature", "rank")


@register("importance_by_prefix", sql=f"""with {_SQL_GAINS}
select regexp_extract(feature, '^(posts_embedding|reposts_embedding|posts_like|reposts_like|posts_repost|reposts_repost)', 1) as prefix,
       round(sum(importance_ratio), 6) as ratio from ratio group by 1""")
def importance_by_prefix(spark: SparkSession, sf: str) -> DataFrame:
    ratios = E.importance_mean_ratio(feature_gains(spark, sf), N_FOLDS, digits=12)
    return E.importance_by_prefix(ratios)


@register("attach_predictions", sql=f"""with {_SQL_PRED}
select e.vec_id, e.label as label10, pr.label, pr.pred from embeddings e join pr on e.vec_id = pr.vec_id""")
def attach_predictions(spark: SparkSession, sf: str) -> DataFrame:
    rows = emb(spark, sf).select("vec_id", F.col("label").alias("label10"))
    return E.attach_predictions(rows, averaged(spark, sf).select("vec_id", "label", "pred"), ["vec_id"])


@register("evaluate_run", sql=f"""with {_SQL_PRED}, m as (select {_SQL_BIN} from pr)
select metric, value from (
  select 'accuracy' as metric, accuracy::double as value from m union all select 'precision', precision::double from m
  union all select 'recall', recall::double from m union all select 'f1', f1::double from m
  union all select 'tp', tp::double from m union all select 'fp', fp::double from m
  union all select 'fn', fn::double from m union all select 'tn', tn::double from m)""")
def evaluate_run(spark: SparkSession, sf: str) -> DataFrame:
    """M7: the two-class run's metrics as one (metric, value) table."""
    return E.evaluate_run(averaged(spark, sf), "two")


@register("stratified_folds", sql="""
select vec_id, label, ((row_number() over (partition by label order by md5(concat_ws('|', cast(vec_id as varchar), '42')), vec_id) - 1) % 5)::int as fold
from (select vec_id, case when label < 5 then 1 else 0 end as label from embeddings)""")
def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    """M2: 5 folds, stratified by label, in seeded shuffle order (balanced to +-1 per label)."""
    e = emb(spark, sf).select("vec_id", (F.col("label") < 5).cast("int").alias("label"))
    ranked = S.shuffled_rank(e, ["vec_id"], 42, "r", partition_by=["label"])
    return ranked.select("vec_id", "label", ((F.col("r") - 1) % N_FOLDS).cast("int").alias("fold"))
