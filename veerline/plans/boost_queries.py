"""Leaf-wise boosting on ``embeddings`` (M3, M4, S9): first splits against SQL, losses by fold and round,
and what must hold between two fits (same mapping as ``model_queries``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veerline.operators import boosting as B
from veerline.operators import model as M
from veerline.plans.model_queries import _SQL_TEST, N_FOLDS, cv_and_test, sound
from veerline.plans.registry import register
from veerline.sources.tables import read_table


def fit(cv: DataFrame, **params) -> B.Boosting:
    return B.start_boosting(cv, ["vec_id"], n_folds=N_FOLDS, params=B.BoostParams(**params))


@register("boosted_root_splits", sql=f"""with {_SQL_TEST},
vals as materialized (
  select f.vec_id, f.f as fold, f.label2 as y, i - 1 as feature, e.embedding[i]::double as x
  from folds f join embeddings e using (vec_id), (select unnest(range(1, 65)) as i) where f.f < 5),
numbered as (
  select feature, x, row_number() over (partition by feature order by x) as r, count(*) over (partition by feature) as n,
         max(x) over (partition by feature) as top from vals),
few as (select feature, count(distinct x) <= 255 as few from vals group by feature),
borders as materialized (
  select distinct feature, x as border from numbered join few using (feature)
  where x < top and (few or r in (select (q * n + 254) // 255 from (select unnest(range(1, 255)) as q)))),
cells as (
  select v.fold, v.vec_id, v.y, v.feature, b.border from vals v asof left join borders b on v.feature = b.feature and v.x <= b.border),
shares as (
  select k, avg(y)::double as s from (select distinct vec_id, fold, y from vals), (select unnest(range(5)) as k) where fold <> k group by k),
starts as (select k, 1 / (1 + exp(-ln(s / (1 - s)))) as p from shares),
sums as (
  select k, feature, border, sum(round((p - y) * 16777216)::hugeint) as g, sum(round(p * (1 - p) * 16777216)::hugeint) as h, count(*) as n
  from cells, starts where fold <> k group by k, feature, border),
running as (
  select k, feature, border, sum(g) over upto as gl, sum(h) over upto as hl, sum(n) over upto as nl,
         sum(g) over whole as g, sum(h) over whole as h, sum(n) over whole as n
  from sums window whole as (partition by k, feature),
                   upto as (partition by k, feature order by border nulls last rows between unbounded preceding and current row)),
gains as (
  select *, (gl::double * gl::double / hl::double + (g - gl)::double * (g - gl)::double / (h - hl)::double - g::double * g::double / h::double) / 16777216 as gain
  from running where border is not null and nl >= 20 and n - nl >= 20)
select k::int as fold, feature::int as feature, border as threshold, round(gain, 6) as gain, n::bigint as n
from gains where gain > 0 qualify row_number() over (partition by k order by gain desc, feature, border) = 1""")
def boosted_root_splits(spark: SparkSession, sf: str) -> DataFrame:
    """M3: the first split of every fold's first tree: quantile bins, sums of gradients and Hessians, gain."""
    cv, _ = cv_and_test(spark, sf)
    trees = fit(cv).run(1).model(1).tree_table(spark)
    return trees.where("node = 0 and feature is not null").select("fold", "feature", "threshold", F.round("gain", 6).alias("gain"), "n")


@register("boosted_rounds")
def boosted_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """M3: held-out log-loss of every fold after every round until early stopping (up to 1,000 rounds, 31
    leaves, step 0.1, patience 20), and whether the fold-mean loss chose that round."""
    cv, _ = cv_and_test(spark, sf)
    done = fit(cv).run()
    return done.loss_table(spark).withColumn("chosen", F.col("round") == done.best_round())


@register("boosted_resumed", sql="""
select fold::int as fold, round::int as round, true as same_loss
from (select unnest(range(5)) as fold), (select unnest(range(4)) as round)""")
def boosted_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """M3: three rounds at once, and one round and then two more with the scores written after each and leaves
    of over 100 rows split from combined sums: the same held-out losses, bit for bit."""
    cv, _ = cv_and_test(spark, sf)
    whole = fit(cv).run(3).loss_table(spark)
    parts = fit(cv, local_rows=100, rewrite_every=1).run(1).run(2).loss_table(spark).withColumnRenamed("loss", "again")
    return whole.join(parts, ["fold", "round"], "left").select("fold", "round", sound(F.col("loss") == F.col("again")).alias("same_loss"))


@register("boosted_saved", sql=f"""with {_SQL_TEST}
select vec_id, fold::int as fold, true as same_prob from test, (select unnest(range(5)) as fold)""")
def boosted_saved(spark: SparkSession, sf: str) -> DataFrame:
    """Fold models saved as a tree table and loaded again give every test row the same probability."""
    cv, test = cv_and_test(spark, sf)
    model = fit(cv).run(5).model(5)
    path = model.save(spark, M.model_dir(read_table(spark, sf, "embeddings"), "boosted_saved"))
    again = B.BoostedModel.load(spark, path).predict(test, ["vec_id"]).withColumnRenamed("prob", "again")
    both = model.predict(test, ["vec_id"]).join(again, ["vec_id", "fold"], "left")
    return both.select("vec_id", "fold", sound((F.col("prob") == F.col("again")) & F.col("prob").between(0, 1)).alias("same_prob"))
