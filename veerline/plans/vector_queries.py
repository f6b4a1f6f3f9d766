"""Vectors learned from ``conversations`` (V7): associations of words against SQL, eigenvectors and text vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veerline.operators import docs as D
from veerline.operators import wordvectors as W
from veerline.plans.docs_queries import _SQL_TOKENS
from veerline.plans.registry import register
from veerline.sources.tables import read_table

WINDOW, MIN_COUNT, DIMS = 3, 5, 16


def turn_words(spark: SparkSession, sf: str) -> DataFrame:
    turns = read_table(spark, sf, "conversations")
    return turns.select(F.concat_ws(":", "conv_id", "turn").alias("turn_id"), D.tokenize("text").alias("words"))


def associations(spark: SparkSession, sf: str) -> DataFrame:
    return W.positive_information(W.cooccurrences(turn_words(spark, sf), "words", WINDOW, MIN_COUNT))


@register("word_associations", sql=f"""
with placed as materialized (
  select t, unnest(w) as word, generate_subscripts(w, 1) as p
  from (select conv_id || ':' || turn as t, {_SQL_TOKENS} as w from conversations)),
frequent as (select word from placed group by word having count(*) >= {MIN_COUNT}),
pairs as (select x.word as a, y.word as b from placed x join placed y on x.t = y.t and y.p > x.p and y.p <= x.p + {WINDOW}),
both_ways as (select a, b from pairs union all select b, a from pairs),
cells as materialized (
  select a, b, count(*) as n from both_ways
  where a in (select word from frequent) and b in (select word from frequent) group by a, b),
sums as (select a, sum(n) as s from cells group by a)
select c.a, c.b, c.n, round(ln(c.n * (select sum(n) from cells)::double / (u.s::double * v.s::double)), 6) as x
from cells c join sums u on c.a = u.a join sums v on c.b = v.a
where ln(c.n * (select sum(n) from cells)::double / (u.s::double * v.s::double)) > 0""")
def word_associations(spark: SparkSession, sf: str) -> DataFrame:
    """V7: positive pointwise mutual information of words that stand near each other."""
    return associations(spark, sf).withColumn("x", F.round("x", 6))


@register("learned_word_vectors")
def learned_word_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """V7: (word, vector): the leading eigenvectors of the associations, scaled; four digits."""
    found = W.word_vectors(associations(spark, sf), DIMS).scaled()
    return found.select("word", F.transform("vector", lambda x: F.round(x, 4)).alias("vector"))


@register("learned_embedding")
def learned_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """V7: (turn_id, vector, n_known): every turn as the mean of its words' learned vectors."""
    turns = turn_words(spark, sf)
    found = W.word_vectors(W.positive_information(W.cooccurrences(turns, "words", WINDOW, MIN_COUNT)), DIMS)
    texts = W.embed_by_words(turns, "turn_id", "words", found.scaled(), len(found.values))
    return texts.select("turn_id", F.transform("vector", lambda x: F.round(x, 4)).alias("vector"), "n_known")
