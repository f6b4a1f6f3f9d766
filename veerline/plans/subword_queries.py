"""Longest-match subwords on ``conversations`` (V1, V3).

The vocabulary is derived from the turns by a fixed rule and is complete neither in pieces nor in letters, so that
whole words, ``##`` pieces and [UNK] all occur: words of at most four characters, the first letters a to y, ``##``
and each of the letters a to y, and ``##`` and the last three characters of longer words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veerline.operators import docs as D
from veerline.operators import subword as S
from veerline.plans.docs_queries import _SQL_TOKENS
from veerline.plans.registry import register
from veerline.sources import io
from veerline.sources.tables import read_table

_SQL = f"""
turns as materialized (select conv_id || ':' || turn as turn_id, {_SQL_TOKENS} as words from conversations),
placed as materialized (select turn_id, unnest(words) as word, generate_subscripts(words, 1) as p from turns),
words as materialized (select distinct word from placed),
letters as (select distinct unnest(string_split(word, '')) as c from words),
pieces as (
  select word as token from words where length(word) <= 4
  union select c from letters where c between 'a' and 'y'
  union select '##' || c from letters where c between 'a' and 'y'
  union select '##' || right(word, 3) from words where length(word) > 4),
vocab as materialized (select token, row_number() over (order by md5(token), token) + 3 as token_id from pieces),
starts as materialized (select word, unnest(range(0, length(word))) as start from words where length(word) <= 100),
parts as materialized (
  select word, start, size, case when start > 0 then '##' else '' end || substr(word, start + 1, size) as token
  from (select *, unnest(range(1, least(20, length(word) - start + 1))) as size from starts)),
matches as materialized (
  select word, start, max(size) as size, arg_max(token_id, size) as token_id from parts join vocab using (token) group by word, start),
walk as (
  select word, 0 as pos, []::bigint[] as ids from words
  union all
  select k.word, (k.pos + m.size)::int, list_append(k.ids, m.token_id) from walk k join matches m on k.word = m.word and k.pos = m.start),
cut as materialized (
  select w.word, coalesce(max(k.ids), [1::bigint]) as ids, max(k.ids) is not null as known
  from words w left join (select * from walk where pos = length(word)) k on w.word = k.word group by w.word)
"""


def turn_words(spark: SparkSession, sf: str) -> DataFrame:
    turns = read_table(spark, sf, "conversations")
    return turns.select(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("turn_id"), D.tokenize("text").alias("words"))


def vocabulary(words: DataFrame) -> DataFrame:
    """The fixed rule above, as (token, token_id)."""
    short = words.where(F.char_length("word") <= 4).select(F.col("word").alias("token"))
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where(F.col("c").between("a", "y")).select("c").distinct()
    inside = words.where(F.char_length("word") > 4).select(F.concat(F.lit(S.INSIDE), F.expr("right(word, 3)")).alias("token"))
    return D.build_vocabulary(short.unionByName(letters.select(F.col("c").alias("token"))).unionByName(
        letters.select(F.concat(F.lit(S.INSIDE), F.col("c")).alias("token"))).unionByName(inside))


def encoded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The turns' ids and the vocabulary; the distinct words and the vocabulary are written once, as each has many readers."""
    def written(df: DataFrame, name: str) -> DataFrame:
        path = io.scratch_dir(spark, name)
        io.write_features(df, path)
        return spark.read.schema(df.schema).parquet(path)

    turns = turn_words(spark, sf)
    words = written(turns.select(F.explode("words").alias("word")).distinct(), "subword_words")
    vocab = written(vocabulary(words), "subword_vocabulary")
    return S.encode_subwords(turns, "turn_id", "words", vocab), vocab


@register("encode_subwords", sql=f"""with recursive {_SQL}
select t.turn_id, coalesce(e.ids, []::bigint[]) as ids
from turns t left join (select turn_id, flatten(list(c.ids order by p)) as ids from placed join cut c using (word) group by turn_id) e
  using (turn_id)""")
def encode_subwords(spark: SparkSession, sf: str) -> DataFrame:
    """V1: every turn as subword ids, longest match from the left, unknown words as [UNK]."""
    return encoded(spark, sf)[0]


@register("decode_subwords", sql=f"""with recursive {_SQL}
select t.turn_id, coalesce(string_agg(case when c.known then p.word else '[UNK]' end, ' ' order by p.p), '') as whole,
       coalesce(string_agg(case when c.known then p.word else '' end, '' order by p.p), '') as pieces
from turns t left join placed p using (turn_id) left join cut c using (word) group by t.turn_id""")
def decode_subwords(spark: SparkSession, sf: str) -> DataFrame:
    """V1, then V3: decoded whole, the turn's words come back ([UNK] for those the vocabulary cannot cut); decoded
    piece by piece, without ``##``, [UNK] and blanks."""
    ids, vocab = encoded(spark, sf)
    whole = D.decode_whole(ids, "turn_id", "ids", vocab).withColumnRenamed("decoded", "whole")
    pieces = D.decode_pieces(ids, "turn_id", "ids", vocab).withColumnRenamed("decoded", "pieces")
    return whole.join(pieces, "turn_id")
