"""Longest-match subword encoding against a vocabulary table (V1 / V3).

A word is cut from the left into the longest pieces the vocabulary has; a piece inside a word stands in the
vocabulary with ``##`` before it. A word that cannot be cut whole, or is longer than ``max_chars``, is one
[UNK]. The vocabulary is a table (``token``, ``token_id``) of any size and is joined, never collected.

Scale: each distinct word is cut once (its occurrences combine on the map side). Its substrings up to the
longest piece meet the vocabulary in one shuffled join (they are many times the words they come from, which
is all that Spark's size estimate knows: it would broadcast them); per place only the longest match stays, at
most ``max_chars`` per word, and a fold over them walks the word. Occurrences then look up their word's pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veerline.operators.docs import UNK_ID

INSIDE = "##"
MAX_CHARS = 100


def _marked(start: Column, piece: Column) -> Column:
    return F.when(start > 0, F.concat(F.lit(INSIDE), piece)).otherwise(piece)


def longest_matches(words: DataFrame, vocab: DataFrame, word: str = "word", max_chars: int = MAX_CHARS) -> DataFrame:
    """(word, start, size, token_id): the longest piece at every place of the words that has one."""
    n = F.char_length("token") - F.when(F.startswith("token", F.lit(INSIDE)), len(INSIDE)).otherwise(0)
    longest = vocab.agg(F.max(n)).first()[0] or 0                    # one number
    short = words.select(F.col(word).alias("word")).where(F.char_length("word").between(1, max_chars))
    places = short.select("word", F.explode(F.sequence(F.lit(0), F.char_length("word") - 1)).alias("start"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(max(longest, 1)), F.char_length("word") - F.col("start")))
    pieces = places.select("word", "start", F.explode(sizes).alias("size"))
    pieces = pieces.withColumn("token", _marked(F.col("start"), F.substring(F.col("word"), F.col("start") + 1, F.col("size"))))
    found = pieces.hint("merge").join(vocab.select("token", F.col("token_id").cast("bigint").alias("token_id")), "token")
    best = F.max(F.struct("size", "token_id"))
    return found.groupBy("word", "start").agg(best.alias("b")).select("word", "start", "b.size", "b.token_id")


def word_pieces(words: DataFrame, vocab: DataFrame, word: str = "word", max_chars: int = MAX_CHARS,
                unk_id: int = UNK_ID) -> DataFrame:
    """(word, ids) of distinct non-null words: their pieces from the left, or [``unk_id``]."""
    distinct = words.select(F.col(word).alias("word")).where(F.col(word).isNotNull()).distinct()
    at = longest_matches(distinct, vocab, max_chars=max_chars)
    matches = at.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("start", "size", "token_id"))).alias("m"))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<bigint>").alias("ids"))

    def walk(state: Column, m: Column) -> Column:
        step = F.struct((state["at"] + m["size"]).alias("at"), F.concat(state["ids"], F.array(m["token_id"])).alias("ids"))
        return F.when(m["start"] == state["at"], step).otherwise(state)

    unknown = F.array(F.lit(unk_id).cast("bigint"))
    whole = lambda s: F.when(s["at"] == F.char_length("word"), s["ids"]).otherwise(unknown)
    cut = matches.select("word", F.aggregate("m", first, walk, whole).alias("ids"))
    return distinct.join(cut, "word", "left").select("word", F.coalesce("ids", unknown).alias("ids"))


def encode_subwords(docs: DataFrame, key: str, words_col: str, vocab: DataFrame, max_chars: int = MAX_CHARS,
                    unk_id: int = UNK_ID) -> DataFrame:
    """(key, ids): the pieces of each document's words, in order; no words (or null): an empty list. Null words are
    left out. Keys are unique and not null."""
    placed = docs.select(key, F.posexplode_outer(words_col).alias("p", "word"))
    cut = word_pieces(placed, vocab, max_chars=max_chars, unk_id=unk_id)
    joined = placed.join(cut, "word", "left")
    item = F.when(F.col("ids").isNotNull(), F.struct("p", "ids"))
    ordered = F.transform(F.sort_array(F.collect_list(item)), lambda x: x["ids"])
    return joined.groupBy(key).agg(F.flatten(ordered).alias("ids"))
