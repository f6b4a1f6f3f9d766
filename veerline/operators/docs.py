"""Token and chunk-text operators: tokenize, token budget, ordered / shuffled chunk text,
vocabulary, encode / decode, attention mask, truncation.

All group sizes here are bounded (a chunk has at most chunk_size sentences; a document's token
array is bounded by its length), so per-group arrays are safe. Vocabulary-sized data is never
broadcast blindly: encoding joins on the token (of packed documents, on the distinct tokens of each
block), and AQE picks broadcast only when the vocabulary is small at run time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veerline.operators import blocks
from veerline.operators.sampling import global_rank, seeded_key

# Default tokenizer: runs of word characters, or one other non-blank character.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\t\n\x0b\x0c\r \p{L}\p{N}_]"
SEP = "[SEP]"
# Reserved ids of the vocabulary built here.
PAD_ID, UNK_ID, CLS_ID, SEP_ID = 0, 1, 2, 3
SPECIAL_TOKENS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]")

# Special-token rules applied when ids are decoded one by one.
DECODE_REMOVE = ("##", "[CLS]", "<s>", "[UNK]", "<unk>")
DECODE_TO_BLANK = ("[SEP]", "</s>")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokenize(text: Column | str, pattern: str = TOKEN_PATTERN) -> Column:
    """V1: text -> array<string> of tokens (no truncation). A model tokenizer can replace this
    with a pandas_udf returning the same type."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(pattern), F.lit(0))


def tokenizer_udf(tokenize_batch: Callable[[list[str]], list[list[str]]]):
    """V1 with a user's tokenizer: ``tokenize_batch(texts) -> tokens per text`` runs on Arrow
    batches (one call per batch, model state loaded once per worker). Same output type as
    ``tokenize``, so it drops into the token budget, vocabulary and encoding unchanged."""
    @F.pandas_udf("array<string>")
    def _tokenize(texts: pd.Series) -> pd.Series:
        return pd.Series(list(tokenize_batch(texts.fillna("").tolist())), index=texts.index)

    return _tokenize


def mark_budget(df: DataFrame, keys: Sequence[str], pos: str, text: str, budget: int,
                n_tokens: Column | None = None) -> DataFrame:
    """Flag ``kept`` the sentences taken in order while the total cost stays <= budget.

    Each non-empty sentence costs tokens + 1 (separator); empty ones cost nothing and are never
    kept. Costs are >= 1, so the running sum only grows and "stop at the first overflow" equals
    the filter running_sum <= budget. The window is per chunk (bounded size)."""
    ntok = n_tokens if n_tokens is not None else F.size(tokenize(text))
    nonempty = F.coalesce(F.col(text), F.lit("")) != ""
    cost = F.when(nonempty, ntok + 1).otherwise(F.lit(0))
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (df.withColumn("cost", cost)
            .withColumn("kept", nonempty & (F.sum("cost").over(w) <= budget)))


def chunk_text_aggs(pos: str, text: str, seed_cols: Sequence[str], seed: int = 42,
                    sep: str = SEP, prefix: str = "") -> list[Column]:
    """A2 + T2 aggregate expressions over rows marked by ``mark_budget``.

    ``{prefix}text_sorted``: kept sentences in order; ``{prefix}text_random``: kept sentences in
    a reproducible shuffled order (md5 of the row key and seed); ``{prefix}n_kept``. A chunk where
    nothing fits still yields '' (the group exists, the list is empty)."""
    order_key = seeded_key([*seed_cols, pos], seed)
    kept = F.col("kept")
    sorted_list = F.array_sort(F.collect_list(F.when(kept, F.struct(F.col(pos).alias("k"), F.col(text).alias("t")))))
    random_list = F.array_sort(F.collect_list(F.when(kept, F.struct(order_key.alias("k"), F.col(text).alias("t")))))
    return [F.array_join(F.transform(sorted_list, lambda x: x["t"]), sep).alias(prefix + "text_sorted"),
            F.array_join(F.transform(random_list, lambda x: x["t"]), sep).alias(prefix + "text_random"),
            F.count_if(kept).alias(prefix + "n_kept")]


def ranked_text_agg(order: str, pos: str, text: str, sep: str = SEP, name: str = "text_ranked",
                    kept: str = "kept") -> Column:
    """A2 for the ranked variant (T4): ``kept`` sentences joined in ``order`` (nulls last), ties by ``pos``."""
    key = F.struct(F.col(order).isNull().alias("n"), F.col(order).alias("o"), F.col(pos).alias("p"))
    items = F.array_sort(F.collect_list(F.when(F.col(kept), F.struct(key.alias("k"), F.col(text).alias("t")))))
    return F.array_join(F.transform(items, lambda x: x["t"]), sep).alias(name)


def build_vocabulary(tokens: DataFrame, token: str = "token", hex_digits: int = 3) -> DataFrame:
    """V2: distinct tokens -> dense ids after the reserved ones, in md5 order of the token.

    Exact dense ranks without a one-task window (two-level rank of ``global_rank``)."""
    distinct = tokens.select(token).where(F.col(token).isNotNull()).distinct()
    ranked = global_rank(distinct, seeded_key([token], None), tiebreak=[token], hex_digits=hex_digits)
    return ranked.select(F.col(token), (F.col("rank") + len(SPECIAL_TOKENS) - 1).alias("token_id"))


def sized_side(table: DataFrame, max_rows: int | None) -> DataFrame:
    """A lookup table for a join: broadcast only behind a size check (``count() <= max_rows``);
    beyond the bound, or without one, it stays a normal shuffle-join side (AQE may still
    broadcast it when its runtime size is small)."""
    if max_rows is not None and table.count() <= max_rows:
        return F.broadcast(table)
    return table


def encode_tokens(docs: DataFrame, key: str, tokens_col: str, vocab: DataFrame,
                  broadcast_max_rows: int | None = None) -> DataFrame:
    """V2: array<string> -> array<bigint> ids in token order; unknown tokens -> UNK_ID.

    posexplode_outer + equi-join on the token + ordered re-fold per document; a document without
    tokens keeps one null row, so it folds to an empty array without a second join. A hot token
    is handled by AQE's skew-join split (the re-fold shuffles by document anyway). A model
    vocabulary of known size can be broadcast with ``broadcast_max_rows`` (checked, see
    ``sized_side``), which removes the shuffle by token."""
    exploded = docs.select(key, F.posexplode_outer(tokens_col).alias("p", "token"))
    joined = exploded.join(sized_side(vocab, broadcast_max_rows), "token", "left")
    item = F.when(F.col("p").isNotNull(), F.struct("p", F.coalesce("token_id", F.lit(UNK_ID)).cast("bigint").alias("id")))
    ids = F.sort_array(F.collect_list(item))
    return joined.groupBy(key).agg(F.transform(ids, lambda x: x["id"]).alias("ids"))


def vocabulary_and_ids(docs: DataFrame, key: str, tokens_col: str, hex_digits: int = 3
                       ) -> tuple[DataFrame, DataFrame]:
    """V2: the vocabulary built from the documents' own tokens, and every document encoded with it.
    The documents are packed into blocks (``blocks``): vocabulary and encoding read a token once per block,
    so a hot token is no more than a row of each block."""
    packed = blocks.in_blocks(docs, key, tokens_col)
    tokens = packed.select(F.explode("items").alias("token"))
    vocab = blocks.written(build_vocabulary(tokens, hex_digits=hex_digits), "vocabulary")
    token_id = F.coalesce("token_id", F.lit(UNK_ID)).cast("bigint")
    return vocab, blocks.look_up(packed, key, vocab, "token", token_id, "ids")


def decode_pieces(ids_df: DataFrame, key: str, ids: str, vocab: DataFrame,
                  broadcast_max_rows: int | None = None) -> DataFrame:
    """V3: ids -> text by decoding each id alone, applying the special-token rules, and
    concatenating without separator; a null or empty id list decodes to ''. The rows are packed into
    blocks (``blocks``), of which each id is decoded once."""
    specials = vocab.sparkSession.createDataFrame(
        [(t, i) for i, t in enumerate(SPECIAL_TOKENS)], "token string, token_id bigint")
    full_vocab = vocab.select("token", F.col("token_id").cast("bigint")).unionByName(specials)
    piece = F.coalesce(F.col("token"), F.lit(""))
    for s in DECODE_REMOVE:
        piece = F.replace(piece, F.lit(s), F.lit(""))
    for s in DECODE_TO_BLANK:
        piece = F.replace(piece, F.lit(s), F.lit(" "))
    packed = blocks.in_blocks(ids_df, key, ids)
    pieces = blocks.look_up(packed, key, sized_side(full_vocab, broadcast_max_rows), "token_id", piece, "pieces")
    return pieces.select(key, F.array_join("pieces", "").alias("decoded"))


def decode_whole(ids_df: DataFrame, key: str, ids: str, vocab: DataFrame,
                 broadcast_max_rows: int | None = None) -> DataFrame:
    """V3 for the flagged post: the id list decoded as one text, special tokens kept: tokens
    joined by blanks, '##' continuation pieces glued to the token before; null ids give ''."""
    specials = vocab.sparkSession.createDataFrame(
        [(t, i) for i, t in enumerate(SPECIAL_TOKENS)], "token string, token_id bigint")
    full_vocab = vocab.select("token", F.col("token_id").cast("bigint")).unionByName(specials)
    exploded = ids_df.select(key, F.posexplode_outer(ids).alias("p", "token_id"))
    joined = exploded.join(sized_side(full_vocab, broadcast_max_rows), "token_id", "left")
    item = F.when(F.col("p").isNotNull(), F.struct(F.col("p"), F.coalesce("token", F.lit("")).alias("t")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["t"]), " ")
    return joined.groupBy(key).agg(F.replace(text, F.lit(" ##"), F.lit("")).alias("decoded"))


def attention_mask(ids: Column | str, pad_id: int = PAD_ID, sep_id: int = SEP_ID) -> Column:
    """V4: true unless the id is the pad or the separator id."""
    return F.transform(_c(ids), lambda x: ~x.isin(pad_id, sep_id))


def with_specials(ids: Column | str, cls_id: int = CLS_ID, sep_id: int = SEP_ID) -> Column:
    """[CLS] + all ids + [SEP]."""
    return F.concat(F.array(F.lit(cls_id).cast("bigint")), _c(ids).cast("array<bigint>"),
                    F.array(F.lit(sep_id).cast("bigint")))


def truncate_tokens(ids: Column | str, max_len: int = 512, cls_id: int = CLS_ID, sep_id: int = SEP_ID) -> Column:
    """V5: [CLS] + the first max_len - 2 ids + [SEP] (at most max_len ids including specials)."""
    return F.concat(F.array(F.lit(cls_id).cast("bigint")),
                    F.slice(_c(ids).cast("array<bigint>"), 1, max_len - 2),
                    F.array(F.lit(sep_id).cast("bigint")))
