"""The whole feature build for any timeline table (X1 + X2), parameterised.

From timelines (one row per post: account, order, flag, handle, text, like / repost counts),
build one record per own-post chunk after each account's last flagged post. A record holds the
engagement sums of its chunk and of the paired repost chunk (carry-forward), its label, and the
budgeted chunk texts in order, shuffled and ranked by distance to the flagged post, with the
flagged post copied in. ``encode_record`` adds token ids and vectors. The changer and
non-changer builds are the same chain with other keywords, labels and (for non-changers) the
account handle taken from the file name.

Plan shape: one flag aggregate; a salted equi-join for the tail; narrow parsing and cleaning of
the tail rows only (after the gate); a two-level per-side window; one group-by per chunk; one
group-by per account for the pairing."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veerline.functions import text as T
from veerline.operators import docs as D
from veerline.operators import timeline as tl
from veerline.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class TimelineColumns:
    """Column names of a timeline table."""
    account: str = "account"
    pos: str = "pos"
    flag: str = "flag"        # boolean: the row is a flagged post
    handle: str = "handle"    # author handle of the row
    text: str = "text"
    likes: str = "likes"      # abbreviated count strings ('1.2K') or numbers
    reposts: str = "reposts"


@dataclass(frozen=True)
class FeatureParams:
    keywords: Sequence[str] | None = None                    # the flagged post must hold one (None: no gate)
    lexicon: Sequence[str] = field(default_factory=tuple)    # removed in order by the cleaning
    promotions: Sequence[str] = field(default_factory=tuple)  # cleaned rows matching one are dropped
    strip_words: Sequence[str] = field(default_factory=tuple)  # phrases taken out of the ranked texts
    chunk_size: int = 20
    max_chunks: int = 3
    budget: int = 512
    first_label: int = 1
    later_label: int = 3
    seed: int = 42
    rows_per_task: int = tl.DEFAULT_ROWS_PER_TASK


def flagged_accounts(posts: DataFrame, c: TimelineColumns, keywords: Sequence[str] | None) -> DataFrame:
    """W1 + P4 + P2: each account's last flagged post, kept when its text is non-empty and holds
    a keyword (account, flag_pos, n_rows, flag_text, flag_handle)."""
    flags = tl.last_flag(posts, c.account, c.pos, c.flag, carry={"flag_text": c.text, "flag_handle": c.handle})
    flags = flags.where(F.length("flag_text") > 0)
    return flags if keywords is None else flags.where(T.contains_any("flag_text", keywords))


def chunk_rows(posts: DataFrame, c: TimelineColumns, p: FeatureParams,
               account_handle: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """W2 -> P1 -> C10 -> P3 -> P5 -> W3 / W4: the chunked rows after the flag, and the flags.

    Own posts carry the flagged post's handle, or ``account_handle`` (an expression over the
    account column) when given. Adds ``likes_n``, ``reposts_n``, ``own``, ``side_rank``, ``chunk_id``."""
    flags = flagged_accounts(posts, c, p.keywords)
    if account_handle is not None:
        flags = flags.withColumn("flag_handle", account_handle)
    stats = tl.last_flag(posts, c.account, c.pos, c.flag)
    tail = tl.tail_after_flag(posts, flags, c.account, c.pos, p.rows_per_task, keep_salt=True, stats=stats)
    tail = (tail.withColumn("likes_n", T.parse_abbrev_count(c.likes))
            .withColumn("reposts_n", T.parse_abbrev_count(c.reposts))
            .withColumn(c.text, T.clean_text(c.text, p.lexicon)))
    if p.promotions:
        tail = tail.where(~T.matches_any_regex(c.text, p.promotions))
    tail = tail.withColumn("own", tl.split_own(c.handle, "flag_handle"))
    return tl.chunk_sides(tail, p.chunk_size, p.max_chunks, c.account, "own", c.pos), flags


def chunk_aggregates(chunks: DataFrame, c: TimelineColumns, p: FeatureParams, with_text: bool,
                     n_tokens: Callable[[Column], Column] | None = None,
                     distance: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """A1 (+ W5, A2, T2, T4): per (account, side, chunk) row count, sums and, optionally, the budgeted
    chunk texts (``n_tokens`` counts a sentence's tokens; default: the regex tokenizer).

    ``distance(sentence, flagged text)`` adds the ranked form: ``strip_words`` leave each sentence
    (C11), what remains is budgeted on its own, and kept sentences are joined by distance. All
    forms share one exchange by chunk."""
    keys = [c.account, "own", "chunk_id"]
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("likes_n").alias("likes"), F.sum("reposts_n").alias("reposts")]
    if with_text:
        count = (lambda text: n_tokens(F.col(text))) if n_tokens is not None else (lambda text: None)
        if distance is not None:
            chunks = chunks.withColumn("_stripped", T.remove_words(c.text, p.strip_words))
            chunks = (D.mark_budget(chunks, keys, c.pos, "_stripped", p.budget, count("_stripped"))
                      .withColumnRenamed("kept", "_kept_ranked")
                      .withColumn("_distance", distance(F.col("_stripped"), F.col("flag_text"))))
            aggs += [D.ranked_text_agg("_distance", c.pos, "_stripped", kept="_kept_ranked"),
                     F.count_if("_kept_ranked").alias("n_ranked")]
        chunks = D.mark_budget(chunks, keys, c.pos, c.text, p.budget, count(c.text))
        aggs += D.chunk_text_aggs(c.pos, c.text, keys, p.seed)
    return chunks.groupBy(*keys).agg(*aggs)


def build_features(posts: DataFrame, c: TimelineColumns = TimelineColumns(), p: FeatureParams = FeatureParams(),
                   account_handle: Column | None = None, with_text: bool = True,
                   n_tokens: Callable[[Column], Column] | None = None,
                   distance: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """X1 (+ X2): one record per own chunk (at most ``max_chunks`` per account) of every account
    that passed the gates and has posts on both sides after its flag. With ``distance`` the record
    also holds the ranked texts (see ``chunk_aggregates``)."""
    chunks, flags = chunk_rows(posts, c, p, account_handle)
    pairs = tl.pair_carry_forward(chunk_aggregates(chunks, c, p, with_text, n_tokens, distance), c.account, "own",
                                  max_chunks=p.max_chunks)
    out = pairs.join(flags.select(c.account, "flag_handle", "flag_text"), c.account)
    cols = [F.col(c.account), T.normalise_handle("flag_handle").alias("account_name"), F.col("chunk_id"),
            F.col("own_likes").alias("posts_like"), F.col("other_likes").alias("reposts_like"),
            F.col("own_reposts").alias("posts_repost"), F.col("other_reposts").alias("reposts_repost"),
            tl.chunk_label("chunk_id", p.first_label, p.later_label).alias("label")]
    if with_text:
        cols += [F.col("own_text_sorted").alias("posts_text_sorted"), F.col("own_text_random").alias("posts_text_random"),
                 F.col("other_text_sorted").alias("reposts_text_sorted"),
                 F.col("other_text_random").alias("reposts_text_random"),
                 F.col("own_n_kept").alias("posts_n_kept"), F.col("other_n_kept").alias("reposts_n_kept"),
                 F.col("flag_text")]
    if with_text and distance is not None:
        cols += [F.col("own_text_ranked").alias("posts_text_ranked"), F.col("other_text_ranked").alias("reposts_text_ranked"),
                 F.col("own_n_ranked").alias("posts_n_ranked"), F.col("other_n_ranked").alias("reposts_n_ranked")]
    return out.select(*cols)


def encode_record(features: DataFrame, key: Sequence[str], text_form: str = "sorted", max_len: int = 512,
                  embed: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole record (V1, V2, V5, V7), and the vocabulary of its texts.

    ``text_form`` (sorted, random or ranked) picks the chunk texts. Adds ``posts_tokenized`` and
    ``reposts_tokenized`` (ids between the special ones, at most ``max_len``), ``flag_posts_tokenized``
    (the flagged post, whole) and, with ``embed`` (a vector of a text column), ``posts_embedding`` and
    ``reposts_embedding``. ``key`` names non-null columns that identify a record.

    The records are written once (reliable checkpoint): they feed the vocabulary, the encoding and
    the result. The vocabulary is joined by token, so a hot token can be split; nothing is collected."""
    if text_form not in ("sorted", "random", "ranked"):
        raise ValueError(f"unknown text form {text_form!r}")
    ensure_checkpoint_dir(features.sparkSession)
    rows = features.checkpoint(eager=True)
    source = {"posts": f"posts_text_{text_form}", "reposts": f"reposts_text_{text_form}", "flag_posts": "flag_text"}
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.col(c).alias("text")) for k, c in source.items()]))
    texts = rows.select(F.struct(*key).alias("_key"), parts.alias("_p"))
    tokens = texts.select(F.struct("_key", "_p.part").alias("_id"), D.tokenize("_p.text").alias("tokens"))
    vocab, ids = D.vocabulary_and_ids(tokens, "_id", "tokens")
    folded = ids.groupBy("_id._key").agg(*[F.max(F.when(F.col("_id.part") == k, F.col("ids"))).alias(f"_{k}") for k in source])
    shaped = [*[F.col(f"_key.{k}").alias(k) for k in key],
              *[D.truncate_tokens(f"_{k}", max_len).alias(f"{k}_tokenized") for k in ("posts", "reposts")],
              D.with_specials("_flag_posts").alias("flag_posts_tokenized")]
    out = rows.join(folded.select(*shaped), list(key))
    if embed is not None:
        out = (out.withColumn("posts_embedding", embed(F.col(source["posts"])))
               .withColumn("reposts_embedding", embed(F.col(source["reposts"]))))
    return out, vocab
