"""Flagship feature build on ``conversations`` (X1, X2) and the token / chunk-text queries
(V1-V5, W5, A2, T2).

Mapping: account = conv_id, order = turn, flag = the first user turn, handle = '@' || role || '_'
|| conv_id (own side = same handle as the flagged row, i.e. the user's turns), likes / reposts =
abbreviated count strings built from the text length and the turn. Chunks of 2 (conversations
have 2-8 turns), at most 3 chunks, token budget 64."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veerline.functions import text as T
from veerline.operators import docs as D
from veerline.operators import timeline as tl
from veerline.plans import feature_build as FB
from veerline.plans.registry import register
from veerline.plans.text_queries import KEYWORDS, LEXICON, PROMOTIONS, _sql_str, sql_clean
from veerline.sources.tables import read_table

CHUNK = 2
MAX_CHUNKS = 3
BUDGET = 64
SEED = 42


def conversation_timeline(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "conversations")
    first_user = c.where(F.col("role") == "user").groupBy("conv_id").agg(F.min("turn").alias("_first_user"))
    n = F.length("text")
    likes = F.concat((n / 10).cast("bigint").cast("string"), F.lit("."), (n % 10).cast("string"), F.lit("K"))
    reposts = F.when(F.col("role") == "user", F.concat(F.col("turn").cast("string"), F.lit("M"))).otherwise(n.cast("string"))
    return (c.join(first_user, "conv_id", "left")
            .select("conv_id", "turn", "text",
                    ((F.col("role") == "user") & (F.col("turn") == F.col("_first_user"))).alias("is_flag"),
                    F.concat(F.lit("@"), F.col("role"), F.lit("_"), F.col("conv_id").cast("string")).alias("handle"),
                    likes.alias("likes_raw"), reposts.alias("reposts_raw")))


COLUMNS = FB.TimelineColumns(account="conv_id", pos="turn", flag="is_flag", handle="handle", text="text",
                              likes="likes_raw", reposts="reposts_raw")


def params(keywords=KEYWORDS, first_label: int = 1, later_label: int = 3) -> FB.FeatureParams:
    return FB.FeatureParams(keywords=tuple(keywords), lexicon=tuple(LEXICON), promotions=tuple(PROMOTIONS),
                            chunk_size=CHUNK, max_chunks=MAX_CHUNKS, budget=BUDGET, first_label=first_label,
                            later_label=later_label, seed=SEED)


def conversation_flags(timeline: DataFrame, keywords=KEYWORDS) -> DataFrame:
    """W1 + P4 + P2 on the conversation timelines."""
    return FB.flagged_accounts(timeline, COLUMNS, keywords)


def path_account_handle() -> F.Column:
    """Non-changer variant: the account is the timeline file's base name (S2); handle = '@' + name."""
    path = F.concat(F.lit("file:///data/users/user_"), F.col("conv_id").cast("string"), F.lit(".csv"))
    return F.concat(F.lit("@"), T.account_from_path(path))


def conversation_chunks(spark: SparkSession, sf: str, keywords=KEYWORDS,
                        account_handle: F.Column | None = None) -> tuple[DataFrame, DataFrame]:
    """W2 -> P1 -> C10 -> P3 -> P5 -> W3/W4 on the conversation timelines."""
    return FB.chunk_rows(conversation_timeline(spark, sf), COLUMNS, params(keywords), account_handle)


def chunk_features(chunks: DataFrame, with_text: bool) -> DataFrame:
    """A1 (+ W5, A2, T2) per (conversation, side, chunk)."""
    return FB.chunk_aggregates(chunks, COLUMNS, params(), with_text)


def feature_rows(spark: SparkSession, sf: str, with_text: bool, first_label: int = 1,
                 later_label: int = 3, keywords=KEYWORDS, account_handle: F.Column | None = None) -> DataFrame:
    """X1 (+ X2) on the conversation timelines through the generic feature build."""
    out = FB.build_features(conversation_timeline(spark, sf), COLUMNS, params(keywords, first_label, later_label),
                            account_handle, with_text)
    return out.drop("conv_id")


# ------------------------------------------------------------------ DuckDB oracle building blocks
KEYWORDS_OTHERS = ["ein", "and", "los", "des "]


def _sql_any_flag(words) -> str:
    return " or ".join(f"contains(t.text, {_sql_str(w)})" for w in words)


_SQL_ANY_FLAG = _sql_any_flag(KEYWORDS)
_SQL_PROMO = "|".join(__import__("re").escape(w) for w in PROMOTIONS)


def _sql_parse(e: str) -> str:
    return (f"(case when contains({e}, 'K') then cast(trunc(cast(left({e}, length({e}) - 1) as double) * 1000.0) as bigint) "
            f"when contains({e}, 'M') then cast(trunc(cast(left({e}, length({e}) - 1) as double) * 1000000.0) as bigint) "
            f"else cast({e} as bigint) end)")


_SQL_TOKENS = f"regexp_extract_all(text, {_sql_str(D.TOKEN_PATTERN)})"

def sql_chunks(keywords=KEYWORDS, handle_sql: str | None = None) -> str:
    fl_handle = handle_sql if handle_sql is not None else "t.handle"
    return f"""
fu as (select conv_id, min(turn) as ft from conversations where role = 'user' group by conv_id),
tl as (select c.conv_id, c.turn, c.text, (c.role = 'user' and c.turn = fu.ft) as is_flag,
              concat('@', c.role, '_', cast(c.conv_id as varchar)) as handle,
              concat(cast(length(c.text) // 10 as varchar), '.', cast(length(c.text) % 10 as varchar), 'K') as likes_raw,
              case when c.role = 'user' then concat(cast(c.turn as varchar), 'M') else cast(length(c.text) as varchar) end as reposts_raw
       from conversations c left join fu on c.conv_id = fu.conv_id),
f as (select conv_id, max(case when is_flag then turn end) as flag_pos from tl group by conv_id),
fl as (select f.conv_id, f.flag_pos, t.text as flag_text, {fl_handle} as flag_handle
       from f join tl t on t.conv_id = f.conv_id and t.turn = f.flag_pos
       where length(t.text) > 0 and ({_sql_any_flag(keywords)})),
tail as (select t.conv_id, t.turn, {_sql_parse('t.likes_raw')} as likes, {_sql_parse('t.reposts_raw')} as reposts,
                {sql_clean('t.text', LEXICON)} as text, t.handle = fl.flag_handle as own
         from tl t join fl on t.conv_id = fl.conv_id where t.turn > fl.flag_pos),
kept as (select * from tail where not regexp_matches(text, {_sql_str(_SQL_PROMO)})),
p as (select *, row_number() over (partition by conv_id, own order by turn) - 1 as side_rank from kept),
ch as (select *, cast(floor(side_rank / {CHUNK}.0) as int) as chunk_id from p where side_rank < {CHUNK * MAX_CHUNKS}),
bud as (select *, len({_SQL_TOKENS}) as ntok,
               case when text <> '' then len({_SQL_TOKENS}) + 1 else 0 end as cost from ch),
mk as (select *, text <> '' and sum(cost) over (partition by conv_id, own, chunk_id order by turn
                 rows between unbounded preceding and current row) <= {BUDGET} as kept_flag from bud),
agg as (select conv_id, own, chunk_id, count(*) as n, cast(sum(likes) as bigint) as likes, cast(sum(reposts) as bigint) as reposts,
               coalesce(string_agg(text, '[SEP]' order by turn) filter (where kept_flag), '') as text_sorted,
               coalesce(string_agg(text, '[SEP]' order by md5(concat_ws('|', cast(conv_id as varchar), cast(own as varchar),
                        cast(chunk_id as varchar), cast(turn as varchar), '{SEED}'))) filter (where kept_flag), '') as text_random,
               count_if(kept_flag)::bigint as n_kept
        from mk group by 1, 2, 3),
o as (select * from agg where own),
r as (select * from agg where not own),
rm as (select conv_id, max(chunk_id) as last_chunk from r group by 1),
pairs as (select o.conv_id, o.chunk_id, o.likes as posts_like, r.likes as reposts_like, o.reposts as posts_repost,
                 r.reposts as reposts_repost, o.text_sorted as posts_text_sorted, o.text_random as posts_text_random,
                 r.text_sorted as reposts_text_sorted, r.text_random as reposts_text_random,
                 o.n_kept as posts_n_kept, r.n_kept as reposts_n_kept
          from o join rm on o.conv_id = rm.conv_id
                 join r on r.conv_id = o.conv_id and r.chunk_id = least(o.chunk_id, rm.last_chunk))
"""


SQL_CHUNKS = sql_chunks()

_SQL_X1_COLS = ("replace(fl.flag_handle, '@', '') as account_name, pairs.chunk_id, posts_like, reposts_like, "
                "posts_repost, reposts_repost, case when pairs.chunk_id = 0 then 1 else 3 end as label")


@register("timeline_features", sql=f"with {SQL_CHUNKS} select {_SQL_X1_COLS} from pairs join fl on pairs.conv_id = fl.conv_id")
def timeline_features(spark: SparkSession, sf: str) -> DataFrame:
    """W1 -> P2/P4 -> W2 -> P1 -> C10 -> P3 -> P5 -> J4 -> W3 -> W4 -> A1 -> J3 -> P6/P7."""
    return feature_rows(spark, sf, with_text=False)


_SQL_PATH_HANDLE = ("concat('@', split_part(split_part(concat('file:///data/users/user_', cast(t.conv_id as varchar), '.csv'), "
                    "'/', -1), '.', 1))")


@register("timeline_features_others", sql=f"""with {sql_chunks(KEYWORDS_OTHERS, _SQL_PATH_HANDLE)}
select replace(fl.flag_handle, '@', '') as account_name, pairs.chunk_id, posts_like, reposts_like, posts_repost,
       reposts_repost, case when pairs.chunk_id = 0 then 2 else 0 end as label
from pairs join fl on pairs.conv_id = fl.conv_id""")
def timeline_features_others(spark: SparkSession, sf: str) -> DataFrame:
    """X1, non-changer variant: account from the file name (S2), own = '@' + name, its own
    keyword list, labels 2 (chunk 0) and 0 (later chunks)."""
    return feature_rows(spark, sf, with_text=False, first_label=2, later_label=0,
                        keywords=KEYWORDS_OTHERS, account_handle=path_account_handle())


@register("chunk_documents", sql=f"""with {SQL_CHUNKS} select {_SQL_X1_COLS}, posts_text_sorted, posts_text_random,
reposts_text_sorted, reposts_text_random, posts_n_kept, reposts_n_kept, fl.flag_text
from pairs join fl on pairs.conv_id = fl.conv_id""")
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    """X1's rows with the budgeted chunk texts of both sides, in order and shuffled, and the
    flagged post copied to every record (J5)."""
    return feature_rows(spark, sf, with_text=True)


@register("token_budget_prefix", sql=f"with {SQL_CHUNKS} select conv_id, own, chunk_id, turn, cost::int as cost, kept_flag as kept from mk")
def token_budget_prefix(spark: SparkSession, sf: str) -> DataFrame:
    chunks, _ = conversation_chunks(spark, sf)
    marked = D.mark_budget(chunks, ["conv_id", "own", "chunk_id"], "turn", "text", BUDGET)
    return marked.select("conv_id", "own", "chunk_id", "turn", "cost", "kept")


@register("chunk_text", sql=f"with {SQL_CHUNKS} select conv_id, own, chunk_id, text_sorted, n_kept from agg")
def chunk_text(spark: SparkSession, sf: str) -> DataFrame:
    chunks, _ = conversation_chunks(spark, sf)
    return chunk_features(chunks, True).select("conv_id", "own", "chunk_id", "text_sorted", "n_kept")


@register("shuffle_sentences", sql=f"with {SQL_CHUNKS} select conv_id, own, chunk_id, text_random from agg")
def shuffle_sentences(spark: SparkSession, sf: str) -> DataFrame:
    chunks, _ = conversation_chunks(spark, sf)
    return chunk_features(chunks, True).select("conv_id", "own", "chunk_id", "text_random")


# ------------------------------------------------------------------ tokens on documents
def doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", D.tokenize("text").alias("tokens"))


def doc_vocab_and_ids(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return D.vocabulary_and_ids(doc_tokens(spark, sf), "doc_id", "tokens")


def _ids_text(c) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


_SQL_VOCAB = f"""
toks as (select doc_id, {_SQL_TOKENS} as tokens from documents),
vocab as (select token, row_number() over (order by md5(token), token) + 3 as token_id
          from (select distinct unnest(tokens) as token from toks)),
ex as (select doc_id, unnest(tokens) as token, generate_subscripts(tokens, 1) as p from toks),
enc as (select ex.doc_id, list(coalesce(v.token_id, 1) order by ex.p) as ids
        from ex left join vocab v on ex.token = v.token group by ex.doc_id),
ids as (select d.doc_id, coalesce(enc.ids, []::bigint[]) as ids from documents d left join enc on d.doc_id = enc.doc_id)
"""


@register("tokenize_text", sql=f"""
select doc_id, len({_SQL_TOKENS})::int as n_tokens, array_to_string({_SQL_TOKENS}, '|') as tokens_text from documents
""")
def tokenize_text(spark: SparkSession, sf: str) -> DataFrame:
    t = doc_tokens(spark, sf)
    return t.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", "|").alias("tokens_text"))


@register("build_vocabulary", sql=f"with {_SQL_VOCAB} select token, token_id from vocab")
def build_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    vocab, _ = doc_vocab_and_ids(spark, sf)
    return vocab.select("token", F.col("token_id").cast("bigint"))


@register("encode_tokens", sql=f"with {_SQL_VOCAB} select doc_id, len(ids)::int as n_ids, array_to_string(ids, ',') as ids_text from ids")
def encode_tokens(spark: SparkSession, sf: str) -> DataFrame:
    _, ids = doc_vocab_and_ids(spark, sf)
    return ids.select("doc_id", F.size("ids").alias("n_ids"), _ids_text(F.col("ids")).alias("ids_text"))


MAX_IDS = 512
_SQL_TRUNC = f"list_concat([2::bigint], ids[1:{MAX_IDS - 2}], [3::bigint])"


@register("truncate_tokens", sql=f"""with {_SQL_VOCAB}
select doc_id, len({_SQL_TRUNC})::int as n_ids, array_to_string({_SQL_TRUNC}, ',') as ids_text from ids""")
def truncate_tokens(spark: SparkSession, sf: str) -> DataFrame:
    _, ids = doc_vocab_and_ids(spark, sf)
    t = D.truncate_tokens("ids", MAX_IDS)
    return ids.select("doc_id", F.size(t).alias("n_ids"), _ids_text(t).alias("ids_text"))


_SQL_WHOLE = "list_concat([2::bigint], ids, [3::bigint])"


@register("attention_mask", sql=f"""with {_SQL_VOCAB},
padded as (select doc_id, list_concat({_SQL_WHOLE}, list_transform(range(greatest({MAX_IDS} - len({_SQL_WHOLE}), 0)), lambda x: 0::bigint)) as p from ids)
select doc_id, array_to_string(list_transform(p, lambda x: case when x in (0, 3) then '0' else '1' end), '') as mask from padded""")
def attention_mask(spark: SparkSession, sf: str) -> DataFrame:
    _, ids = doc_vocab_and_ids(spark, sf)
    t = D.with_specials("ids")
    padded = F.concat(t, F.array_repeat(F.lit(D.PAD_ID).cast("bigint"), F.greatest(F.lit(MAX_IDS) - F.size(t), F.lit(0))))
    mask = D.attention_mask(padded)
    return ids.select("doc_id", F.array_join(F.transform(mask, lambda b: F.when(b, "1").otherwise("0")), "").alias("mask"))


@register("decode_tokens", sql=f"""with {_SQL_VOCAB},
tr as (select doc_id, {_SQL_WHOLE} as t from ids),
full_vocab as (select token, token_id from vocab union all
               select * from (values ('[PAD]', 0), ('[UNK]', 1), ('[CLS]', 2), ('[SEP]', 3)) v(token, token_id)),
ex2 as (select doc_id, unnest(t) as token_id, generate_subscripts(t, 1) as p from tr),
pieces as (select ex2.doc_id, ex2.p,
  replace(replace(replace(replace(replace(replace(replace(coalesce(fv.token, ''), '##', ''), '[CLS]', ''), '<s>', ''),
          '[UNK]', ''), '<unk>', ''), '[SEP]', ' '), '</s>', ' ') as piece
  from ex2 left join full_vocab fv on ex2.token_id = fv.token_id)
select tr.doc_id, coalesce(string_agg(piece, '' order by p), '') as decoded
from tr left join pieces on tr.doc_id = pieces.doc_id group by tr.doc_id""")
def decode_tokens(spark: SparkSession, sf: str) -> DataFrame:
    vocab, ids = doc_vocab_and_ids(spark, sf)
    return D.decode_pieces(ids.select("doc_id", D.with_specials("ids").alias("t")), "doc_id", "t", vocab)


# ------------------------------------------------------------------ X2, ranked variant
def ranked_chunk_texts(spark: SparkSession, sf: str) -> DataFrame:
    """C11 -> W5 -> V6 -> T4 -> A2: opinion phrases stripped from each sentence, the chunk
    budgeted, kept sentences ordered by cosine distance to the flagged text (letter-count
    vectors), joined."""
    from veerline.operators import vectors as V
    from veerline.plans.text_queries import STRIP_WORDS
    chunks, _ = conversation_chunks(spark, sf)
    stripped = chunks.withColumn("text", T.remove_words("text", STRIP_WORDS))
    marked = D.mark_budget(stripped, ["conv_id", "own", "chunk_id"], "turn", "text", BUDGET)
    scored = marked.withColumn("distance", F.round(V.cosine_distance(V.letter_counts("text"), V.letter_counts("flag_text")), 6))
    return (scored.groupBy("conv_id", "own", "chunk_id")
            .agg(D.ranked_text_agg("distance", "turn", "text"), F.count_if("kept").alias("n_kept")))


def _sql_letters(e: str) -> str:
    return "[" + ", ".join(f"(length({e}) - length(replace({e}, '{c}', '')))::double" for c in "abcdefghijklmnopqrstuvwxyz") + "]"


def _sql_ranked() -> str:
    from veerline.plans.text_queries import STRIP_WORDS, sql_remove_words
    st = sql_remove_words("text", STRIP_WORDS)
    return f"""
fu as (select conv_id, min(turn) as ft from conversations where role = 'user' group by conv_id),
tl as (select c.conv_id, c.turn, c.text, (c.role = 'user' and c.turn = fu.ft) as is_flag,
              concat('@', c.role, '_', cast(c.conv_id as varchar)) as handle
       from conversations c left join fu on c.conv_id = fu.conv_id),
f as (select conv_id, max(case when is_flag then turn end) as flag_pos from tl group by conv_id),
fl as (select f.conv_id, f.flag_pos, t.text as flag_text, t.handle as flag_handle
       from f join tl t on t.conv_id = f.conv_id and t.turn = f.flag_pos
       where length(t.text) > 0 and ({_SQL_ANY_FLAG})),
tail as (select t.conv_id, t.turn, {sql_clean('t.text', LEXICON)} as text, t.handle = fl.flag_handle as own, fl.flag_text
         from tl t join fl on t.conv_id = fl.conv_id where t.turn > fl.flag_pos),
kept as (select * from tail where not regexp_matches(text, {_sql_str(_SQL_PROMO)})),
p as (select *, row_number() over (partition by conv_id, own order by turn) - 1 as side_rank from kept),
ch as (select conv_id, turn, own, flag_text, {st} as text, cast(floor(side_rank / {CHUNK}.0) as int) as chunk_id
       from p where side_rank < {CHUNK * MAX_CHUNKS}),
bud as (select *, case when text <> '' then len({_SQL_TOKENS}) + 1 else 0 end as cost from ch),
mk as (select *, text <> '' and sum(cost) over (partition by conv_id, own, chunk_id order by turn
                 rows between unbounded preceding and current row) <= {BUDGET} as kept_flag,
              {_sql_letters('text')} as va, {_sql_letters('flag_text')} as vb from bud),
sc as (select *, case when sqrt(list_dot_product(va, va)) * sqrt(list_dot_product(vb, vb)) <> 0 then
                 round(1 - list_dot_product(va, vb) / (sqrt(list_dot_product(va, va)) * sqrt(list_dot_product(vb, vb))), 6) + 0.0 end as distance
       from mk)
select conv_id, own, chunk_id,
       coalesce(string_agg(text, '[SEP]' order by distance nulls last, turn) filter (where kept_flag), '') as text_ranked,
       count_if(kept_flag)::bigint as n_kept
from sc group by 1, 2, 3"""


@register("chunk_documents_ranked", sql="with " + _sql_ranked())
def chunk_documents_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """X2 ranked variant (C11 -> W5 -> V6 -> T4 -> A2) per (account, side, chunk)."""
    return ranked_chunk_texts(spark, sf)


@register("letter_embedding", sql=f"select doc_id, {_sql_letters('text')} as embedding from documents")
def letter_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """V7 with the letter-count embedder (an engine-independent stand-in for a model)."""
    from veerline.operators import vectors as V
    return read_table(spark, sf, "documents").select("doc_id", V.letter_counts("text").alias("embedding"))


# ------------------------------------------------------------------ the whole feature record
def _sql_record() -> str:
    from veerline.plans.registry import ORACLE
    return f"""
with feat as ({ORACLE["chunk_documents"]}), rk as ({ORACLE["chunk_documents_ranked"]}),
last as (select conv_id, max(chunk_id) as m from rk where not own group by conv_id),
rec as (select f.*, o.text_ranked as posts_text_ranked, t.text_ranked as reposts_text_ranked
        from feat f join rk o on o.own and concat('user_', o.conv_id::varchar) = f.account_name and o.chunk_id = f.chunk_id
        join last l on l.conv_id = o.conv_id
        join rk t on not t.own and t.conv_id = o.conv_id and t.chunk_id = least(f.chunk_id, l.m)),
texts as (select account_name, chunk_id, unnest(['posts', 'reposts', 'flag']) as part,
                 unnest([posts_text_ranked, reposts_text_ranked, flag_text]) as text from rec),
toks as (select account_name, chunk_id, part, {_SQL_TOKENS} as tokens from texts),
vocab as (select token, row_number() over (order by md5(token), token) + 3 as token_id
          from (select distinct unnest(tokens) as token from toks)),
ex as (select account_name, chunk_id, part, unnest(tokens) as token, generate_subscripts(tokens, 1) as p from toks),
enc as (select account_name, chunk_id, part, list(v.token_id order by ex.p) as ids
        from ex join vocab v on ex.token = v.token group by account_name, chunk_id, part),
pick as (select account_name, chunk_id, max(case when part = 'posts' then ids end) as posts,
                max(case when part = 'reposts' then ids end) as reposts, max(case when part = 'flag' then ids end) as flag
         from enc group by account_name, chunk_id)
select r.account_name, r.chunk_id, r.label, r.posts_like, r.reposts_like, r.posts_repost, r.reposts_repost,
       r.posts_text_ranked, r.reposts_text_ranked, r.flag_text,
       list_concat([2::bigint], list_slice(coalesce(p.posts, []::bigint[]), 1, 510), [3::bigint]) as posts_tokenized,
       list_concat([2::bigint], list_slice(coalesce(p.reposts, []::bigint[]), 1, 510), [3::bigint]) as reposts_tokenized,
       list_concat([2::bigint], coalesce(p.flag, []::bigint[]), [3::bigint]) as flag_posts_tokenized,
       {_sql_letters("r.posts_text_ranked")} as posts_embedding, {_sql_letters("r.reposts_text_ranked")} as reposts_embedding
from rec r left join pick p on p.account_name = r.account_name and p.chunk_id = r.chunk_id"""


@register("feature_record", sql=_sql_record())
def feature_record(spark: SparkSession, sf: str) -> DataFrame:
    """The whole record: X1, ranked texts (C11 -> W5 -> V6 -> T4 -> A2), token ids of both sides and of the
    flagged post with the vocabulary of the same rows (V1, V2, V5), and vectors (V7, letter counts)."""
    from veerline.operators import vectors as V
    from veerline.plans.text_queries import STRIP_WORDS
    rows = FB.build_features(
        conversation_timeline(spark, sf), COLUMNS, replace(params(), strip_words=tuple(STRIP_WORDS)),
        distance=lambda text, flag: F.round(V.cosine_distance(V.letter_counts(text), V.letter_counts(flag)), 6))
    record, _ = FB.encode_record(rows, ["account_name", "chunk_id"], "ranked", embed=V.letter_counts)
    return record.select("account_name", "chunk_id", "label", *[f"{s}_{c}" for c in ("like", "repost") for s in ("posts", "reposts")],
                         "posts_text_ranked", "reposts_text_ranked", "flag_text", "posts_tokenized", "reposts_tokenized",
                         "flag_posts_tokenized", "posts_embedding", "reposts_embedding")


# ------------------------------------------------------------------ V3, flagged post decoded whole
def flag_ids(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Token ids of each conversation's flagged turn ([CLS] ... [SEP], whole) and the
    vocabulary of those texts."""
    flags = conversation_flags(conversation_timeline(spark, sf), keywords=[""])
    toks = flags.select("conv_id", D.tokenize("flag_text").alias("tokens"))
    vocab, ids = D.vocabulary_and_ids(toks, "conv_id", "tokens")
    return vocab, ids.select("conv_id", D.with_specials("ids").alias("ids"))


_SQL_FLAG_VOCAB = f"""
fu as (select conv_id, min(turn) as ft from conversations where role = 'user' group by conv_id),
fl as (select c.conv_id, c.text from conversations c join fu on c.conv_id = fu.conv_id and c.turn = fu.ft
       where length(c.text) > 0),
toks as (select conv_id, {_SQL_TOKENS} as tokens from fl),
vocab as (select token, row_number() over (order by md5(token), token) + 3 as token_id
          from (select distinct unnest(tokens) as token from toks)),
full_vocab as (select token, token_id from vocab union all
               select * from (values ('[PAD]', 0), ('[UNK]', 1), ('[CLS]', 2), ('[SEP]', 3)) v(token, token_id)),
ex as (select conv_id, unnest(tokens) as token, generate_subscripts(tokens, 1) as p from toks),
enc as (select ex.conv_id, list(coalesce(v.token_id, 1) order by ex.p) as ids
        from ex left join vocab v on ex.token = v.token group by ex.conv_id),
ids as (select t.conv_id, list_concat([2::bigint], coalesce(enc.ids, []), [3::bigint]) as ids
        from toks t left join enc on t.conv_id = enc.conv_id),
ex2 as (select conv_id, unnest(ids) as token_id, generate_subscripts(ids, 1) as p from ids)
"""


@register("decode_flag_tokens", sql=f"""with {_SQL_FLAG_VOCAB}
select ex2.conv_id, replace(string_agg(coalesce(fv.token, ''), ' ' order by ex2.p), ' ##', '') as decoded
from ex2 left join full_vocab fv on ex2.token_id = fv.token_id group by ex2.conv_id""")
def decode_flag_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """V3 (flagged post): ids decoded whole, special tokens kept."""
    vocab, ids = flag_ids(spark, sf)
    return D.decode_whole(ids, "conv_id", "ids", vocab)
