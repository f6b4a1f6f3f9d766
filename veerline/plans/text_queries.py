"""Text cleaning queries (C1-C12, P1-P4, P6, S2) on ``documents``, ``pages``, ``conversations``
and ``lineitem``.

The driver's documents hold almost no mentions, URLs, hashtags, emoji or entities, so each query
composes its input from the real text plus markers that hit the traps (URL ending at kana, Unicode
hashtags, 'RT ' inside 'START ', '&amp;lt;', U+3000 and U+00A0 at the ends, emoji sequences).
The lexicon, keyword and promotion lists below are parameters of these fixture queries; they are
fragments that occur in the fixture text, not anyone's production lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veerline.functions import text as T
from veerline.plans.registry import register
from veerline.sources.tables import read_table

LEXICON = ["ment", "en", "tion", "ie", "th", "er", "st", "ou"]
KEYWORDS = ["zum", "the", "que", "die", "le "]
STRIP_WORDS = ["ing", "ung", "eau", "ion", "in"]
PROMOTIONS = ["Ee", "aux.", "ly ", "(x)"]


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_remove_words(expr: str, words) -> str:
    for w in words:
        expr = f"replace({expr}, {_sql_str(w)}, '')"
    return expr


def sql_regex(expr: str, pattern: str, repl: str = "''") -> str:
    return f"regexp_replace({expr}, {_sql_str(pattern)}, {repl}, 'g')"


def sql_entities(expr: str) -> str:
    for src, dst in T.ENTITIES:
        expr = f"replace({expr}, {_sql_str(src)}, {_sql_str(dst)})"
    return f"replace({expr}, {_sql_str(T.IDEOGRAPHIC_SPACE)}, ' ')"


def sql_clean(expr: str, lexicon) -> str:
    e = sql_remove_words(f"coalesce({expr}, '')", lexicon)
    e = sql_regex(e, T.MENTION_PATTERN)
    e = sql_regex(e, T.URL_PATTERN)
    e = sql_regex(e, T.HASHTAG_PATTERN)
    e = f"replace({e}, {_sql_str(T.RT_MARKER)}, '')"
    e = sql_regex(e, T.EMOJI_PATTERN)
    e = sql_regex(e, r"\n+", "chr(10)")
    e = sql_regex(e, T.STRIP_PATTERN)
    return sql_entities(e)


# Composed input: real text framed by the markers. Emoji differ by language.
_EMOJI_BY_LANG = {"en": "😀", "fr": "👍🏽", "de": "👨‍👩‍👧", "es": "#️⃣🇯🇵©"}


def composed_text(text: Column, doc_id: Column, lang: Column) -> Column:
    emoji = F.coalesce(*[F.when(lang == k, F.lit(v)) for k, v in _EMOJI_BY_LANG.items()], F.lit("✨"))
    d = doc_id.cast("string")
    return F.concat(F.lit("　RT @u_"), d, F.lit(" "), text, F.lit(" https://t.example/p?q="), d,
                    F.lit("あ c #tag_"), d, F.lit(" #タグ_1 x START &amp;lt;b&amp;gt; &quot;q&quot;\n\n\n"),
                    emoji, F.lit(" end&nbsp; "))


def _sql_emoji_case() -> str:
    whens = " ".join(f"when {_sql_str(k)} then {_sql_str(v)}" for k, v in _EMOJI_BY_LANG.items())
    return f"coalesce(case lang {whens} end, '✨')"


SQL_COMPOSED = (f"concat('　RT @u_', cast(doc_id as varchar), ' ', text, ' https://t.example/p?q=', "
                f"cast(doc_id as varchar), 'あ c #tag_', cast(doc_id as varchar), "
                f"' #タグ_1 x START &amp;lt;b&amp;gt; &quot;q&quot;' || chr(10) || chr(10) || chr(10), "
                f"{_sql_emoji_case()}, ' end&nbsp;' || chr(160))")


def documents_composed(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", composed_text(F.col("text"), F.col("doc_id"), F.col("lang")).alias("raw"))


def _doc_sql(expr_of_raw: str) -> str:
    return f"select doc_id, {expr_of_raw} as out from (select doc_id, {SQL_COMPOSED} as raw from documents)"


def _step_query(name: str, fn, sql_expr: str):
    @register(name, sql=_doc_sql(sql_expr))
    def q(spark: SparkSession, sf: str) -> DataFrame:
        return documents_composed(spark, sf).select("doc_id", fn(F.col("raw")).alias("out"))
    q.__name__ = name
    return q


_step_query("remove_lexicon", lambda c: T.remove_words(c, LEXICON), sql_remove_words("raw", LEXICON))
_step_query("remove_mentions", T.remove_mentions, sql_regex("raw", T.MENTION_PATTERN))
_step_query("remove_urls", T.remove_urls, sql_regex("raw", T.URL_PATTERN))
_step_query("remove_hashtags", T.remove_hashtags, sql_regex("raw", T.HASHTAG_PATTERN))
_step_query("remove_rt_marker", T.remove_rt_marker, f"replace(raw, {_sql_str(T.RT_MARKER)}, '')")
_step_query("remove_emoji", T.remove_emoji, sql_regex("raw", T.EMOJI_PATTERN))
_step_query("collapse_newlines", T.collapse_newlines, sql_regex("raw", r"\n+", "chr(10)"))
_step_query("unicode_strip", T.unicode_strip, sql_regex("raw", T.STRIP_PATTERN))
_step_query("clean_text", lambda c: T.clean_text(c, LEXICON), sql_clean("raw", LEXICON))


@register("decode_entities", sql=f"select page_id, {sql_entities('html')} as out from pages")
def decode_entities(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages").select("page_id", T.decode_entities("html").alias("out"))


@register("strip_keywords", sql=f"select conv_id, turn, {sql_remove_words('text', STRIP_WORDS)} as out from conversations")
def strip_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """C11: opinion phrases removed in list order from each sentence (here: each turn)."""
    c = read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.remove_words("text", STRIP_WORDS).alias("out"))


_SQL_ANY = " or ".join(f"contains(text, {_sql_str(w)})" for w in KEYWORDS)


@register("contains_any", sql=f"select doc_id, ({_SQL_ANY}) as hit from documents")
def contains_any(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", T.contains_any("text", KEYWORDS).alias("hit"))


_SQL_FIRST = "case " + " ".join(f"when contains(text, {_sql_str(w)}) then {_sql_str(w)}" for w in KEYWORDS) + " end"
_SQL_FLAG_TURN = "(select conv_id, min(turn) as flag_turn from conversations where role = 'user' group by conv_id)"


@register("keyword_match", sql=f"""
select c.conv_id, c.turn as flag_turn, {_SQL_FIRST} as keyword
from conversations c join {_SQL_FLAG_TURN} f on c.conv_id = f.conv_id and c.turn = f.flag_turn
where {_SQL_ANY.replace('text', 'c.text')}
""")
def keyword_match(spark: SparkSession, sf: str) -> DataFrame:
    """Keep the account when its flagged text contains a keyword; report the first one."""
    flags = conversation_flags(spark, sf)
    return (flags.where(T.contains_any("flag_text", KEYWORDS))
            .select("conv_id", "flag_turn", T.first_keyword("flag_text", KEYWORDS).alias("keyword")))


@register("skip_empty_flag", sql=f"""
select c.conv_id, c.turn as flag_turn, length(c.text)::int as flag_len
from conversations c join {_SQL_FLAG_TURN} f on c.conv_id = f.conv_id and c.turn = f.flag_turn
where length(c.text) > 0
""")
def skip_empty_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts whose flagged text is empty (or null) are skipped."""
    flags = conversation_flags(spark, sf)
    return (flags.where(F.length("flag_text") > 0)
            .select("conv_id", "flag_turn", F.length("flag_text").alias("flag_len")))


def conversation_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Flag of a conversation = its first user turn (one row per conversation)."""
    c = read_table(spark, sf, "conversations")
    first = c.where(F.col("role") == "user").groupBy("conv_id").agg(F.min("turn").alias("flag_turn"))
    return first.join(c.select("conv_id", F.col("turn").alias("flag_turn"), F.col("text").alias("flag_text")),
                      ["conv_id", "flag_turn"])


_SQL_PROMO = "|".join(__import__("re").escape(w) for w in PROMOTIONS)


@register("exclude_promotions", sql=f"""
select doc_id, out from (select doc_id, {sql_clean('text', LEXICON)} as out from documents)
where not regexp_matches(out, {_sql_str(_SQL_PROMO)})
""")
def exclude_promotions(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose cleaned text matches a promotion word are dropped (after cleaning)."""
    d = read_table(spark, sf, "documents").select("doc_id", T.clean_text("text", LEXICON).alias("out"))
    return d.where(~T.matches_any_regex("out", PROMOTIONS))


@register("normalise_handle", sql="""
select conv_id, turn, replace(concat('@', role, '@', cast(conv_id as varchar)), '@', '') as account_name
from conversations
""")
def normalise_handle(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "conversations")
    handle = F.concat(F.lit("@"), F.col("role"), F.lit("@"), F.col("conv_id").cast("string"))
    return c.select("conv_id", "turn", T.normalise_handle(handle).alias("account_name"))


def abbrev_strings(li: DataFrame) -> DataFrame:
    """Abbreviated counts built from integers: 'q.dK', 'q.dM', 'p.ccK' and plain 'q'."""
    q = F.col("l_quantity").cast("bigint")
    cents = F.floor(F.col("l_extendedprice") * 100)
    fmt = (F.when(F.col("l_linenumber") % 4 == 0,
                  F.concat((q / 10).cast("bigint").cast("string"), F.lit("."), (q % 10).cast("string"), F.lit("K")))
           .when(F.col("l_linenumber") % 4 == 1,
                 F.concat((q / 10).cast("bigint").cast("string"), F.lit("."), (q % 10).cast("string"), F.lit("M")))
           .when(F.col("l_linenumber") % 4 == 2,
                 F.concat(F.floor(cents / 100).cast("string"), F.lit("."),
                          F.lpad((cents % 100).cast("string"), 2, "0"), F.lit("K")))
           .otherwise(q.cast("string")))
    return li.select("l_orderkey", "l_linenumber", fmt.alias("s"))


@register("parse_abbrev_count", sql="""
with s as (
  select l_orderkey, l_linenumber,
    case when l_linenumber % 4 = 0 then concat(cast(cast(l_quantity as bigint) // 10 as varchar), '.', cast(cast(l_quantity as bigint) % 10 as varchar), 'K')
         when l_linenumber % 4 = 1 then concat(cast(cast(l_quantity as bigint) // 10 as varchar), '.', cast(cast(l_quantity as bigint) % 10 as varchar), 'M')
         when l_linenumber % 4 = 2 then concat(cast(cast(floor(floor(l_extendedprice * 100) / 100) as bigint) as varchar), '.',
                                               lpad(cast(cast(floor(l_extendedprice * 100) as bigint) % 100 as varchar), 2, '0'), 'K')
         else cast(cast(l_quantity as bigint) as varchar) end as s
  from lineitem)
select l_orderkey, l_linenumber, s,
  case when contains(s, 'K') then cast(trunc(cast(left(s, length(s) - 1) as double) * 1000.0) as bigint)
       when contains(s, 'M') then cast(trunc(cast(left(s, length(s) - 1) as double) * 1000000.0) as bigint)
       else cast(s as bigint) end as n
from s
""")
def parse_abbrev_count(spark: SparkSession, sf: str) -> DataFrame:
    s = abbrev_strings(read_table(spark, sf, "lineitem"))
    return s.select("l_orderkey", "l_linenumber", "s", T.parse_abbrev_count("s").alias("n"))


@register("account_from_path", sql="""
select doc_id, split_part(split_part(concat('file:///data/users/', source, '.', lang, '.csv'), '/', -1), '.', 1) as account
from documents
""")
def account_from_path(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    path = F.concat(F.lit("file:///data/users/"), F.col("source"), F.lit("."), F.col("lang"), F.lit(".csv"))
    return d.select("doc_id", T.account_from_path(path).alias("account"))
