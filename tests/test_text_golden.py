"""Golden strings for the cleaning rules, counts, thresholds and budgets."""

import pytest
from pyspark.sql import functions as F

from veerline.functions import text as T
from veerline.operators import docs as D
from veerline.operators import evaluate as E


def one(spark, col_expr, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(col_expr.alias("o")).first()["o"]


@pytest.mark.parametrize("raw,expected", [("1.2K", 1200), ("32.3K", 32299), ("64.1K", 64099), ("57", 57),
                                          ("3M", 3000000), ("1.5M", 1500000)])
def test_abbrev_counts(spark, raw, expected):
    assert one(spark, T.parse_abbrev_count("s"), raw) == expected


@pytest.mark.parametrize("p,expected", [(0.5, 0), (0.51, 1), (1.5, 2), (2.5, 2), (0.49, 0)])
def test_half_even_threshold(spark, p, expected):
    assert one(spark, E.threshold_prediction("s"), p, "s double") == expected


def test_ordered_removal(spark):
    assert one(spark, T.remove_words("s", ["AI", "DX"]), "DAIX") == ""
    assert one(spark, T.remove_words("s", ["DX", "AI"]), "DAIX") == "DX"


@pytest.mark.parametrize("fn,raw,expected", [
    (T.remove_rt_marker, "START x", "STAx"),
    (T.decode_entities, "&amp;lt;", "<"),
    (T.unicode_strip, "　a ", "a"),
    (T.unicode_strip, "\x1c\x1f a \x85", "a"),
    (T.remove_urls, "https://t.co/a?b=1あ c", "あ c"),
    (T.remove_urls, "see http://x.example/Ünï!z", "see !z"),
    (T.remove_hashtags, "#タグ_1 x", " x"),
    (T.remove_hashtags, "#é́x", "́x"),
    (T.remove_mentions, "hi @ab_C9 there @é", "hi  there @é"),
    (T.collapse_newlines, "a\n\n\nb\n", "a\nb\n"),
    (T.remove_emoji, "a😀b👍🏽c👨‍👩‍👧d", "abcd"),
    (T.remove_emoji, "#️⃣x🇯🇵y©z", "xyz"),
    (T.remove_emoji, "plain ✓ text 1", "plain ✓ text 1"),
])
def test_cleaning_steps(spark, fn, raw, expected):
    assert one(spark, fn("s"), raw) == expected


def test_strip_then_entity_keeps_blank(spark):
    assert one(spark, T.clean_text("s"), "a&nbsp;") == "a "


def test_clean_text_order(spark):
    # the lexicon runs first, so a word removal can complete a mention / URL
    assert one(spark, T.clean_text("s", ["XX"]), "@XXabc hello RT  &amp;amp;　") == "hello  &amp;"
    assert one(spark, T.clean_text("s"), None) == ""


def test_token_budget_stops_at_first_overflow(spark):
    # budget 5, costs 2, 2, 2, 1 -> only the first two are kept (no skipping ahead)
    rows = [(1, "a"), (2, "b"), (3, "c"), (4, "")]
    df = spark.createDataFrame(rows, "pos int, text string").withColumn("g", F.lit(0))
    df = df.union(spark.createDataFrame([(5, "d")], "pos int, text string").withColumn("g", F.lit(0)))
    marked = D.mark_budget(df, ["g"], "pos", "text", 5).orderBy("pos").collect()
    assert [r["kept"] for r in marked] == [True, True, False, False, False]
    assert [r["cost"] for r in marked] == [2, 2, 2, 0, 2]


def test_first_keyword_and_contains(spark):
    assert one(spark, T.first_keyword("s", ["zz", "b", "a"]), "abc") == "b"
    assert one(spark, T.first_keyword("s", ["zz"]), "abc") is None
    assert one(spark, T.contains_any("s", ["c", "q"]), "abc") is True
    assert one(spark, T.matches_any_regex("s", ["a.b", "(x)"]), "a.b") is True
    assert one(spark, T.matches_any_regex("s", ["a.b"]), "axb") is False


def test_pluggable_tokenizer_in_budget(spark):
    tok = D.tokenizer_udf(lambda texts: [t.split() for t in texts])
    df = spark.createDataFrame([(0, 1, "a b c"), (0, 2, "d e"), (0, 3, "f")], "g int, pos int, text string")
    marked = D.mark_budget(df, ["g"], "pos", "text", 6, n_tokens=F.size(tok(F.col("text"))))
    assert [r["kept"] for r in marked.orderBy("pos").collect()] == [True, False, False]


def test_emoji_trade_mark_and_text_symbols(spark):
    assert one(spark, T.remove_emoji("s"), "a™b↔c→d") == "abc→d"


def test_lexicon_gate_is_exact(spark):
    # no first character present -> untouched; a removal that creates a later match still works
    assert one(spark, T.remove_words("s", ["政策", "選挙"]), "plain text") == "plain text"
    assert one(spark, T.remove_words("s", ["AI", "DX"]), "DAIX and AI") == " and "
    assert one(spark, T.remove_words("s", ["xy", ""]), None) is None
