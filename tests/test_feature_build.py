"""The generic feature build on a hand-made timeline with the original's column names."""

from pyspark.sql import functions as F

from veerline.plans import feature_build as FB


def test_build_features_end_to_end(spark):
    rows = [
        # account a: flag at 1 holds a keyword; after it: own, other, own, other(promotion), own
        ("a", 0, 0, "@a", "before", "1", "0"),
        ("a", 1, 1, "@a", "I changed my mind", "2", "0"),
        ("a", 2, 0, "@a", "own one @x", "1.2K", "3"),
        ("a", 3, 0, "@b", "other one", "57", "1M"),
        ("a", 4, 0, "@a", "own two", "32.3K", "2"),
        ("a", 5, 0, "@c", "big sale today", "9", "9"),
        ("a", 6, 0, "@a", "own three", "1", "1"),
        # account z: flagged post without keyword -> skipped
        ("z", 0, 1, "@z", "nothing here", "1", "1"), ("z", 1, 0, "@z", "x", "1", "1"), ("z", 2, 0, "@y", "y", "1", "1"),
    ]
    posts = spark.createDataFrame(rows, "Account string, Pos int, flag int, Handle string, Content string, "
                                        "Likes string, Retweets string").withColumn("is_flag", F.col("flag") == 1)
    cols = FB.TimelineColumns(account="Account", pos="Pos", flag="is_flag", handle="Handle", text="Content",
                              likes="Likes", reposts="Retweets")
    params = FB.FeatureParams(keywords=("changed",), promotions=("sale",), chunk_size=2, max_chunks=3, budget=512)
    out = FB.build_features(posts, cols, params).orderBy("chunk_id").collect()
    assert [r["account_name"] for r in out] == ["a", "a"]
    # own rows 2, 4 | 6 -> chunks 0, 1; the only other row left (3) is chunk 0, carried forward
    assert [(r["chunk_id"], r["posts_like"], r["reposts_like"], r["posts_repost"], r["reposts_repost"], r["label"])
            for r in out] == [(0, 1200 + 32299, 57, 5, 1000000, 1), (1, 1, 57, 1, 1000000, 3)]
    assert out[0]["posts_text_sorted"] == "own one[SEP]own two"
    assert sorted(out[0]["posts_text_random"].split("[SEP]")) == ["own one", "own two"]
    assert out[1]["reposts_text_sorted"] == "other one"
    assert out[0]["flag_text"] == "I changed my mind"
