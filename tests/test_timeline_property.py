"""Random timelines: the Spark feature build equals a closed form over the whole table."""

import random

import pandas as pd
from pyspark.sql import functions as F

from veerline.plans import feature_build as FB

KEYWORDS = ("key",)
PROMOTIONS = ("sale",)
CHUNK, MAX_CHUNKS = 2, 3


NUMBERS = {"1.2K": 1200, "32.3K": 32299, "57": 57, "3M": 3000000, "0": 0, "5": 5, "1.5K": 1500, "2": 2}


def expected(rows):
    """Closed form over the whole table: ranks inside each side give chunks, chunk i meets min(i, last)."""
    t = pd.DataFrame(rows, columns=["account", "pos", "flag", "handle", "text", "likes", "reposts"])
    t["likes"], t["reposts"] = t.likes.map(NUMBERS), t.reposts.map(NUMBERS)
    last = t[t.flag == 1].groupby("account").pos.max().rename("at").reset_index()
    flags = t.merge(last, left_on=["account", "pos"], right_on=["account", "at"])
    flags = flags[flags.text.str.contains(KEYWORDS[0])][["account", "at", "handle"]].rename(columns={"handle": "owner"})
    after = t.merge(flags, on="account").query("pos > at")
    after = after[~after.text.str.contains(PROMOTIONS[0])].sort_values(["account", "pos"])
    after["own"] = after.handle == after.owner
    after["chunk"] = after.groupby(["account", "own"]).cumcount() // CHUNK
    sums = after.groupby(["account", "owner", "own", "chunk"], as_index=False)[["likes", "reposts"]].sum()
    own, other = sums[sums.own & (sums.chunk < MAX_CHUNKS)], sums[~sums.own]
    own = own.merge(other.groupby("account").chunk.max().rename("end").reset_index(), on="account")
    own["meets"] = own[["chunk", "end"]].min(axis=1)
    pairs = own.merge(other, left_on=["account", "meets"], right_on=["account", "chunk"], suffixes=("", "_o"))
    return sorted((r.owner.strip("@"), r.chunk, r.likes, r.likes_o, r.reposts, r.reposts_o, 3 if r.chunk else 1)
                  for r in pairs.itertuples())


def random_rows(seed: int):
    rnd = random.Random(seed)
    rows = []
    for a in range(150):
        n = rnd.randint(0, 25)
        handle = f"@u{a}"
        for pos in range(n):
            author = handle if rnd.random() < 0.5 else f"@o{rnd.randint(0, 3)}"
            text = rnd.choice(["key point", "key", "hello", "big sale", "", "more key", "plain"])
            likes = rnd.choice(["1.2K", "32.3K", "57", "3M", "0"])
            reposts = rnd.choice(["5", "1.5K", "2"])
            rows.append((f"a{a}", pos, int(rnd.random() < 0.12), author, text,
                         likes, reposts))
    return rows


def test_feature_build_matches_python(spark):
    for seed in (1, 2, 3):
        rows = random_rows(seed)
        df = spark.createDataFrame(rows, "account string, pos int, flag int, handle string, text string, "
                                         "likes string, reposts string").withColumn("is_flag", F.col("flag") == 1)
        cols = FB.TimelineColumns(flag="is_flag")
        params = FB.FeatureParams(keywords=KEYWORDS, promotions=PROMOTIONS, chunk_size=CHUNK, max_chunks=MAX_CHUNKS)
        got = sorted(tuple(r) for r in FB.build_features(df, cols, params, with_text=False)
                     .select("account_name", "chunk_id", "posts_like", "reposts_like", "posts_repost",
                             "reposts_repost", "label").collect())
        assert got and got == expected(rows), seed
