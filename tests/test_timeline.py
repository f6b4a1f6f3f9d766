"""Timeline operators on hand-made timelines and on the events fixture."""

from pyspark.sql import functions as F

from veerline.operators import timeline as tl
from veerline.plans import timeline_queries as TQ
from tests.conftest import SF_MID, SF_SMALL


def timeline(spark):
    # account a: flags at 1 and 3 (last = 3); own = handle 'a'
    rows = [("a", 0, False, "a", 1.0), ("a", 1, True, "a", 2.0), ("a", 2, False, "x", 3.0), ("a", 3, True, "a", 4.0),
            ("a", 4, False, "a", 5.0), ("a", 5, False, "a", 6.0), ("a", 6, False, "x", 7.0), ("a", 7, False, "a", 8.0),
            ("a", 8, False, "a", 9.0),
            # account b: no flag -> skipped
            ("b", 0, False, "b", 1.0), ("b", 1, False, "y", 1.0),
            # account c: flag, but only own rows after it -> skipped by the both-sides rule
            ("c", 0, True, "c", 1.0), ("c", 1, False, "c", 1.0)]
    df = spark.createDataFrame(rows, "account string, pos int, is_flag boolean, handle string, v double")
    return df.withColumn("own", F.col("handle") == F.col("account"))


def pairs(df, chunk, rows_per_task=tl.DEFAULT_ROWS_PER_TASK):
    flags = tl.last_flag(df)
    tail = tl.tail_after_flag(df, flags, rows_per_task=rows_per_task, keep_salt=True)
    chunks = tl.chunk_sides(tail, chunk, 3)
    return tl.pair_carry_forward(tl.chunk_engagement(chunks, {"v": "v"}))


def test_last_flag_and_tail(spark):
    df = timeline(spark)
    flags = {r["account"]: r["flag_pos"] for r in tl.last_flag(df).collect()}
    assert flags == {"a": 3, "c": 0}
    tail = tl.tail_after_flag(df, tl.last_flag(df)).where(F.col("account") == "a").orderBy("pos")
    assert [r["pos"] for r in tail.collect()] == [4, 5, 6, 7, 8]


def test_carry_forward_pairs(spark):
    # own rows after the flag: 4,5,7,8 -> chunks of 1: 0,1,2 (3 is cut); other rows: 6 -> chunk 0
    got = sorted((r["chunk_id"], r["other_chunk_id"], r["own_v"], r["other_v"]) for r in pairs(timeline(spark), 1).collect())
    assert got == [(0, 0, 5.0, 7.0), (1, 0, 6.0, 7.0), (2, 0, 8.0, 7.0)]


def test_salting_does_not_change_results(spark):
    df = timeline(spark)
    plain = sorted(tuple(r) for r in pairs(df, 2).collect())
    salted = sorted(tuple(r) for r in pairs(df, 2, rows_per_task=2).collect())
    assert plain == salted and plain


def test_hot_account_is_split(spark):
    df = timeline(spark)
    hot = {r["account"]: r["_n_salt"] for r in tl.hot_accounts(tl.last_flag(df), rows_per_task=2).collect()}
    assert hot == {"a": 5}  # 9 rows / 2 per task


def test_events_salted_equals_plain(spark):
    base = TQ.events_timeline(spark, SF_MID)
    flags = TQ.events_flags(base)

    def run(rpt):
        tail = tl.tail_after_flag(base, flags, "user_id", "event_id", rows_per_task=rpt, keep_salt=True)
        ch = tl.chunk_sides(tail, 5, 3, "user_id", "own", "event_id")
        return sorted(tuple(r) for r in ch.select("user_id", "event_id", "chunk_id").collect())

    assert run(tl.DEFAULT_ROWS_PER_TASK) == run(7)


def test_partition_count_invariance(spark):
    results = []
    for n in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        results.append(sorted(tuple(r) for r in TQ.event_chunk_pairs(spark, SF_SMALL).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]
    assert len(results[0]) == 13


def test_rank_within_groups_splits_hot_groups(spark):
    rows = [("h", i * 3 % 1000) for i in range(1000)] + [("c", i) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, o int").withColumn("o", F.col("o") * 7 + 1)
    exact = tl.rank_within_groups(df, ["g"], "o", "r", rows_per_task=10**9)
    split = tl.rank_within_groups(df, ["g"], "o", "r", rows_per_task=37)
    a = sorted(tuple(r) for r in exact.collect())
    b = sorted(tuple(r) for r in split.collect())
    assert a == b
    h = sorted(r["r"] for r in split.where("g = 'h'").collect())
    assert h == list(range(1, 1001))


def test_clustered_positions_spread_over_ranges(spark):
    # ten far outliers: ranges of equal width would put nearly all rows into one
    rows = [("h", i) for i in range(2000)] + [("h", 10**9 + i * 10**7) for i in range(10)] + [("h", None), ("c", 5), (None, 7)]
    df = spark.createDataFrame(rows, "g string, o bigint").withColumn("k", F.xxhash64("o"))
    split = tl.rank_within_groups(df, ["g"], "o", "r", rows_per_task=100, tiebreak=["k"])
    plain = tl.rank_within_groups(df, ["g"], "o", "r", tiebreak=["k"])
    order = lambda d: sorted(map(repr, d.collect()))
    assert order(split) == order(plain)
    assert split.where("o is null").first()["r"] == 2011
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" in plan and "_bk" in plan
    few = tl.rank_within_groups(df, ["g"], "o", "r", rows_per_task=100, max_ranges=4)
    assert order(few) == order(plain)


def test_chunk_timeline_with_hot_sides_equals_plain(spark):
    base = TQ.events_timeline(spark, SF_MID)
    stats = tl.last_flag(base, "user_id", "event_id", "is_flag")
    tail = tl.tail_after_flag(base, stats, "user_id", "event_id", keep_salt=True)

    def run(rpt):
        ch = tl.chunk_sides(tail, 2, None, "user_id", "own", "event_id", rows_per_task=rpt)
        return sorted(tuple(r) for r in ch.select("user_id", "event_id", "side_rank", "chunk_id").collect())

    assert run(tl.DEFAULT_ROWS_PER_TASK) == run(3)


def test_sort_merge_path_with_salting_equals_default(spark):
    """The plan used at scale (no broadcast, salted hot accounts) gives the same pairs."""
    def pairs_for(rows_per_task):
        base = TQ.events_timeline(spark, SF_MID)
        stats = tl.last_flag(base, "user_id", "event_id", "is_flag")
        tail = tl.tail_after_flag(base, stats, "user_id", "event_id", rows_per_task=rows_per_task, keep_salt=True)
        ch = tl.chunk_sides(tail, 5, 3, "user_id", "own", "event_id")
        return sorted(tuple(r) for r in tl.pair_carry_forward(tl.chunk_engagement(ch, {"v": "value"}, "user_id", "own"),
                                                              "user_id", "own").collect())

    default = pairs_for(tl.DEFAULT_ROWS_PER_TASK)
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        forced = pairs_for(5)
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert forced == default and len(default) == 105


def test_skewed_account_is_salted_and_exact(spark):
    t = TQ.events_timeline(spark, SF_MID).withColumn(
        "user_id", F.when(F.col("user_id") < 50, F.lit(0).cast("bigint")).otherwise(F.col("user_id")))
    stats = tl.last_flag(t, "user_id", "event_id", "is_flag")
    hot = {r[0]: r[1] for r in tl.hot_accounts(stats, "user_id", TQ.SKEW_ROWS_PER_TASK).collect()}
    assert hot.get(0, 0) > 1
    salted = sorted(tuple(r) for r in TQ.event_chunk_pairs_skewed(spark, SF_MID).collect())
    tail = tl.tail_after_flag(t, stats, "user_id", "event_id", keep_salt=True)
    plain = TQ._pairs_select(TQ.pairs_of(tl.chunk_sides(tail, 5, 3, "user_id", "own", "event_id")), label=True)
    assert salted == sorted(tuple(r) for r in plain.collect())
