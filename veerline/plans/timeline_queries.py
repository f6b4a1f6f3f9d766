"""Timeline queries on the ``events`` fixture.

Mapping: account = user_id, order = event_id, flag = event_type 'error', own side = event_type in
('click', 'purchase'), engagement = value. Timelines after the last error are short, so chunk sizes
of 5 and 2 are used (size 20 would only ever give chunk 0)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veerline.operators import timeline as tl
from veerline.plans.registry import register
from veerline.sources.tables import read_table

OWN_TYPES = ("click", "purchase")
FLAG_TYPE = "error"


def events_timeline(spark: SparkSession, sf: str) -> DataFrame:
    ev = read_table(spark, sf, "events")
    return ev.select("user_id", "event_id", "event_type", "value", "props",
                     (F.col("event_type") == FLAG_TYPE).alias("is_flag"),
                     F.col("event_type").isin(*OWN_TYPES).alias("own"))


def events_flags(timeline: DataFrame) -> DataFrame:
    return tl.last_flag(timeline, "user_id", "event_id", "is_flag",
                        carry={"flag_value": "value", "flag_props": "props"})


def events_tail(spark: SparkSession, sf: str, keep_salt: bool = False) -> DataFrame:
    timeline = events_timeline(spark, sf)
    stats = tl.last_flag(timeline, "user_id", "event_id", "is_flag")
    return tl.tail_after_flag(timeline, stats, "user_id", "event_id", keep_salt=keep_salt)


def event_chunks(spark: SparkSession, sf: str, chunk_size: int, max_chunks: int | None) -> DataFrame:
    return tl.chunk_sides(events_tail(spark, sf, keep_salt=True), chunk_size, max_chunks,
                          "user_id", "own", "event_id")


def event_pairs(spark: SparkSession, sf: str, chunk_size: int, max_chunks: int = 3) -> DataFrame:
    """Chunks per side, summed, paired with carry-forward (A1 + J3 + J4)."""
    chunks = event_chunks(spark, sf, chunk_size, max_chunks)
    return pairs_of(chunks)


def pairs_of(chunks: DataFrame) -> DataFrame:
    eng = tl.chunk_engagement(chunks, {"value": "value"}, "user_id", "own")
    return tl.pair_carry_forward(eng, "user_id", "own")


_CTE_TAIL = """
f as (select user_id, max(case when event_type = 'error' then event_id end) as flag_pos from events group by user_id),
tail as (select e.* , f.flag_pos from events e join f on e.user_id = f.user_id where e.event_id > f.flag_pos),
p as (select user_id, event_id, value, event_type in ('click', 'purchase') as own,
             row_number() over (partition by user_id, event_type in ('click', 'purchase') order by event_id) - 1 as side_rank
      from tail)
"""


def _pairs_sql(size: int, label: bool, source: str | None = None) -> str:
    lab = ", case when o.chunk_id = 0 then 1 else 3 end as label" if label else ""
    cte = _CTE_TAIL if source is None else f"ev as ({source}),\n" + _CTE_TAIL.replace("from events", "from ev")
    return f"""
with {cte},
c as (select user_id, own, cast(floor(side_rank / {size}.0) as int) as chunk_id, count(*) as n,
             round(sum(value), 2) as v from p group by 1, 2, 3),
o as (select * from c where own and chunk_id <= 2),
r as (select * from c where not own),
rm as (select user_id, max(chunk_id) as last_chunk from r group by 1)
select o.user_id, o.chunk_id, o.n as n_own, o.v as own_value, r.chunk_id as other_chunk_id,
       r.n as n_other, r.v as other_value{lab}
from o join rm on o.user_id = rm.user_id
       join r on r.user_id = o.user_id and r.chunk_id = least(o.chunk_id, rm.last_chunk)
"""


def _pairs_select(pairs: DataFrame, label: bool) -> DataFrame:
    cols = [F.col("user_id"), F.col("chunk_id"), F.col("own_n").alias("n_own"),
            F.round("own_value", 2).alias("own_value"), F.col("other_chunk_id"),
            F.col("other_n").alias("n_other"), F.round("other_value", 2).alias("other_value")]
    if label:
        cols.append(tl.chunk_label("chunk_id", 1, 3).alias("label"))
    return pairs.select(*cols)


@register("event_chunk_pairs", sql=_pairs_sql(5, label=True))
def event_chunk_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Minimum slice: after each user's last error, chunks of 5 per side, at most 3 own chunks,
    sums on both sides, carry-forward pairing, label 1 for chunk 0 and 3 later."""
    return _pairs_select(event_pairs(spark, sf, 5), label=True)


@register("last_flag_per_account", sql="""
with f as (select user_id, max(case when event_type = 'error' then event_id end) as flag_pos,
                  count(*) as n_rows from events group by user_id)
select f.user_id, f.flag_pos, e.value as flag_value, e.props as flag_props, f.n_rows
from f join events e on e.event_id = f.flag_pos
""")
def last_flag_per_account(spark: SparkSession, sf: str) -> DataFrame:
    return events_flags(events_timeline(spark, sf))


@register("tail_after_flag", sql="""
with f as (select user_id, max(case when event_type = 'error' then event_id end) as flag_pos from events group by user_id)
select e.user_id, e.event_id, e.event_type, e.value, f.flag_pos
from events e join f on e.user_id = f.user_id where e.event_id > f.flag_pos
""")
def tail_after_flag(spark: SparkSession, sf: str) -> DataFrame:
    return events_tail(spark, sf).select("user_id", "event_id", "event_type", "value", "flag_pos")


@register("split_own_reposts", sql=f"""
with {_CTE_TAIL}
select user_id, own, count(*) as n_rows, round(sum(value), 2) as sum_value from p group by user_id, own
""")
def split_own_reposts(spark: SparkSession, sf: str) -> DataFrame:
    return (events_tail(spark, sf).groupBy("user_id", "own")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("value"), 2).alias("sum_value")))


@register("chunk_timeline", sql=f"""
with {_CTE_TAIL}
select user_id, event_id, own, side_rank, cast(floor(side_rank / 2.0) as int) as chunk_id from p
""")
def chunk_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """W3 without a chunk limit: every row after the flag gets its chunk of 2 on its side."""
    return (event_chunks(spark, sf, 2, None)
            .select("user_id", "event_id", "own", F.col("side_rank").cast("bigint").alias("side_rank"),
                    "chunk_id"))


@register("first_k_chunks", sql=f"""
with {_CTE_TAIL}
select user_id, event_id, own, side_rank, cast(floor(side_rank / 2.0) as int) as chunk_id from p
where side_rank < 6
""")
def first_k_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of 2, only chunks 0..2 on each side (a per-group limit, not a global one)."""
    return (event_chunks(spark, sf, 2, 3)
            .select("user_id", "event_id", "own", F.col("side_rank").cast("bigint").alias("side_rank"),
                    "chunk_id"))


@register("chunk_engagement", sql=f"""
with {_CTE_TAIL}
select user_id, own, cast(floor(side_rank / 5.0) as int) as chunk_id, count(*) as n,
       round(sum(value), 2) as sum_value
from p where side_rank < 15 group by 1, 2, 3
""")
def chunk_engagement(spark: SparkSession, sf: str) -> DataFrame:
    chunks = event_chunks(spark, sf, 5, 3)
    return (tl.chunk_engagement(chunks, {"sum_value": "value"}, "user_id", "own")
            .withColumn("sum_value", F.round("sum_value", 2)))


@register("carry_forward_chunk_join", sql=_pairs_sql(2, label=False))
def carry_forward_chunk_join(spark: SparkSession, sf: str) -> DataFrame:
    """J3 with chunks of 2, so that own chunks often outnumber other chunks and carry forward."""
    return _pairs_select(event_pairs(spark, sf, 2), label=False)


@register("require_both_sides", sql=f"""
with {_CTE_TAIL}
select user_id, count_if(own)::bigint as n_own, count_if(not own)::bigint as n_other from p
group by user_id having count_if(own) >= 1 and count_if(not own) >= 1
""")
def require_both_sides(spark: SparkSession, sf: str) -> DataFrame:
    tail = events_tail(spark, sf)
    return (tail.groupBy("user_id")
            .agg(F.count_if(F.col("own")).alias("n_own"), F.count_if(~F.col("own")).alias("n_other"))
            .where((F.col("n_own") >= 1) & (F.col("n_other") >= 1)))


@register("flag_to_chunks", sql=f"""
with {_CTE_TAIL},
c as (select distinct user_id, cast(floor(side_rank / 5.0) as int) as chunk_id from p where own and side_rank < 15),
both_sides as (select user_id from p group by user_id having count_if(not own) >= 1)
select c.user_id, c.chunk_id, e.event_id as flag_pos, e.value as flag_value, e.props as flag_props
from c join both_sides b on c.user_id = b.user_id
       join (select user_id, max(case when event_type = 'error' then event_id end) as fp from events group by user_id) f
         on f.user_id = c.user_id
       join events e on e.event_id = f.fp
""")
def flag_to_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The flagged row's columns copied to every own chunk (computed once per account, joined)."""
    timeline = events_timeline(spark, sf)
    flags = events_flags(timeline)
    pairs = event_pairs(spark, sf, 5)
    return (pairs.select("user_id", "chunk_id")
            .join(flags.select("user_id", "flag_pos", "flag_value", "flag_props"), "user_id"))


@register("assign_chunk_label", sql=f"""
with {_CTE_TAIL},
c as (select distinct user_id, cast(floor(side_rank / 5.0) as int) as chunk_id from p where own and side_rank < 15),
both_sides as (select user_id from p group by user_id having count_if(not own) >= 1)
select c.user_id, c.chunk_id, case when c.chunk_id = 0 then 1 else 3 end as label_changer,
       case when c.chunk_id = 0 then 2 else 0 end as label_other
from c join both_sides b on c.user_id = b.user_id
""")
def assign_chunk_label(spark: SparkSession, sf: str) -> DataFrame:
    pairs = event_pairs(spark, sf, 5)
    return pairs.select("user_id", "chunk_id", tl.chunk_label("chunk_id", 1, 3).alias("label_changer"),
                        tl.chunk_label("chunk_id", 2, 0).alias("label_other"))


@register("account_summary", sql=f"""
with {_CTE_TAIL}
select count(distinct user_id) as n_accounts from p
where user_id in (select user_id from p group by user_id having count_if(own) >= 1 and count_if(not own) >= 1)
""")
def account_summary(spark: SparkSession, sf: str) -> DataFrame:
    return tl.account_summary(event_pairs(spark, sf, 5), "user_id")


# One account holding about a third of all rows: the events of users 0..49 merged into user 0
# (every row kept). A small rows_per_task makes the hot account really split over salts.
SKEW_SOURCE = ("select event_id, case when user_id < 50 then 0 else user_id end as user_id, event_type, value, props "
               "from events")
SKEW_ROWS_PER_TASK = 200


@register("event_chunk_pairs_skewed", sql=_pairs_sql(5, label=True, source=SKEW_SOURCE))
def event_chunk_pairs_skewed(spark: SparkSession, sf: str) -> DataFrame:
    """The minimum slice when one account holds a third of the rows: the hot account is split over
    ceil(n / rows_per_task) salts in the tail join and the first-k window; same result as unsplit."""
    timeline = events_timeline(spark, sf).withColumn(
        "user_id", F.when(F.col("user_id") < 50, F.lit(0).cast("bigint")).otherwise(F.col("user_id")))
    stats = tl.last_flag(timeline, "user_id", "event_id", "is_flag")
    tail = tl.tail_after_flag(timeline, stats, "user_id", "event_id", SKEW_ROWS_PER_TASK, keep_salt=True)
    chunks = tl.chunk_sides(tail, 5, 3, "user_id", "own", "event_id")
    return _pairs_select(pairs_of(chunks), label=True)
