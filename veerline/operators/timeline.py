"""Timeline operators: last flag per account, tail after it, side chunks, engagement, carry-forward pairing.

A timeline frame has one row per post with an account key, an order column (``pos``, unique within
an account: file position or event id), a boolean flag column and a boolean side column (own post
or repost). All operators are lazy DataFrame -> DataFrame.

Scale notes
-----------
* The flag lookup is one hash aggregate (partial aggregation map-side), so a hot account costs
  no more than any other.
* Accounts with more than ``rows_per_task`` rows are "hot". Their count is bounded by
  ``total_rows / rows_per_task``, which is what makes the hot list safe to broadcast. Hot
  accounts are split over ``ceil(n_rows / rows_per_task)`` salt values in the tail join, so no
  task receives more than about ``rows_per_task`` rows of one account.
* "First k rows of each side" is a two-level window: first inside (account, side, salt), where
  the join output is already partitioned by (account, salt), then exactly over the <= k * salts
  survivors of each (account, side).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one account that one task may hold before the account is split over several tasks.
DEFAULT_ROWS_PER_TASK = 2_000_000

_SALT = "_salt"
_NSALT = "_n_salt"


def last_flag(df: DataFrame, account: str = "account", pos: str = "pos", flag: str = "is_flag",
              carry: Mapping[str, str | Column] | None = None) -> DataFrame:
    """One row per account that has a flagged row: position of its last flagged row
    (``flag_pos``), ``n_rows`` (all rows of the account) and the carried columns of the flagged row.
    Accounts without a flag drop out.

    The aggregate keeps fixed-width buffers only (hash aggregate with map-side combine); carried
    columns, which may be long texts, come from an equi-join with the flagged rows alone."""
    stats = (df.groupBy(account)
             .agg(F.max(F.when(F.col(flag), F.col(pos))).alias("flag_pos"),
                  F.count(F.lit(1)).alias("n_rows"))
             .where(F.col("flag_pos").isNotNull()))
    carry = dict(carry or {})
    if not carry:
        return stats
    flagged = df.where(F.col(flag)).select(
        F.col(account), F.col(pos).alias("flag_pos"),
        *[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in carry.items()])
    return stats.join(flagged, [account, "flag_pos"])


def hot_accounts(flags: DataFrame, account: str = "account",
                 rows_per_task: int = DEFAULT_ROWS_PER_TASK) -> DataFrame:
    """Accounts with more rows than one task should hold, and how many salt values they get.

    Bounded by construction: at most total_rows / rows_per_task accounts qualify."""
    return (flags.where(F.col("n_rows") > rows_per_task)
            .select(account, F.ceil(F.col("n_rows") / F.lit(rows_per_task)).cast("int").alias(_NSALT)))


def tail_after_flag(df: DataFrame, flags: DataFrame, account: str = "account", pos: str = "pos",
                    rows_per_task: int = DEFAULT_ROWS_PER_TASK, keep_salt: bool = False,
                    stats: DataFrame | None = None) -> DataFrame:
    """Rows strictly after the account's last flag, with the columns of ``flags`` attached.

    Equi-join on (account, salt); the flag row is replicated once per salt value of hot accounts.
    ``stats`` (``last_flag`` without carried columns) is where the hot list comes from when
    ``flags`` carries columns or was filtered: it keeps the flagged-row join out of the
    broadcast side."""
    hot = F.broadcast(hot_accounts(stats if stats is not None else flags, account, rows_per_task))
    nsalt = F.coalesce(F.col(_NSALT), F.lit(1))
    left = (df.join(hot, account, "left")
            .withColumn(_SALT, F.pmod(F.xxhash64(F.col(pos)), nsalt).cast("int"))
            .drop(_NSALT))
    right = (flags.drop("n_rows").join(hot, account, "left")
             .withColumn(_SALT, F.explode(F.sequence(F.lit(0), nsalt - 1)))
             .drop(_NSALT))
    out = left.join(right, [account, _SALT]).where(F.col(pos) > F.col("flag_pos"))
    return out if keep_salt else out.drop(_SALT)


def first_rows_per_side(tail: DataFrame, k: int, account: str = "account", side: str = "own",
                        pos: str = "pos") -> DataFrame:
    """W3/W4 core: keep the first ``k`` rows (by ``pos``) of each (account, side); adds 0-based
    ``side_rank``. Uses the ``_salt`` column of ``tail_after_flag(keep_salt=True)`` to spread hot
    accounts; without it every account is one group."""
    if _SALT not in tail.columns:
        tail = tail.withColumn(_SALT, F.lit(0))
    w1 = Window.partitionBy(account, side, _SALT).orderBy(pos)
    w2 = Window.partitionBy(account, side).orderBy(pos)
    level1 = tail.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1")
    return (level1.withColumn("side_rank", F.row_number().over(w2) - 1)
            .where(F.col("side_rank") < k).drop(_SALT))


def rank_within_groups(df: DataFrame, keys: list[str], order: str, rank_col: str = "rank",
                       rows_per_task: int = DEFAULT_ROWS_PER_TASK, tiebreak: Sequence[str] = (),
                       max_ranges: int = 1000) -> DataFrame:
    """Exact 1-based rank by ``order`` (nulls last, then ``tiebreak``) inside each group of ``keys``,
    without sorting a hot group in one task.

    Groups with more than ``rows_per_task`` rows are cut into ceil(n / rows_per_task) ranges of
    ``order`` at approximate quantiles, so clustered values spread as evenly as uniform ones; range
    sizes are prefix-summed into offsets and ``row_number`` runs inside each range. The quantiles
    only place the cuts: ranks are exact whatever they are. Rows equal in ``order`` share a range. A
    group of more than ``max_ranges`` * ``rows_per_task`` rows has larger ranges (at most
    ``max_ranges`` of them). Hot groups number fewer than total_rows / rows_per_task and offsets fewer
    than twice that (proven bounds, so both are broadcast); other groups are one range with offset 0."""
    sizes = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_task)
             .select(*keys, F.least(F.ceil(F.col("_n") / F.lit(rows_per_task)), F.lit(max_ranges)).cast("int").alias("_nb")))
    grid = [i / max_ranges for i in range(1, max_ranges)]
    quantiles = (df.join(F.broadcast(sizes), keys).groupBy(*keys, "_nb")
                 .agg(F.percentile_approx(order, grid, F.lit(10 * max_ranges)).alias("_q")))
    # the group's nb - 1 cuts out of the common grid
    at = F.sequence(F.lit(1), F.col("_nb") - 1)
    cuts = quantiles.select(*keys, F.transform(at, lambda i: F.get("_q", F.floor(i * max_ranges / F.col("_nb")).cast("int") - 1)).alias("_cuts"))
    bucket = (F.when(F.col("_cuts").isNull(), F.lit(0)).when(F.col(order).isNull(), F.size("_cuts"))
              .otherwise(F.size(F.filter("_cuts", lambda c: c < F.col(order)))))
    d = df.join(F.broadcast(cuts), keys, "left").withColumn("_bk", bucket)
    prior = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (d.where(F.col("_cuts").isNotNull()).groupBy(*keys, "_bk").agg(F.count(F.lit(1)).alias("_c"))
               .select(*keys, "_bk", F.coalesce(F.sum("_c").over(prior), F.lit(0)).alias("_off")))
    inner = Window.partitionBy(*keys, "_bk").orderBy(F.asc_nulls_last(order), *tiebreak)
    return (d.drop("_cuts").join(F.broadcast(offsets), [*keys, "_bk"], "left")
            .withColumn(rank_col, F.coalesce(F.col("_off"), F.lit(0)) + F.row_number().over(inner))
            .select(*[c for c in df.columns if c != rank_col], rank_col))


def chunk_sides(tail: DataFrame, chunk_size: int, max_chunks: int | None, account: str = "account",
                side: str = "own", pos: str = "pos", rows_per_task: int = DEFAULT_ROWS_PER_TASK) -> DataFrame:
    """W3 + W4: ``chunk_id`` = rank within (account, side) div chunk_size; only chunks < max_chunks.

    With ``max_chunks=None`` every chunk is kept: an exact per-side rank that splits hot sides
    (``rank_within_groups``)."""
    if max_chunks is None:
        ranked = rank_within_groups(tail.drop(_SALT), [account, side], pos, "_rank", rows_per_task)
        ranked = ranked.withColumn("side_rank", F.col("_rank") - 1).drop("_rank")
    else:
        ranked = first_rows_per_side(tail, chunk_size * max_chunks, account, side, pos)
    return ranked.withColumn("chunk_id", F.floor(F.col("side_rank") / chunk_size).cast("int"))


def chunk_engagement(chunked: DataFrame, measures: Mapping[str, str | Column], account: str = "account",
                     side: str = "own") -> DataFrame:
    """A1: per (account, side, chunk_id): ``n`` rows and the sum of each measure (0 when empty)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.coalesce(F.sum(c if isinstance(c, Column) else F.col(c)), F.lit(0)).alias(name)
             for name, c in measures.items()]
    return chunked.groupBy(account, side, "chunk_id").agg(*aggs)


def pair_carry_forward(chunks: DataFrame, account: str = "account", side: str = "own",
                       own_prefix: str = "own_", other_prefix: str = "other_", max_chunks: int = 3) -> DataFrame:
    """J3 + J4: pair own chunk i (i < max_chunks) with other chunk min(i, last other chunk).

    Accounts without any row on one side drop out (J4). Only chunks below ``max_chunks`` can take
    part on either side (i stops there, and min(i, last) never needs a later other chunk), so both
    sides are cut to them first: one group by account then folds each side into a sorted array of
    at most max_chunks entries and the pairing is an array lookup - one exchange, no range join,
    no unbounded group even for a hot account."""
    chunks = chunks.where(F.col("chunk_id") < max_chunks)
    value_cols = [c for c in chunks.columns if c not in (account, side, "chunk_id")]
    entry = F.struct("chunk_id", *value_cols)
    folded = (chunks.groupBy(account)
              .agg(F.array_sort(F.collect_list(F.when(F.col(side), entry))).alias("_own"),
                   F.array_sort(F.collect_list(F.when(~F.col(side), entry))).alias("_other"))
              .where((F.size("_own") > 0) & (F.size("_other") > 0)))
    own = folded.select(account, "_other", F.explode("_own").alias("_o"))
    picked = F.element_at(F.col("_other"), F.least(F.col("_o.chunk_id"), F.size("_other") - 1) + 1)
    return own.select(account, F.col("_o.chunk_id").alias("chunk_id"),
                      *[F.col("_o")[c].alias(own_prefix + c) for c in value_cols],
                      picked["chunk_id"].alias(other_prefix + "chunk_id"),
                      *[picked[c].alias(other_prefix + c) for c in value_cols])


def chunk_label(chunk_id: Column | str, first: int, later: int) -> Column:
    """Label ``first`` for chunk 0, ``later`` for the rest."""
    c = F.col(chunk_id) if isinstance(chunk_id, str) else chunk_id
    return F.when(c == 0, F.lit(first)).otherwise(F.lit(later))


def split_own(handle: Column | str, account_handle: Column | str) -> Column:
    """P5: own post when the row's handle equals the account's handle."""
    h = F.col(handle) if isinstance(handle, str) else handle
    a = F.col(account_handle) if isinstance(account_handle, str) else account_handle
    return h == a


def account_summary(df: DataFrame, account: str = "account") -> DataFrame:
    """Number of distinct accounts kept."""
    return df.agg(F.count_distinct(account).alias("n_accounts"))
