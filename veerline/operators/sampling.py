"""Reproducible shuffles, exact global ranks, account-level semi / anti joins, unions on common
columns, and the balanced, leakage-free labelled data set.

Shuffles are orders by md5 of (row key, seed): the same on any number of partitions and in any
SQL engine with md5. A positional slice "first n after a shuffle" is a rank filter; ranks are
exact and never computed by a window without partition keys over the data: rows are bucketed by
the first hex digits of their md5 key (uniform), bucket sizes are prefix-summed on the small
count table (at most 16**hex_digits rows), and row_number runs inside each bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_key(cols: Sequence[str], seed: int | None) -> Column:
    """md5 hex of the row key columns (and the seed) joined by '|'."""
    parts = [F.col(c).cast("string") for c in cols]
    if seed is not None:
        parts.append(F.lit(str(seed)))
    return F.md5(F.concat_ws("|", *parts))


def global_rank(df: DataFrame, key: Column, tiebreak: Sequence[str] = (), hex_digits: int = 3,
                partition_by: Sequence[str] = (), rank_col: str = "rank", few_groups: bool = False,
                first_n: int | None = None) -> DataFrame:
    """1-based rank of each row in the order (key, *tiebreak), optionally within groups.

    ``key`` must be a hex string whose prefixes spread rows evenly (an md5). Buckets are the first
    ``hex_digits`` characters; at most 16**hex_digits buckets per group. ``few_groups`` states that
    ``partition_by`` has a handful of values (e.g. a source tag), so the offsets stay small. With
    ``first_n`` only ranks up to it come back: buckets that start beyond it are dropped by the
    offsets join, before the rows are shuffled."""
    d = df.withColumn("_k", key).withColumn("_b", F.substring("_k", 1, hex_digits))
    counts = d.groupBy(*partition_by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    prior = Window.partitionBy(*partition_by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*partition_by, "_b", F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_off"))
    offsets = offsets if first_n is None else offsets.where(F.col("_off") < first_n)
    # Without groups (or with a few) the offset table has at most 16**hex_digits rows per group.
    offsets = F.broadcast(offsets) if (not partition_by or few_groups) else offsets
    inner = Window.partitionBy(*partition_by, "_b").orderBy("_k", *tiebreak)
    ranked = (d.join(offsets, [*partition_by, "_b"])
              .withColumn(rank_col, (F.col("_off") + F.row_number().over(inner)).cast("bigint"))
              .drop("_k", "_b", "_off"))
    return ranked if first_n is None else ranked.where(F.col(rank_col) <= first_n)


def shuffled_rank(df: DataFrame, row_key: Sequence[str], seed: int, rank_col: str = "rank",
                  partition_by: Sequence[str] = (), few_groups: bool = False, hex_digits: int = 3,
                  first_n: int | None = None) -> DataFrame:
    """T1 + W6: rank of each row in the seeded shuffle order (ties broken by the row key)."""
    return global_rank(df, seeded_key(row_key, seed), tiebreak=list(row_key), hex_digits=hex_digits,
                       partition_by=partition_by, rank_col=rank_col, few_groups=few_groups, first_n=first_n)


def head_after_shuffle(df: DataFrame, row_key: Sequence[str], seed: int, n: int, hex_digits: int = 3) -> DataFrame:
    """The first ``n`` rows of the seeded shuffle (a rank filter, no single-task sort; rows of later
    buckets are not shuffled)."""
    return shuffled_rank(df, row_key, seed, "_rank", hex_digits=hex_digits, first_n=n).drop("_rank")


def semi_join_accounts(df: DataFrame, accounts: DataFrame, account: str = "account_name") -> DataFrame:
    """Rows whose account is in the list (AQE broadcasts the list when it is small)."""
    return df.join(accounts.select(account), account, "left_semi")


def anti_join_accounts(df: DataFrame, accounts: DataFrame, account: str = "account_name") -> DataFrame:
    """Rows whose account is not in the list."""
    return df.join(accounts.select(account), account, "left_anti")


def union_common_columns(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union on the columns every frame has, in the first frame's order."""
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]
    return reduce(lambda a, b: a.unionByName(b), [f.select(*common) for f in frames])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Plain bag union by name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def relabel(df: DataFrame, label: str = "label", constant: int | None = None) -> DataFrame:
    """Label as int, copied to ``true_label``; optionally replaced by a constant."""
    out = df.withColumn(label, F.col(label).cast("int")).withColumn("true_label", F.col(label))
    if constant is not None:
        out = out.withColumn(label, F.lit(constant))
    return out


def unwrap_first(nested: Column | str) -> Column:
    """P10: first element of a nested list (null when empty)."""
    c = F.col(nested) if isinstance(nested, str) else nested
    return F.get(c, 0)


def drop_if_present(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns; missing names are ignored."""
    return df.drop(*names)


def balanced_dataset(changers: DataFrame, others: DataFrame, randoms: DataFrame, test_accounts: DataFrame,
                     row_key: Sequence[str], account: str = "account_name", seed: int = 42,
                     test_seed: int = 0, train_share: float = 0.8, hex_digits: int = 3) -> DataFrame:
    """Test / train / valid splits without account leakage (column ``split``).

    Sources carry ``label`` as produced by the feature build (changers 1 / 3, others 2 / 0,
    random users any); ``true_label`` keeps it, others get label 0. Rule:
      1. T+ = changers with label 1 whose account is in ``test_accounts``; n = |T+|.
      2. T- = first n//2 shuffled others in the test list + first n//2 shuffled random users.
      3. test = T+ and T- on common columns; all accounts of test leave every source.
      4. pos = remaining changers with label 1 (seed order); m = |pos|;
         neg = first m//2 shuffled others + first m//2 shuffled random users.
      5. k = int(train_share * m): train = first k of pos and of neg (shuffle order); valid = rest.
    Every split of the rule keeps only the columns common to the three sources, so they travel as
    one union tagged by source (``_src``): three ranks partitioned by the tag instead of six. The
    ranks move only row key, account, label and a row number; the whole rows (texts, vectors) are
    joined to the chosen numbers once. Two counts (n and m) are the only actions; the union is
    materialised once (reliable checkpoint in ``spark.checkpoint.dir``), which also fixes the numbers."""
    keys = list(row_key)
    frames = [relabel(changers), relabel(others, constant=0), relabel(randoms)]
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]
    tagged = reduce(lambda a, b: a.unionByName(b),
                    [f.select(*common, F.lit(i).alias("_src")) for i, f in enumerate(frames)])
    from veerline.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(tagged.sparkSession)
    whole = tagged.withColumn("_rid", F.monotonically_increasing_id()).checkpoint(eager=True)
    src = whole.select("_rid", "_src", *dict.fromkeys([*keys, account, "label"]))
    is_pos = (F.col("_src") == 0) & (F.col("label") == 1)

    def first_per_source(df: DataFrame, n_each: int) -> DataFrame:
        return global_rank(df, seeded_key(keys, test_seed), tiebreak=keys, hex_digits=hex_digits, partition_by=["_src"],
                           rank_col="_r", few_groups=True, first_n=n_each).drop("_r")

    t_pos = semi_join_accounts(src.where(is_pos), test_accounts, account)
    n = t_pos.count()
    t_neg = first_per_source(
        semi_join_accounts(src.where(F.col("_src") == 1), test_accounts, account)
        .unionByName(src.where(F.col("_src") == 2)), n // 2)
    # the test split (at most 2n rows) feeds the anti-join and the result: written once
    test = t_pos.unionByName(t_neg).checkpoint(eager=True)

    rest = anti_join_accounts(src, test, account)     # no distinct below it: a hot account can then be split
    pos = rest.where(is_pos)
    m = pos.count()
    neg = first_per_source(rest.where(F.col("_src") != 0), m // 2)
    k = int(m * train_share)
    grp = F.when(F.col("_src") == 0, F.lit(0)).otherwise(F.lit(1))
    key = F.when(F.col("_grp") == 0, seeded_key(keys, seed)).otherwise(seeded_key(keys, test_seed))
    both = pos.unionByName(neg).withColumn("_grp", grp)
    ranked = global_rank(both, key, tiebreak=keys, hex_digits=hex_digits, partition_by=["_grp"], rank_col="_r", few_groups=True)
    train_valid = ranked.withColumn("split", F.when(F.col("_r") <= k, F.lit("train")).otherwise(F.lit("valid")))
    chosen = test.select("_rid", F.lit("test").alias("split")).unionByName(train_valid.select("_rid", "split"))
    return whole.join(chosen, "_rid").select(*common, "split")


def materialise_sources(frames: Sequence[DataFrame]) -> list[DataFrame]:
    """Write several frames once, as one tagged union, to the shared checkpoint folder; return
    each frame read back with its own columns (cuts lineage; survives executor loss)."""
    from veerline.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(frames[0].sparkSession)
    tagged = [f.withColumn("_src", F.lit(i)) for i, f in enumerate(frames)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged).checkpoint(eager=True)
    return [union.where(F.col("_src") == i).select(*f.columns) for i, f in enumerate(frames)]


def class_counts(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """A3: rows per split and label."""
    return df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
