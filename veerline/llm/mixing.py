"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule w(t) over the training time t in [0, 1], a straight line from
``tilt * T`` to ``(2 - tilt) * T``; its integral D(t) = T * (tilt * t + (1 - tilt) * t^2) is the
source's cumulative demand, with D(1) = T, the source's target. A source's stream is its documents
in hash order, pass after pass. The document whose middle word is number m of the stream is
trained at the time t with D(t) = m, the inverse of the demand; it is taken when that time is
within training (m < T). Ordering all passes by their position is the curriculum.

Scale: narrow rows only; one shuffle for the bucket sums (pre-aggregated), one for the prefix sums
inside a bucket of a source, one range shuffle for the order. A hot source is split over
16**hex_digits buckets, so no task sorts a whole source. The window over all sources runs on the
pre-aggregated table of sources (one row per source)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veerline.llm.common import WORD

WEIGHTS = (3, 1, 2)             # by source, in code point order, repeating; null source last
TILTS = (1.5, 1.0, 0.5)         # schedule of each source: early, even, late, repeating


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, tilts: Sequence[float] = TILTS,
                   share_pct: int = 150, max_passes: int = 2) -> DataFrame:
    """One row per source: ``source_size``, ``target``, ``tilt``.

    The targets share ``share_pct`` % of all words by weight; a target stops at ``max_passes`` times
    its source's size and the excess is shared again among the rest. Filling in the order of
    size / weight reaches the same fixed point in one pass: the capped sources are a prefix."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]),
                                             ((F.col("_no") - 1) % len(values) + 1).cast("int"))
    per = (per.withColumn("_no", F.row_number().over(order))
              .withColumn("weight", pick(weights, "bigint")).withColumn("tilt", pick(tilts, "double")))
    dec = lambda c: c.cast("decimal(38,0)")
    by_ratio = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("_no"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = (per.withColumn("_s0", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
              .withColumn("_w", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
              .withColumn("_all", F.sum("source_size").over(everything))
              # 100 x what is left to share when all sources before this one are capped
              .withColumn("_left", F.col("_all") * share_pct - F.col("_s0") * (100 * max_passes))
              .withColumn("_capped", dec(F.col("_left")) * dec(F.col("weight"))
                          > dec(F.col("source_size")) * dec(F.col("_w")) * (100 * max_passes)))
    level = F.first(F.when(~F.col("_capped"), F.col("_left").cast("double") / (F.col("_w") * 100).cast("double")),
                    ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (per.withColumn("_level", level)
               .withColumn("target", F.when(F.col("_capped") | F.col("_level").isNull(),
                                            (F.col("source_size") * max_passes).cast("double"))
                           .otherwise(F.col("_level") * F.col("weight")))
               .select("source", "source_size", "target", "tilt"))


def curriculum_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                         carry: Sequence[str] | None = None, weights: Sequence[int] = WEIGHTS,
                         tilts: Sequence[float] = TILTS, share_pct: int = 150, max_passes: int = 2,
                         hex_digits: int = 3) -> DataFrame:
    """One row per input row: ``doc`` (a struct of the ``carry`` columns, all by default, so names
    cannot clash), ``size``, ``source_size``, ``target`` and ``positions``, the training positions
    in [0, 1) of the row's passes (empty: not taken).

    Null text: size 0. Null source: a source of its own, the last one. Rows of size 0 take a
    position like any other and add no words. Rows that tie in id are ordered by a hash of their
    text; equal rows are interchangeable. Same input, same result, on any partitioning."""
    carried = F.struct(*[F.col(c) for c in (carry or docs.columns)])
    rows = docs.select(carried.alias("doc"), F.col(source_col).cast("string").alias("source"),
                       word_count(F.col(text_col).cast("string")).alias("size"),
                       F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")).alias("_k"),
                       F.xxhash64(F.col(text_col).cast("string")).alias("_h"))
    rows = rows.withColumn("_b", F.substring("_k", 1, hex_digits))
    # plain, non-null keys: the join and the window below share one exchange of the rows
    rows = rows.withColumn("_z", F.col("source").isNull()).withColumn("_n", F.coalesce("source", F.lit("")))
    small = rows.groupBy("source", "_b").agg(F.sum("size").alias("size"))
    prior = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(small, weights, tilts, share_pct, max_passes)
    buckets = (small.withColumn("_off", F.coalesce(F.sum("size").over(prior), F.lit(0))).drop("size")
               .withColumnRenamed("source", "_s").withColumnRenamed("_b", "_bb"))
    targets = targets.withColumnRenamed("source", "_t")
    # both lookups are pre-aggregated (sources x buckets, sources); Spark chooses the join by their run-time size
    buckets = buckets.join(targets, F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    buckets = buckets.select(F.col("_s").isNull().alias("_z"), F.coalesce("_s", F.lit("")).alias("_n"),
                             F.col("_bb").alias("_b"), "_off", "source_size", "target", "tilt")
    joined = rows.join(buckets, ["_z", "_n", "_b"])
    inside = (Window.partitionBy("_z", "_n", "_b").orderBy("_k", "_h", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    start = F.col("_off") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    joined = joined.withColumn("_start", start)
    passes = F.transform(F.sequence(F.lit(0), F.lit(max_passes - 1)),
                         lambda e: (F.col("_start") + e * F.col("source_size")) * 2 + F.col("size"))
    taken = F.filter(passes, lambda m2: m2.cast("double") < F.col("target") * 2)

    def invert(m2: Column) -> Column:
        u, a = m2.cast("double") / (F.col("target") * 2), F.col("tilt")
        bent = (F.sqrt(a * a + (F.lit(1.0) - a) * 4 * u) - a) / ((F.lit(1.0) - a) * 2)
        return F.when(a == 1.0, u).otherwise(bent)

    return joined.select("doc", "size", "source_size", "target", F.transform(taken, invert).alias("positions"))


def training_order(positions: DataFrame) -> DataFrame:
    """One row per pass of each taken document (``doc``, ``position``), range-sorted by position."""
    return (positions.select("doc", F.explode("positions").alias("position"))
            .orderBy("position", F.xxhash64("doc")))
