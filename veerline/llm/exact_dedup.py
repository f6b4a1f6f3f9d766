"""Exact dedup by deterministic block naming.

A text is cut into blocks of ``block_chars`` code points. Distinct blocks are sorted and numbered:
equal blocks get the same integer name, different ones never do. Then adjacent names are paired
and the distinct pairs are sorted and numbered again, until each document has one name. Two
documents of the same number of levels have the same name exactly when their texts are equal: the
names come from comparing blocks and pairs themselves, so no hash can collide. (A block's hash only
routes rows: a hash with more than one block is joined on the block itself. Rows are told apart by a
row number, not by their id.)

Scale: the text is shuffled once (distinct blocks, combined on the map side first, so that a text
copied a million times crosses once per task). All later rows are a few integers. Each level
halves the rows; its pairs, their names and the named rows are written to the shared folder, so every
level runs the same short plans (their compiled code is reused) and the last plan is one scan and one
join. Group sizes are written before they are joined back: a hot name is then an ordinary skewed
join, which adaptive execution splits; no group is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veerline.llm.common import plain, shared_path, written

BLOCK_CHARS = 1024


def _numbered(distinct: DataFrame, *keys: str) -> DataFrame:
    """Distinct rows sorted inside their partition and numbered: unique integers, fixed by writing."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _named_blocks(base: DataFrame, block_chars: int) -> DataFrame:
    """(row, doc_id, sha, n, i, name): one row per block; ``n`` blocks in the text, sha at the first."""
    cut = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))
    blocks = base.select(F.explode(cut).alias("block")).select(F.xxhash64("block").alias("h"), "block")
    names = written(_numbered(blocks.distinct(), "h", "block"), "blocks")
    clashing = names.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")

    rows = base.select("*", F.monotonically_increasing_id().alias("row"))     # before the blocks are exploded
    cells = rows.select("row", "doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), F.size(cut).alias("n"), F.posexplode(cut).alias("i", "block"))
    cells = cells.select("row", "doc_id", F.when(F.col("i") == 0, F.col("sha")).alias("sha"), "n", "i",
                         F.xxhash64("block").alias("h"), "block")
    if not clashing.take(1):
        return cells.drop("block").join(names.select("h", "name"), "h").drop("h")
    # two blocks share a 64-bit hash: those rows compare the blocks themselves
    slim = names.join(clashing, "h", "left_anti").select("h", "name")
    clash = cells.join(names.join(clashing, "h", "left_semi"), ["h", "block"]).drop("block", "h")
    return cells.drop("block").join(slim, "h").drop("h").unionByName(clash)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_chars: int = BLOCK_CHARS, repeated_rows: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id`` (largest id among equal texts), ``group_size``,
    ``kept``, ``text_sha256``.

    Null text: empty; empty texts are equal to each other. Rows that repeat both id and text are one
    document (one row, counted once), or with ``repeated_rows`` one row and one count each; rows with one id and different texts are different documents.
    A null id is kept only when no row of its group has an id. No input rows: no output rows."""
    spark = docs.sparkSession
    named = _named_blocks(plain(docs, id_col, text_col), block_chars)
    folder, level = shared_path(spark, "names"), 0
    while True:  # the same plans at every level: ``n`` counts the names a row still has
        first = F.col("i") % 2 == 0
        pairs = written(named.groupBy("row", F.shiftright("i", 1).alias("i")).agg(
            F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"), F.max(F.shiftright(F.col("n") + 1, 1)).alias("n"),
            F.max(F.when(first, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~first, F.col("name"))), F.lit(-1)).alias("b")), "pairs")
        names = written(_numbered(pairs.select("a", "b").distinct(), "a", "b"), "pair_names")
        named = pairs.join(names, ["a", "b"]).drop("a", "b")
        named.write.parquet(f"{folder}/level={level}")
        named = spark.read.schema(named.schema).parquet(f"{folder}/level={level}")
        longest = named.agg(F.max("n")).first()[0]
        if longest is None or longest <= 1:
            break
        named, level = named.where("n > 1"), level + 1
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema)
    ids = spark.read.schema(f"{kinds}, level int").parquet(folder).where("n = 1").select("doc_id", "sha", "level", "name")
    if not repeated_rows:
        ids = written(ids.dropDuplicates(["doc_id", "level", "name"]), "ids")
    groups = written(ids.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    return ids.join(groups, ["level", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))
