"""Merkle manifest of a table of documents: one tree a source, one tree over the sources' roots.

A node is the lowercase hex SHA-256 of its children's digests, written one after another; every three
neighbours make a node. Nodes are ranked exactly and cut into aligned blocks of 3^DEPTH. A block keeps
each of its levels as one string of 64-character digests, so a parent is the digest of a fixed-width
substring of the level below, and the siblings of a node are the two substrings that flank it inside
its run of three. The roots of the blocks are the nodes of the next, much smaller round, until every
tree has one node. Going back down, each block's members get their own flanks and those of their block.

Scale: texts are hashed where they are read and never shuffled. Ranks come from a range partitioning by
(source, doc_id) with prefix sums over a table of one row per task and source, so a hot source is spread
like any other rows, and no group is larger than a block. A round is 3^DEPTH times smaller than the
one before. Everything that is used twice is written to the shared folder. Only the largest tree size
of a round and the root's 64 characters reach the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veerline.llm.common import let, written

FAN = 3
DEPTH = 5                 # levels of a block: 243 nodes, 16 KB of digests
HEX = 64
IN_PARTITION = (1 << 33) - 1   # the part of monotonically_increasing_id that counts inside a partition


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 over the fields, each ``-`` for null, else UTF-8 byte count, ``:`` and the value as text."""
    said = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
            for c in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*said), 256)


def tampered_text(id_col: Column, text: Column) -> Column:
    """The text without line feeds where the id's crc32 is even; null ids and null texts stay."""
    even = F.crc32(id_col.cast("string").cast("binary")) % 2 == 0
    return F.when(F.coalesce(even, F.lit(False)), F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def ranked(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """``nodes`` with ``rank`` (from 0, by ``order`` inside its tree ``t``) and ``total`` (nodes of the tree)."""
    at = F.monotonically_increasing_id()
    placed = written(nodes.repartitionByRange("t", *order).sortWithinPartitions("t", *order)
                     .select("*", F.spark_partition_id().alias("_part"), at.bitwiseAND(IN_PARTITION).alias("_at")), name)
    runs = placed.groupBy("t", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    tree = Window.partitionBy("t")
    offsets = runs.select("t", "_part", F.sum("_n").over(tree).alias("total"), (
        F.coalesce(F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_first")).alias("_shift"))
    return (placed.join(written(offsets, f"{name}_offsets"), ["t", "_part"])
            .withColumn("rank", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift"))


def _levels(digests: Column, total: Column) -> Column:
    """The levels of a block as strings, from its members' digests up: as many as its tree still needs, at most DEPTH."""
    def parents(level: Column) -> Column:
        n = F.ceil(F.length(level) / (FAN * HEX)).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.sha2(
            F.substring(level, i * FAN * HEX + 1, F.lit(FAN * HEX)), 256)), "")

    def grown(levels: Column, step: Column) -> Column:
        more = total > F.pow(F.lit(FAN), step).cast("bigint")
        return F.when(more, F.concat(levels, F.array(parents(F.element_at(levels, -1))))).otherwise(levels)

    first = F.array(F.array_join(digests, ""))
    return F.aggregate(F.sequence(F.lit(0), F.lit(DEPTH - 1)), first, grown)


def _flanks(levels: Column, pos: Column) -> Column:
    """Left and right siblings of the member at ``pos``, level by level."""
    def at(level: Column, step: Column) -> Column:
        i = F.floor(pos / F.pow(F.lit(FAN), step)).cast("int")
        run = i - i % FAN
        return F.struct(F.substring(level, run * HEX + 1, (i - run) * HEX).alias("l"),
                        F.substring(level, (i + 1) * HEX + 1, (run + FAN - 1 - i) * HEX).alias("r"))
    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), at)


def _blocks(nodes: DataFrame, carry: list[str], name: str) -> DataFrame:
    """One row per aligned block: ``t``, ``block``, ``total``, ``members`` (in order) and ``levels``."""
    size = FAN ** DEPTH
    member = F.struct((F.col("rank") % size).cast("int").alias("pos"), "digest", *carry)
    blocks = nodes.groupBy("t", F.floor(F.col("rank") / size).alias("block")).agg(
        F.first("total").alias("total"), F.array_sort(F.collect_list(member), lambda a, b: a["pos"] - b["pos"]).alias("members"))
    return written(blocks.withColumn("levels", _levels(F.col("members.digest"), F.col("total"))), name)


def _round(nodes: DataFrame, carry: list[str], name: str) -> list[DataFrame]:
    """Block tables of all rounds, the nodes' own first, until each tree has one node."""
    rounds = []
    while True:
        blocks = _blocks(nodes, carry if not rounds else [], f"{name}{len(rounds)}")
        rounds.append(blocks)
        most = blocks.agg(F.max("total")).first()[0]
        if most is None or most <= FAN ** DEPTH:
            return rounds
        nodes = blocks.select("t", F.col("block").alias("rank"), F.ceil(F.col("total") / FAN ** DEPTH).alias("total"),
                              F.element_at("levels", -1).alias("digest"))


def _tops(rounds: list[DataFrame]) -> DataFrame:
    """(t, subroot): the one node left of each tree."""
    return rounds[-1].select("t", F.element_at("levels", -1).alias("subroot"))


def _paths(rounds: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """The nodes' own blocks (the first of ``rounds``) with ``path``, the flanks from their block's root up,
    and the columns of ``above``: (t, path, more), the flanks from the trees' roots up (None: nothing is above)."""
    last = rounds[-1]                                              # one block a tree
    if above is None:
        more, up = [], last.withColumn("path", F.array().cast("array<struct<l:string,r:string>>"))
    else:
        more, up = [c for c in above.columns if c not in ("t", "path")], last.join(above, "t")
    for blocks in reversed(rounds[:-1]):
        each = F.transform("members", lambda m: F.struct(
            m["pos"].alias("pos"), F.concat(_flanks(F.col("levels"), m["pos"]), F.col("path")).alias("path")))
        parents = up.select("t", (F.col("block") * FAN ** DEPTH).alias("_from"), *more, F.inline(each)).select(
            "t", (F.col("_from") + F.col("pos")).alias("block"), "path", *more)
        up = blocks.join(parents, ["t", "block"])
    return up
    return rounds[0].join(parents, ["t", "block"])


def merkle_manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``leaf``, ``subroot`` (of its source), ``root``, ``proof_sha256`` (all of the
    untampered table), ``folded_root`` (from the tampered leaf and the original siblings), ``verified``.

    Leaves ascend by id, null first, and rows that repeat an id by leaf; repeated rows are leaves of their own (equal
    ones, in any order). A null source is a source of its own, before all others (the empty text is another one). Null
    fields are ``-``; rows with a null id are not tampered. One row: leaf = subroot = root and an empty proof. No rows: no rows."""
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    col = {f: F.col(f) for f in fields}
    tampered = {**col, text_col: tampered_text(F.col(id_col), F.col(text_col).cast("string"))}
    leaves = written(docs.select(source.alias("t"), F.col(id_col).alias("doc_id"), leaf_digest(list(col.values())).alias("digest"),
                                 leaf_digest(list(tampered.values())).alias("tampered")), "leaves")
    rounds = _round(ranked(leaves, ["doc_id", "digest"], "leaves_ranked"), ["doc_id", "tampered"], "leaf_blocks")
    subroots = _tops(rounds).select(F.lit("").alias("t"), F.col("t").alias("source"), F.col("subroot").alias("digest"))
    top = _round(ranked(subroots, ["source"], "sources_ranked"), ["source"], "source_blocks")
    root = _tops(top).first()
    root = F.lit(root["subroot"] if root else None).cast("string")

    sources = _paths(top).select("path", "levels", F.explode("members").alias("m")).select(
        F.col("m.source").alias("t"), F.concat(_flanks(F.col("levels"), F.col("m.pos")), F.col("path")).alias("path"),
        F.col("m.digest").alias("subroot"))

    def proven(m: Column) -> Column:
        return let(F.concat(_flanks(F.col("levels"), m["pos"]), F.col("path")), lambda path: F.struct(
            m["doc_id"].alias("doc_id"), m["digest"].alias("leaf"),
            F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""), 256).alias("proof_sha256"),
            F.aggregate(path, m["tampered"], lambda node, s: F.sha2(F.concat(s["l"], node, s["r"]), 256)).alias("folded_root")))

    out = _paths(rounds, sources).select("subroot", F.inline(F.transform("members", proven)))
    return out.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
                      (F.col("folded_root") == root).alias("verified"))
