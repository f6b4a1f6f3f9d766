"""SimHash near-duplicates by a segment-popcount embedding.

A text's 64-bit fingerprint holds a bit for each position that is set in more than half of its
shingles' hashes. Fingerprints at ``max_bits`` or fewer differing bits are linked, and a document's
component is everything reachable over links.

Candidates: a fingerprint is cut into segments of one or two bits (``SEGMENTS``); the segments' bit counts
are its embedding, and the Manhattan distance of two embeddings is a lower bound of the differing
bits (a flipped bit moves one count by one). The segments fall into two halves. Of two linked
fingerprints, one half lies within ``max_bits // 2`` in Manhattan distance (else the whole would
exceed ``max_bits``). Each fingerprint goes to the grid cell of each half and to all cells within
``radius`` = ceil((max_bits // 2) / 2) around it, so two halves within that distance meet in a
cell halfway. Inside a cell the exact Hamming distance decides. Wider segments give fewer cells a
fingerprint and more chance meetings, which grow with the square of the corpus: with two bits
throughout, two random fingerprints share a cell once in 10^4 pairs, with this layout once in 10^6.

Scale: equal fingerprints are one row (combined before the shuffle), so groups of copies cost one
row. A cell is searched as a graph: from one fingerprint, all others not yet reached are compared
in one vector step, and a spanning forest of the cell's links comes out, not its pairs; a cell of
thousands of near copies takes a few steps and yields as many rows as it has members. A cell with
more than ``cell_rows`` members is split into blocks, and every two blocks meet in a task of their
own, so no task holds more than two blocks and no link is lost. Components come from alternating
star contractions over the written links; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veerline.llm.common import written

SHINGLE_WORDS, SEED, MAX_BITS = 4, 42, 4
SEGMENTS = (1,) * 24 + (2,) * 4       # bits of the segments of a half (32 in all)


def fingerprint_of(text: bytes, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of UTF-8 text: ASCII lower case, words between ASCII white space, shingles with repeats."""
    from xxhash import xxh64_intdigest as digest

    words = text.lower().split()
    if not words:
        return 0
    n = len(words) - shingle_words + 1
    if n <= 1:
        return digest(b" ".join(words), seed)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    line = b" ".join(words)
    starts = [0, *ends]
    hashes = np.fromiter((digest(line[starts[i]:starts[i + shingle_words] - 1], seed) for i in range(n)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        # big-endian bytes: the first unpacked bit is bit 63
        ones += np.unpackbits(hashes[at:at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle_words: int = SHINGLE_WORDS, seed: int = SEED,
                 carry: Sequence[Column] = ()) -> DataFrame:
    """(doc_id, fp, carried columns): the fingerprint as a signed 64-bit integer. Null or wordless text: 0."""
    @F.arrow_udf("bigint")
    def fp(texts: pa.Array) -> pa.Array:
        out = np.empty(len(texts), dtype=np.uint64)
        for i, t in enumerate(texts.cast(pa.large_binary())):
            out[i] = fingerprint_of(t.as_py() or b"", shingle_words, seed)
        return pa.array(out.view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), fp(F.col(text_col).cast("string")).alias("fp"), *carry)


def _moves(segments: Sequence[int], radius: int) -> np.ndarray:
    """All count changes within Manhattan distance ``radius`` over counts of 0 to the segments' bits."""
    out = {(0,) * len(segments)}
    edge = set(out)
    for _ in range(radius):
        edge = {m[:i] + (m[i] + d,) + m[i + 1:] for m, i, d in product(edge, range(len(segments)), (-1, 1))
                if abs(m[i] + d) <= segments[i]}
        out |= edge
    return np.array(sorted(out), dtype=np.int8)


def cells_of(fps: np.ndarray, segments: Sequence[int], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index into ``fps``, cell) of both halves: the embedding's own cell and all within ``radius``."""
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    most = np.array(segments, dtype=np.int8)
    starts = np.cumsum([0, *segments[:-1]])
    powers = np.cumprod([1, *[w + 1 for w in segments[:-1]]], dtype=np.uint64)
    for side in (0, 1):
        own = np.add.reduceat(bits[:, 32 * side:32 * side + 32].astype(np.int8), starts, axis=1)
        cell = own.astype(np.uint64) @ powers
        for move in _moves(segments, radius):
            at = np.flatnonzero(move)
            moved = own[:, at] + move[at]
            ok = np.flatnonzero(((moved >= 0) & (moved <= most[at])).all(axis=1))
            shift = (move.astype(np.int64).view(np.uint64) * powers).sum(dtype=np.uint64)     # modulo 2^64
            yield ok, (cell[ok] + shift) * np.uint64(2) + np.uint64(side)


def spanning_links(a: np.ndarray, max_bits: int) -> tuple[list, list]:
    """Links of a spanning forest of the graph 'at most ``max_bits`` differing bits' over distinct
    fingerprints: breadth first; each one reached is compared with all not yet reached."""
    left, right = [], []
    waiting = a
    while len(waiting) > 1:
        queue, waiting = [waiting[0]], waiting[1:]
        while queue and len(waiting):
            x = queue.pop()
            near = np.bitwise_count(waiting ^ x) <= max_bits
            if near.any():
                hits = waiting[near]
                left.extend([x] * len(hits))
                right.extend(hits)
                queue.extend(hits)
                waiting = waiting[~near]
    return left, right


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, segments: Sequence[int] = SEGMENTS,
               cell_rows: int = 20_000) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``): every two within ``max_bits`` bits
    are connected over links of at most ``max_bits`` bits."""
    radius = -(-(max_bits // 2) // 2)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 20_000):
                part = fp[at:at + 20_000]
                for rows, cell in cells_of(part, segments, radius):
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(part[rows].view(np.int64))],
                                                         ["cell", "fp"])

    # a row becomes some sixty: spread by a key of its own, else the grouping's few (gathered) partitions are used again
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = fps.select("fp").repartition(tasks, F.xxhash64("fp")).mapInArrow(emit, "cell bigint, fp bigint")
    # cells with one member have no pair; the sizes are a combined count
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = written(sizes, "cells")
    return _linked(cells, sizes, max_bits, cell_rows)


def _linked(cells: DataFrame, sizes: DataFrame, max_bits: int, cell_rows: int) -> DataFrame:
    met = cells.join(sizes.hint("merge"), "cell")       # both sides grow with the input: the same plan at every size
    blocks = F.ceil(F.col("n") / F.lit(max(2, cell_rows) // 2)).cast("int")
    block = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    # block i meets block j in task (min, max); a cell of one block is task (0, 0)
    tasks = F.transform(F.sequence(F.lit(0), blocks - 1),
                        lambda j: F.struct(F.least(block, j).alias("x"), F.greatest(block, j).alias("y")))
    met = met.select("cell", "fp", F.explode(F.when(blocks <= 1, F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))))
                                             .otherwise(tasks)).alias("t")).select("cell", "t.x", "t.y", "fp")
    met = met.repartition(F.col("cell"), F.col("x"), F.col("y")).sortWithinPartitions("cell", "x", "y", "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups arrive sorted; one group (at most two blocks) is held at a time."""
        held: list[np.ndarray] = []
        held_key = None
        left: list = []
        right: list = []

        def solve():
            a, b = spanning_links(np.unique(np.concatenate(held)), max_bits)
            left.extend(a)
            right.extend(b)

        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)], axis=1)
            fp = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(fp):
                continue
            cuts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(fp)]))
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                k = tuple(key[s])
                if k != held_key and held:
                    solve()
                    held = []
                held_key = k
                held.append(fp[s:e].copy())
            if left:
                yield _links(left, right)
                left, right = [], []
        if held:
            solve()
        if left:
            yield _links(left, right)

    return met.mapInArrow(search, "a bigint, b bigint").distinct()


def _links(left: list, right: list) -> pa.RecordBatch:
    a, b = np.array(left, dtype=np.uint64).view(np.int64), np.array(right, dtype=np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a < b): the smallest node it can reach.

    Alternating star contractions: 'large' stars tie each node's larger neighbours to its smallest one,
    'small' stars tie its smaller ones; both keep the components and end in stars, in a number of
    rounds that grows with the logarithm of a chain's length. Each round is written."""
    edges = written(links.select("a", "b"), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (both.where("b > a").join(low, "a")
                 .select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b").distinct())
        large = written(large, "large")                        # a: larger, b: smaller
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(low, "a")
        small = (tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        small = written(small.select(F.col("b").alias("a"), F.col("a").alias("b")), "small")
        # done when the links are stars whose centre is smaller than all its leaves: no node is both
        if small.select("a").join(small.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            # ... and no leaf has two centres
            if small.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
                return (small.select(F.col("b").alias("node"), F.col("a").alias("root"))
                        .unionByName(small.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()))
        edges = small


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
                    seed: int = SEED, max_bits: int = MAX_BITS, segments: Sequence[int] = SEGMENTS,
                    cell_rows: int = 20_000, carry: Sequence[Column] = ()) -> DataFrame:
    """One row per input row: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id
    reachable), ``root`` (the component's smallest fingerprint, an integer) and the ``carry`` columns.

    Null, empty and wordless texts have fingerprint zero and are linked like any other. Repeated rows
    are returned as often as they occur. Null ids never are the smallest; a component without an id
    has a null one. No rows: no rows."""
    fps = written(fingerprints(docs, id_col, text_col, shingle_words, seed, carry), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(near_links(distinct, max_bits, segments, cell_rows))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "roots")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id", "root")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
                                        "root", *[c for c in fps.columns if c not in ("doc_id", "fp")])
