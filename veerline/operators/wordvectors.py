"""Text vectors learned from the texts themselves (V7): co-occurrence counts, positive pointwise mutual
information, and the leading eigenvectors of that symmetric word-by-word table by a randomized range finder.

The table is never dense: it is rows (a, b, x). A block of ``dims + extra`` vectors over the words is a table
(word, y); multiplying is a join on the word and a sum per word, the block is made orthonormal through its
small Gram matrix, and the table's values on the block's span give the eigenvectors. The starting block comes from
hashes of the words, so nothing depends on partitioning but the last bits of sums.

Scale: pairs are counted once, combined on the map side, and written without rare words, each pair one way round;
sums and the table read them from there. A multiplication shuffles the
table once and the block once. Blocks are written after every step. The driver holds matrices of
``dims + extra`` rows and columns only."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veerline.session import ensure_checkpoint_dir

BLOCK = "word string, y array<double>"


def neighbours(tokens: Column | str, window: int) -> Column:
    """Pairs (a, b) of tokens at most ``window`` apart, the earlier one first."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    near = F.transform(t, lambda a, i: F.transform(F.slice(t, i + 2, F.lit(window)), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    return F.flatten(near)


def cooccurrences(docs: DataFrame, tokens_col: str, window: int = 5, min_count: int = 5) -> DataFrame:
    """(a, b, n): how often words stand within ``window`` of each other, both ways; words of fewer than ``min_count``
    occurrences are left out. Null tokens and null documents count nothing."""
    words = docs.select(F.explode(tokens_col).alias("word")).where(F.col("word").isNotNull())
    frequent = words.groupBy("word").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= min_count).select("word")
    pairs = docs.select(F.explode(neighbours(tokens_col, window)).alias("p")).select("p.a", "p.b").where("a is not null and b is not null")
    once = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    once = (once.join(frequent.withColumnRenamed("word", "a"), "a", "left_semi").join(frequent.withColumnRenamed("word", "b"), "b", "left_semi"))
    path = f"{ensure_checkpoint_dir(docs.sparkSession).rstrip('/')}/vectors/pairs-{uuid.uuid4().hex[:12]}"
    once.write.parquet(path)                                     # sums, total and table all read it
    once = docs.sparkSession.read.schema(once.schema).parquet(path)
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", (2 * F.col("n")).alias("n")))).otherwise(
        F.array(F.struct("a", "b", "n"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "n")))
    return once.select(F.explode(both).alias("c")).select("c.a", "c.b", "c.n")


def positive_information(counts: DataFrame) -> DataFrame:
    """(a, b, n, x): ln(n * total / (n of a * n of b)) where it is positive."""
    sums = counts.groupBy("a").agg(F.sum("n").alias("s"))
    total = F.lit(sums.agg(F.sum("s")).first()[0] or 0).cast("double")          # one number
    cells = (counts.join(sums.withColumnRenamed("s", "sa"), "a")
             .join(sums.select(F.col("a").alias("b"), F.col("s").alias("sb")), "b"))
    x = F.ln(F.col("n") * total / (F.col("sa").cast("double") * F.col("sb").cast("double")))
    return cells.select("a", "b", "n", x.alias("x")).where("x > 0")


@dataclass
class WordVectors:
    """``values``: eigenvalues, the largest size first; ``vectors``: (word, y), unit columns with their largest entry positive."""
    values: list[float]
    vectors: DataFrame

    def scaled(self) -> DataFrame:
        """(word, vector): entries times the square root of the eigenvalue's size."""
        roots = F.array(*[F.lit(abs(v) ** 0.5) for v in self.values]) if self.values else F.array().cast("array<double>")
        return self.vectors.select("word", F.zip_with("y", roots, lambda a, b: a * b).alias("vector"))


class _Blocks:
    """Blocks of vectors over the words, each written under one folder."""

    def __init__(self, cells: DataFrame):
        self.spark, self.step = cells.sparkSession, 0
        self.path = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/vectors/{uuid.uuid4().hex[:12]}"
        self.cells = self.written(cells.select("a", "b", "x"))

    def written(self, df: DataFrame) -> DataFrame:
        self.step += 1
        path = f"{self.path}/step={self.step}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def start(self, width: int) -> DataFrame:
        """Uniform numbers in -1 .. 1 from hashes of the word and the column."""
        y = F.array(*[F.xxhash64("word", F.lit(j)) / float(1 << 63) for j in range(width)])
        return self.written(self.cells.select(F.col("a").alias("word")).distinct().select("word", y.alias("y")))

    def times(self, block: DataFrame, width: int) -> DataFrame:
        """The table times the block."""
        joined = self.cells.join(block.withColumnRenamed("word", "b"), "b")
        sums = joined.groupBy("a").agg(*[F.sum(F.col("x") * F.get("y", F.lit(j))).alias(f"s{j}") for j in range(width)])
        return self.written(sums.select(F.col("a").alias("word"), F.array(*[f"s{j}" for j in range(width)]).alias("y")))

    def turned(self, block: DataFrame, matrix: np.ndarray) -> DataFrame:
        """The block times a small matrix."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y = batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), len(matrix)) @ matrix
                yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(y.tolist(), pa.list_(pa.float64()))], ["word", "y"])
        return self.written(block.mapInArrow(run, BLOCK))

    def product(self, left: DataFrame, right: DataFrame, width: int) -> np.ndarray:
        """left transposed times right, a small matrix: added up in the tasks, then by Spark."""
        both = left.join(right.withColumnRenamed("y", "z"), "word").select("y", "z")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width, width))
            for batch in batches:
                y, z = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width) for c in ("y", "z"))
                total += y.T @ z
            i, j = (x.ravel() for x in np.indices(total.shape))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "v"])

        sums = both.mapInArrow(run, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
        out = np.zeros((width, width))
        for r in sums.collect():                                     # width x width numbers
            out[r["i"], r["j"]] = r["v"]
        return out

    def orthonormal(self, block: DataFrame, width: int) -> tuple[DataFrame, int]:
        """A block with orthonormal columns and the same span; directions that vanish are dropped."""
        for _ in range(2):                                           # twice: the Gram matrix squares the rounding
            values, vectors = np.linalg.eigh(self.product(block, block, width))
            keep = values > values.max(initial=0.0) * 1e-13
            block, width = self.turned(block, vectors[:, keep] / np.sqrt(values[keep])), int(keep.sum())
        return block, width


def word_vectors(cells: DataFrame, dims: int = 16, extra: int = 32, rounds: int = 8) -> WordVectors:
    """Leading eigenvectors of the symmetric table ``cells`` (a, b, x). An empty table has none; a table of lower
    rank gives fewer than ``dims``. More ``extra`` vectors and ``rounds`` bring the last values nearer to the exact ones."""
    blocks = _Blocks(cells)
    width = dims + extra
    block = blocks.start(width)
    if not block.take(1):
        return WordVectors([], block)
    for _ in range(rounds + 1):
        block, width = blocks.orthonormal(blocks.times(block, width), width)
        if not width:
            return WordVectors([], block)
    inner = blocks.product(block, blocks.times(block, width), width)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-np.abs(values))[:dims]
    block = blocks.turned(block, vectors[:, order])
    ends = block.agg(*[f(F.get("y", F.lit(j))).alias(f"{f.__name__}{j}") for j in range(len(order)) for f in (F.min, F.max)]).first()
    signs = [1.0 if ends[2 * j + 1] >= -ends[2 * j] else -1.0 for j in range(len(order))]
    return WordVectors(values[order].tolist(), blocks.turned(block, np.diag(signs)))


def embed_by_words(docs: DataFrame, key: str, tokens_col: str, vectors: DataFrame, dims: int) -> DataFrame:
    """(key, vector, n_known): the mean vector of a text's known words, zeros without any. Keys are unique and not null."""
    counted = docs.select(key, F.explode_outer(tokens_col).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    joined = counted.join(vectors, "word", "left")
    known = F.sum(F.when(F.col("vector").isNotNull(), F.col("n")).otherwise(0))
    mean = [F.coalesce(F.sum(F.get("vector", F.lit(j)) * F.col("n")) / F.nullif(known, F.lit(0)), F.lit(0.0)) for j in range(dims)]
    return joined.groupBy(key).agg(F.array(*mean).alias("vector") if mean else F.first(F.array().cast("array<double>")).alias("vector"),
                                   known.alias("n_known"))
