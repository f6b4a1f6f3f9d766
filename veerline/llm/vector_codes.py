"""Codes of vectors by product quantisation on integers, with an integer Walsh-Hadamard search.

Components become integers floor(SCALE * x); a vector is cut into equal parts, and each part position
has a codebook that starts with the smallest ids' parts and moves to its parts' floored means for a
fixed number of rounds. The nearest entry is found on transformed integers: parts and entries are
filled with zeros to a power of two P and multiplied by the Hadamard matrix, rows in sequency order
(by number of sign changes). Squared differences of the transforms add up to P times the squared
distance, and the first, smooth rows carry most of it. So a part's running sums start with the first
rows for all entries; the entry that leads gets its whole sum, and row by row every entry whose running
sum is over the best whole sum leaves. The survivors' sums are the scaled distances, exactly: only integers
are added and compared (64 bits where they provably fit, Python's own integers elsewhere).

Scale: a round is one pass over the kept vectors. A task adds up its parts by entry and sends one row per
component sum, split into 40-bit limbs, so that sums are exact for any finite input and any number of
rows; Spark adds the limbs. The driver holds the codebooks only (parts x entries x part length integers)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veerline.llm.common import written

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
LIMB = 40
LONG_MAX = 2 ** 63 - 1


def usable(vector: Column) -> Column:
    """The vector is there and all its components are finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine, F.lit(False))


def sequency_matrix(size: int) -> np.ndarray:
    """The Hadamard matrix of a power of two, rows by number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((h[:, 1:] != h[:, :-1]).sum(1), kind="stable")]


def integers(vectors: list[list[float]], dim: int) -> np.ndarray:
    """floor(SCALE * x) as a matrix of ``dim`` columns, short vectors filled with zeros: int64, or Python integers
    where a component is large."""
    flat = np.zeros((len(vectors), dim))
    for row, v in zip(flat, vectors, strict=True):
        row[:len(v)] = v
    if not len(flat) or not dim or np.abs(flat).max() < 2 ** 40:
        return np.floor(flat * SCALE).astype(np.int64)            # a product with a power of two is exact
    return np.array([[int(x) * SCALE if abs(x) >= 2 ** 53 else int(np.floor(x * SCALE)) for x in row] for row in flat.tolist()], object)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry (ties: the lowest index) of each part."""
    n, length = parts.shape
    size = 1 << max(length - 1, 0).bit_length()
    largest = max((int(np.abs(x).max()) for x in (parts, entries) if x.size), default=0)
    kind = np.int64 if size * size * 4 * largest ** 2 * size < 2 ** 62 else object
    matrix = sequency_matrix(size)[:, :length].astype(kind)
    turned, targets = parts.astype(kind) @ matrix.T, entries.astype(kind) @ matrix.T
    head = min(2, size)
    sums = np.zeros((n, len(entries)), kind)
    for i in range(head):
        sums += (turned[:, i, None] - targets[None, :, i]) ** 2
    leader = sums.argmin(1)
    bound = ((turned - targets[leader]) ** 2).sum(1)
    row, entry = np.nonzero((sums <= bound[:, None]).astype(bool))
    left = sums[row, entry]
    for i in range(head, size):
        left = left + (turned[row, i] - targets[entry, i]) ** 2
        stay = (left <= bound[row]).astype(bool)
        row, entry, left = row[stay], entry[stay], left[stay]
    starts = np.searchsorted(row, np.arange(n))                   # each part keeps its leader at least
    best = np.minimum.reduceat(left, starts) if n else left
    first = np.flatnonzero((left == best[row]).astype(bool))
    first = first[np.r_[True, row[first[1:]] != row[first[:-1]]]] if n else first
    return entry[first], best // size


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """(number, limb) with value = sum of limb * 2^(LIMB * number); the last limb carries the sign."""
    at = 0
    while not -(1 << LIMB) <= value < 1 << LIMB:
        yield at, value & ((1 << LIMB) - 1)
        value >>= LIMB
        at += 1
    yield at, value


def _assigned(vectors: list, codebooks: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Part by part: its position, the vectors' parts, their entries and squared distances."""
    n_parts, _, length = codebooks.shape
    whole = integers(vectors, n_parts * length)
    for p in range(n_parts):
        parts = whole[:, p * length:(p + 1) * length]
        yield p, parts, *nearest(parts, codebooks[p])


def _sum_batches(codebooks: np.ndarray):
    n_parts, n_entries, length = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n_parts, n_entries, length + 1), object)  # the last column counts
        for batch in batches:
            for p, parts, entry, _ in _assigned(batch.column("v").to_pylist(), codebooks):
                for e in np.unique(entry):
                    mine = parts[entry == e]
                    sums[p, e, :length] += mine.astype(object).sum(0) if mine.dtype == object else _exact_sum(mine)
                    sums[p, e, length] += len(mine)
        rows = [(*at, *limb) for at, value in np.ndenumerate(sums) if value or at[2] == length for limb in _limbs(int(value))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
                                         ["part", "entry", "place", "limb", "value"])
    return run


def _exact_sum(rows: np.ndarray) -> np.ndarray:
    """Column sums of int64 rows (below 2^52 in size) as Python integers, added in runs that cannot overflow."""
    total = np.zeros(rows.shape[1], object)
    for at in range(0, len(rows), 1024):
        total += rows[at:at + 1024].sum(0).astype(object)
    return total


def _moved(kept: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round: floored means of their parts; entries without parts stay."""
    limbs = kept.select("v").mapInArrow(_sum_batches(codebooks), "part bigint, entry bigint, place bigint, limb bigint, value bigint")
    sums = limbs.groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value"))
    n_parts, n_entries, length = codebooks.shape
    total = np.zeros((n_parts, n_entries, length + 1), object)
    for p, e, i, limb, value in sums.collect():                    # parts x entries x part length numbers
        total[p, e, i] += value << (LIMB * limb)
    out = codebooks.copy()
    for p, e in np.ndindex(n_parts, n_entries):
        if total[p, e, length]:
            out[p, e] = total[p, e, :length] // total[p, e, length]
    return out


def _code_batches(codebooks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries, error = [], 0
            for _, _, entry, distance in _assigned(batch.column("v").to_pylist(), codebooks):
                entries.append(entry)
                error = error + distance.astype(object)
            code = ["".join(f"{e:02x}" for e in row) for row in np.stack(entries, 1).tolist()]
            error = [int(e) if e <= LONG_MAX else None for e in error]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()),
                                              pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])
    return run


def learn_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (part, entry, place) of the kept vectors (vec_id, v); None when there is no vector."""
    first = [r["v"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    if not first:
        return None
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    length = max(1, -(-longest // parts))
    start = integers(first, parts * length).astype(object)
    codebooks = np.stack([start[:, p * length:(p + 1) * length] for p in range(parts)])
    for _ in range(rounds):
        codebooks = _moved(kept, codebooks)
    return codebooks


def codebooks_digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all integers by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                     parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: ``vec_id``, ``code`` (two hex digits a part), ``error`` (squared distances over all
    parts), ``label_error`` (summed over equal labels, nulls together), ``codebooks_sha256``.

    Rows whose vector is null or holds a null or non-finite component are dropped. The codebooks start with the
    smallest ids, null ids last; rows that repeat an id are ordered by their vectors, and repeated rows count as
    often as they come. Fewer vectors than entries: that many entries. Vectors of unequal length, or of one that the
    parts do not divide, are filled with zeros at the end (empty vectors too). An error that a bigint cannot hold is
    null, and so is its label's. No vector kept: no rows."""
    kept = written(vectors.where(usable(F.col(vector_col))).select(
        F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label")), "vectors")
    codebooks = learn_codebooks(kept.select("vec_id", "v"), parts, entries, rounds)
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"
    if codebooks is None:
        return kept.sparkSession.createDataFrame([], f"vec_id {kinds['vec_id']}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    coded = written(kept.select("vec_id", "label", "v").mapInArrow(_code_batches(codebooks), schema), "codes")
    whole = F.count(F.lit(1)) == F.count("error")
    sums = written(coded.groupBy(F.col("label").alias("_label")).agg(F.when(whole, F.sum(F.col("error").cast("decimal(20,0)"))).alias("_sum")), "label_errors")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", F.expr("try_cast(_sum as bigint)").alias("label_error"),
        F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))
