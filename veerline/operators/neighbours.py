"""Reduction of vectors by their neighbour graph (V8): nearest neighbours by descent, then the leading
eigenvectors of the graph.

``neighbour_graph`` starts from ``width`` rows for each row, drawn by hash, and improves round by round:
neighbours of one row are likely neighbours of each other, so the rows around every row meet (equi-joins on
the row between them), their distances are taken, and each row keeps its ``width`` nearest. Only meetings that
involve an edge found in the round before are new. ``reduce_by_neighbours`` weighs the edges by distance,
relative to both ends' own scale, and takes eigenvectors of the normalised graph by power iteration on a block.

Scale: a row meets through its own ``width`` edges and as many of the edges to it, drawn by hash, so a row
that is near a great many (a hub) costs no more than others. The meetings of a block of rows (a bounded number on
average) come to one task, with the vector of each row that meets there once; the task measures the pairs and gives the edges
that may be among a row's ``width`` nearest, at most ``width`` for each row. Rounds are written to the shared
folder. The driver gets counts only.

Rows with a null id or a null or empty vector are left out; ids are unique; vectors have one length and no nulls."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from veerline.operators.sampling import global_rank
from veerline.operators.wordvectors import word_vectors
from veerline.session import ensure_checkpoint_dir

BLOCK_ROWS = 40_000        # rows whose meetings one task holds, with the vectors of all that meet there
CELLS = 4_000_000          # components and pairs that a task works on at once
HELD = 4_000_000           # found edges that a task holds before it cuts them


def _writer(df: DataFrame) -> Callable[[DataFrame, str], DataFrame]:
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/neighbours/{uuid.uuid4().hex[:12]}"

    def written(part: DataFrame, name: str) -> DataFrame:
        part.write.parquet(f"{folder}/{name}")
        return spark.read.schema(part.schema).parquet(f"{folder}/{name}")

    return written


def _distances(v: np.ndarray, holed: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances in doubles, summed in order of the components; -1 (before all others) where one is missing."""
    out, step = np.zeros(len(i)), max(1, CELLS // max(1, v.shape[1]))
    for at in range(0, len(i), step):
        x, y = i[at:at + step], j[at:at + step]
        d = v[x].astype(np.float64) - v[y]
        out[at:at + step] = np.cumsum(d * d, axis=1)[:, -1] if v.shape[1] else 0.0
    return np.where(holed[i] | holed[j], -1.0, out)


def _rows_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as a matrix, and which of them lack a component."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    ends, flat = lists.offsets.to_numpy(), lists.values
    size, width = np.diff(ends), int(np.diff(ends).max(initial=0))
    gaps = np.concatenate(([0], np.cumsum(np.asarray(flat.is_null()))))
    holed = (size != width) | (gaps[ends[1:]] > gaps[ends[:-1]])
    out = np.zeros((len(size), width), flat.type.to_pandas_dtype())
    whole = np.flatnonzero(~holed)
    if len(whole) == len(size):
        return flat.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False).reshape(out.shape), holed
    values = np.asarray(flat.fill_null(0))
    for r in whole:
        out[r] = values[ends[r]:ends[r + 1]]
    return out, holed


def _cut(a: np.ndarray, b: np.ndarray, d: np.ndarray, width: int, once: bool, copies: bool) -> tuple[np.ndarray, ...]:
    """Of each row the ``width`` nearest edges; ``once``: each edge once, with its least distance (``copies``: it may
    have several)."""
    order = np.lexsort((d, b, a) if once and copies else (b, d, a))
    a, b, d = a[order], b[order], d[order]
    if once:
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, d = a[new], b[new], d[new]
        if copies:
            order = np.lexsort((b, d, a))
            a, b, d = a[order], b[order], d[order]
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(a)), bool), a[1:] != a[:-1])))
    keep = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a)))) < width
    return a[keep], b[keep], d[keep]


def _meet(width: int, once: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block's meetings (a, m, fresh) and the rows that meet there (id, v, worst) -> edges (a, b, d) that may be
    among the ``width`` nearest of a: no farther than its last one today (``worst``)."""
    def run(links: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids, worst = rows["id"].to_numpy(), rows["worst"].to_numpy().copy()
        v, holed = _rows_of(rows["v"])
        with np.errstate(all="ignore"):
            square = (v.astype(np.float64) ** 2).sum(axis=1)
        same = np.searchsorted(ids, ids)                     # the first row of an id; rows that repeat one all meet
        copies = bool((same != np.arange(len(ids))).any())
        m = links["m"].to_numpy()
        low, high = np.searchsorted(ids, m), np.searchsorted(ids, m, "right")
        at = np.repeat(np.arange(len(m)), high - low)
        m = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        group, fresh = links["a"].to_numpy()[at], links["fresh"].to_numpy().astype(bool)[at]
        order = np.lexsort((~fresh, m, group))               # a row that meets twice: once, fresh if either is
        group, m, fresh = group[order], m[order], fresh[order]
        new = np.ones(len(m), bool)
        new[1:] = (group[1:] != group[:-1]) | (m[1:] != m[:-1])
        group, m, fresh = group[new], m[new], fresh[new]
        start = np.flatnonzero(np.concatenate((np.ones(min(1, len(m)), bool), group[1:] != group[:-1])))
        size = np.diff(np.append(start, len(m)))
        most = int(size.max(initial=1))
        step = max(1, CELLS // (most * max(most, v.shape[1], 1)))
        found, held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
        upper = np.triu(np.ones((most, most), bool), 1)
        for at in range(0, len(start), step):
            first, n = start[at:at + step], size[at:at + step]
            known = np.arange(most) < n[:, None]
            place = np.where(known, first[:, None] + np.arange(most), 0)
            who, new = m[place], fresh[place] & known
            with np.errstate(all="ignore"):                  # rough distances choose, exact ones decide
                x = v[who].astype(np.float64)
                both = square[who][:, :, None] + square[who][:, None, :]
                rough = both - 2 * np.matmul(x, x.transpose(0, 2, 1)) - 1e-10 * both
                far = (rough > worst[who][:, :, None]) & (rough > worst[who][:, None, :])
            gap, name = holed[who], same[who]
            far &= ~(gap[:, :, None] | gap[:, None, :])
            apart = name[:, :, None] != name[:, None, :] if copies else True
            g, i, j = np.nonzero(upper & apart & known[:, :, None] & known[:, None, :] & (new[:, :, None] | new[:, None, :]) & ~far)
            i, j = who[g, i], who[g, j]
            d = _distances(v, holed, i, j)
            for p, q in ((i, j), (j, i)):
                near = ~(d > worst[p])
                found.append((same[p[near]], same[q[near]], d[near]))
                held += int(near.sum())
            if held > HELD:
                found = [_cut(*(np.concatenate(c) for c in zip(*found, strict=True)), width, once, copies)]
                a, held = found[0][0], 0
                last = np.flatnonzero(np.append(a[1:] != a[:-1], True))
                full = last[np.diff(np.append(-1, last)) == width]
                worst[a[full]] = np.where(found[0][2][full] < worst[a[full]], found[0][2][full], worst[a[full]])
                worst = worst[same]
        a, b, d = _cut(*(np.concatenate(c) for c in zip(*found, strict=True)), width, once, copies)
        return pa.table([pa.array(ids[a], pa.int64()), pa.array(ids[b], pa.int64()), pa.array(d, pa.float64(), mask=d < 0)], ["a", "b", "d"])
    return run


def _measured(links: DataFrame, vectors: DataFrame, edges: DataFrame | None, width: int, n: int) -> DataFrame:
    """Rows m that meet at a row a, (a, m, fresh) -> edges (a, b, d, fresh) both ways between two of them, one of them
    fresh, as far as they may be among the ``width`` nearest of a.

    The meetings of a block of rows come to one task, with the vectors of the rows that meet there: a vector is sent
    once to a block, not once for each pair. Blocks are drawn by hash and have ``BLOCK_ROWS`` rows at most on average."""
    blocks = max(min(4, -(-n // 5000)), -(-n // BLOCK_ROWS))
    met = links.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int"))
    far = F.lit(float("inf"))
    if edges is None:
        rows = vectors.withColumn("worst", far)
    else:
        last = edges.groupBy("a").agg(F.when(F.count(F.lit(1)) >= width, F.coalesce(F.max("d"), F.lit(-1.0))).alias("worst"))
        rows = vectors.join(last, F.col("id") == F.col("a"), "left").select("id", "v", F.coalesce("worst", far).alias("worst"))
    needed = met.select(F.col("m").alias("id"), F.col("block").alias("to")).repartition("id").distinct()
    sent = needed.join(rows, "id").select("to", "id", "v", "worst")
    found = met.groupBy("block").cogroup(sent.groupBy("to")).applyInArrow(_meet(width, edges is not None), "a bigint, b bigint, d double")
    return found.select("a", "b", "d", F.lit(True).alias("fresh"))


def _nearest(edges: DataFrame, by: str, other: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy("d", other))
    return edges.withColumn("rank", rank).where(F.col("rank") <= k)


def _start(vectors: DataFrame, width: int, n: int) -> DataFrame:
    """Meetings of every row with ``width`` rows at hashed ranks of a shuffled order, or with all rows of a small table."""
    ranked = global_rank(vectors.select("id"), F.md5(F.col("id").cast("string")), ["id"]).select("id", (F.col("rank") - 1).alias("at"))
    steps = ranked.select(F.col("id").alias("a"), "at", F.explode(F.sequence(F.lit(1), F.lit(min(width, n - 1)))).alias("step"))
    target = F.col("at") + F.col("step") if n <= width + 1 else F.xxhash64("a", "step")
    met = steps.select("a", F.pmod(target, F.lit(n)).alias("at")).join(ranked.withColumnRenamed("id", "b"), "at").where("a <> b")
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("m")).distinct()
    return pairs.withColumn("fresh", F.lit(False)).unionByName(
        vectors.select(F.col("id").alias("a"), F.col("id").alias("m"), F.lit(True).alias("fresh")))


def _meetings(edges: DataFrame, width: int, turn: int) -> DataFrame:
    """The rows that a row a links, by its own edges and ``width`` of the edges to it, where one of them is fresh."""
    drawn = F.row_number().over(Window.partitionBy("b").orderBy(F.xxhash64("a", "b", F.lit(turn)), "a"))
    back = edges.withColumn("no", drawn).where(F.col("no") <= width).select(F.col("b").alias("a"), F.col("a").alias("b"), "fresh")
    links = edges.select("a", "b", "fresh").unionByName(back)
    some = F.max("fresh").over(Window.partitionBy("a"))
    return links.select("a", F.col("b").alias("m"), "fresh", some.alias("some")).where("some").drop("some")


def neighbour_graph(df: DataFrame, id_col: str, vec_col: str, k: int = 15, width: int | None = None, rounds: int = 12,
                    settle: float = 0.001) -> DataFrame:
    """(id, neighbour, distance, rank): the ``k`` nearest other rows of each row by Euclidean distance, ties to
    the smaller id; all other rows where there are no more than ``k``. Found by descent, so a neighbour may be
    missed: the recall is that of the data (measured in the tests). Ends when at most ``settle`` of the edges
    are new, or after ``rounds``. ``width`` (at least ``k``; twice ``k`` unless given) is what the search keeps: a
    wider one finds more of the nearest and costs its square."""
    width = max(k, width or 2 * k)
    written = _writer(df)
    narrow = isinstance(df.schema[vec_col].dataType.elementType, FloatType)
    vectors = written(df.where(F.col(id_col).isNotNull() & (F.size(vec_col) > 0))
                      .select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast(f"array<{'float' if narrow else 'double'}>").alias("v")),
                      "vectors")
    n = vectors.count()
    if n < 2:
        return _as_graph(vectors.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("d")).limit(0), k)
    edges = written(_nearest(_measured(_start(vectors, width, n), vectors, None, width, n), "a", "b", width).drop("rank"), "start")
    for turn in range(rounds):
        found = _measured(_meetings(edges, width, turn), vectors, edges, width, n)
        merged = (edges.withColumn("fresh", F.lit(False)).unionByName(found).repartition("a").groupBy("a", "b")
                  .agg(F.min("d").alias("d"), F.min("fresh").alias("fresh")))
        edges = written(_nearest(merged, "a", "b", width).drop("rank"), f"round={turn}")
        if edges.where("fresh").count() <= settle * n * min(width, n - 1):
            break
    return _as_graph(edges, k)


def _as_graph(edges: DataFrame, k: int) -> DataFrame:
    return _nearest(edges, "a", "b", k).select(F.col("a").alias("id"), F.col("b").alias("neighbour"),
                                               F.sqrt("d").alias("distance"), F.col("rank").cast("int").alias("rank"))


def affinities(graph: DataFrame) -> DataFrame:
    """(a, b, x), symmetric: exp(-d^2 / (s_a s_b)) with s the distance of a row's last neighbour; the mean of both
    directions, an edge that only one end has counts half. Equal rows have weight 1;
    a row with equal neighbours only takes the other end's scale."""
    scale = graph.groupBy("id").agg(F.max("distance").alias("s"))
    edges = (graph.join(scale, "id").join(scale.select(F.col("id").alias("neighbour"), F.col("s").alias("t")), "neighbour"))
    s, t = (F.when(F.col(c) == 0, F.col(o)).otherwise(F.col(c)) for c, o in (("s", "t"), ("t", "s")))
    weight = F.when(F.col("distance") == 0, 1.0).otherwise(F.exp(-F.col("distance") * F.col("distance") / (s * t)))
    ways = F.array(F.struct(F.col("id").alias("a"), F.col("neighbour").alias("b")), F.struct(F.col("neighbour").alias("a"), F.col("id").alias("b")))
    return (edges.select(F.explode(ways).alias("e"), (weight / 2).alias("x")).groupBy("e.a", "e.b").agg(F.sum("x").alias("x"))
            .where("x > 0"))


def smoothed(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, x): half the identity plus half the normalised graph, so that its eigenvalues go from 0 to 1 and the
    smoothest vectors come first; and (a, degree)."""
    degree = cells.groupBy("a").agg(F.sum("x").alias("degree"))
    other = degree.select(F.col("a").alias("b"), F.col("degree").alias("other"))
    half = cells.join(degree, "a").join(other, "b").select("a", "b", (F.col("x") / F.sqrt(F.col("degree") * F.col("other")) / 2).alias("x"))
    return half.unionByName(degree.select("a", F.col("a").alias("b"), F.lit(0.5).alias("x"))), degree


def reduce_by_neighbours(df: DataFrame, id_col: str, vec_col: str, dims: int, k: int = 15, extra: int = 24, rounds: int = 12) -> DataFrame:
    """V8: (id, reduced): ``dims`` coordinates of each row that change little along the edges of the neighbour graph:
    the eigenvectors after the first (constant) one, over the square root of the row's degree. Signs: the largest
    entry of an eigenvector is positive. Fewer coordinates when there are too few rows."""
    written = _writer(df)
    graph = written(neighbour_graph(df, id_col, vec_col, k), "graph")
    cells, degree = smoothed(written(affinities(graph), "affinities"))
    text = cells.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "x")
    found = word_vectors(text, dims + 1, extra, rounds).vectors
    named = degree.withColumn("word", F.col("a").cast("string"))
    return named.join(found, "word").select(
        F.col("a").alias("id"), F.transform(F.slice("y", 2, dims), lambda x: x / F.sqrt("degree")).alias("reduced"))
