"""Leaf-wise boosted trees as Spark jobs: M3 (two classes) and M5 (any number, softmax).

All fold models grow side by side, one tree per fold and class a round. Features are cut into quantile
bins once and the binned rows are written to the shared folder with their scores. A pass reads them,
walks every row down the trees so far and finds the best split of all open leaves:

* leaves with many rows send their (feature, bin) sums of gradients and Hessians, one row per task and leaf; the task
  of a leaf adds them up as they come; running sums over the bins give every split's gain, and one row per leaf comes back;
* leaves of at most ``local_rows`` rows send their binned rows, packed, to the task of that leaf, which goes on
  splitting there. Both ways give the same splits, and both go through one shuffle of one job.

Rows are kept in blocks (one table row with the bins of some thousand rows, feature by feature), so that a task walks a
tree by cutting the rows of a node in two and Spark moves few, large values.

The next leaf to split is always the one with the largest gain (best first, up to ``leaves``), not the
next of a level. The driver replays that order on the known splits; a pass asks for the leaves the order
reaches before their own split is known, so a tree takes about as many passes as it is deep.

Gradients, Hessians and losses are rounded to multiples of 1 / ``SCALE`` and added as integers: sums do not
depend on the order, so partitioning, lost executors and the two ways above change nothing.

A fit goes on where it stopped: scores are rows (written anew every ``rewrite_every`` rounds), trees
are only added, and early stopping takes the first trees of each model. The driver holds trees, bin
borders and one loss per fold and round; none grows with the rows."""

from __future__ import annotations

import heapq
import uuid
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veerline.session import ensure_checkpoint_dir

SCALE = 1 << 24
BINS = 256
CHUNK = 2_000_000     # cells (rows x features) a task works on at once
LOCAL_CELLS = 8_000_000

FOUND = "model int, node bigint, feature int, bin int, gain double, g bigint, h bigint, n bigint, gl bigint, hl bigint, nl bigint"
KINDS = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
STATE = "label binary, fold binary, bins binary, scores binary"


@dataclass(frozen=True)
class BoostParams:
    """Settings of a fit; the first group changes the trees, the second only how they are found.

    ``bin_rows``: rows (by a hash of the key, about that many) from which the bin borders are taken."""
    classes: int = 2
    max_rounds: int = 1000
    patience: int = 20
    learning_rate: float = 0.1
    leaves: int = 31
    min_rows: int = 20
    min_hessian: float = 1e-3
    max_bins: int = 255
    bin_rows: int = 200_000

    local_rows: int = 125_000         # fewer, if rows x features would pass LOCAL_CELLS
    max_cells: int = 4_000_000
    rewrite_every: int = 10

    @property
    def outputs(self) -> int:
        """Trees per fold and round."""
        return 1 if self.classes == 2 else self.classes


@dataclass(frozen=True)
class Split:
    """A node's best split: rows with bin <= ``bin`` go left. Sums in units of 1 / SCALE."""
    feature: int
    bin: int
    gain: float
    g: int
    h: int
    n: int
    gl: int
    hl: int
    nl: int

    def child(self, right: bool) -> tuple[int, int, int]:
        return (self.g - self.gl, self.h - self.hl, self.n - self.nl) if right else (self.gl, self.hl, self.nl)


@dataclass(frozen=True)
class Tree:
    """Splits by node (root 0, children 2i+1 and 2i+2) and the values of its leaves."""
    splits: dict[int, Split]
    values: dict[int, float]

    def arrays(self) -> tuple[np.ndarray, ...]:
        nodes, leaves = sorted(self.splits), sorted(self.values)
        return (np.array(nodes, np.int64), np.array([self.splits[i].feature for i in nodes], np.int64),
                np.array([self.splits[i].bin for i in nodes], np.int64), np.array(leaves, np.int64),
                np.array([self.values[i] for i in leaves], np.float64))


def array_column(df: DataFrame, name: str) -> Column:
    """A feature column (vector or array) as array<double>."""
    return vector_to_array(name) if isinstance(df.schema[name].dataType, VectorUDT) else F.col(name).cast("array<double>")


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of features; null rows and null components are NaN."""
    out = np.full((len(column), width), np.nan)
    if not width:                                        # a model without rows knows no feature
        return out
    full = np.flatnonzero(np.asarray(column.is_valid()))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(full) * width:
        raise ValueError("feature rows differ in length")
    out[full] = flat.reshape(len(full), width)
    return out


# --- binning ---------------------------------------------------------------------------------------------

def bin_borders(values: np.ndarray, max_bins: int) -> np.ndarray:
    """Upper borders of all bins but the last: the distinct values if they are few, else equal-count quantiles."""
    values = np.sort(values[~np.isnan(values)])
    distinct = np.unique(values)
    if len(distinct) > max_bins:
        at = -(-np.arange(1, max_bins) * len(values) // max_bins) - 1
        distinct = np.unique(np.r_[values[at], values[-1]])
    return distinct[:-1]


def learn_borders(rows: DataFrame, key: Sequence[str], params: BoostParams) -> list[np.ndarray]:
    """Bin borders of every feature, from about ``bin_rows`` rows chosen by a hash of the key (all, if they are fewer)."""
    n = rows.count()
    if n > params.bin_rows:
        rows = rows.where(F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < F.lit((params.bin_rows << 30) // n))
    values = rows.select(F.posexplode("features").alias("feature", "value"))
    max_bins = params.max_bins

    def borders(group: pd.DataFrame) -> pd.DataFrame:
        found = bin_borders(group["value"].to_numpy(float), max_bins)
        return pd.DataFrame({"feature": [int(group["feature"].iloc[0])], "borders": [found.tolist()]})

    found = values.groupBy("feature").applyInPandas(borders, "feature int, borders array<double>").collect()
    out = [np.empty(0)] * (max((r["feature"] for r in found), default=-1) + 1)
    for r in found:
        out[r["feature"]] = np.array(r["borders"], float)
    return out


def binned(features: np.ndarray, borders: list[np.ndarray]) -> np.ndarray:
    """Bin of each value (NaN: the last)."""
    return np.stack([np.searchsorted(b, features[:, i], "left") for i, b in enumerate(borders)], 1).astype(np.uint8) \
        if borders else np.zeros((len(features), 0), np.uint8)


def _blocks(batch: pa.RecordBatch, borders: list[np.ndarray], base: list[float]) -> Iterator[pa.RecordBatch]:
    step = max(1, CHUNK // max(1, len(borders)))
    for at in range(0, len(batch), step):
        rows = batch.slice(at, step)
        bins = binned(matrix(rows.column("features"), len(borders)), borders)
        label, fold = (rows.column(c).to_numpy().astype(np.int32) for c in ("label", "fold"))
        yield _packed(label, fold, bins.T, np.tile(np.array(base, float), (len(rows), 1)))


def _packed(label: np.ndarray, fold: np.ndarray, bins: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    """Rows as one table row: labels, folds, bins (feature by feature) and scores (row by row)."""
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (label, fold, bins, scores)],
                                      ["label", "fold", "bins", "scores"])


def _unpacked(batch: pa.RecordBatch, width: int, models: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(label, fold, bins (features, rows), scores (rows, models)) of every block of a batch."""
    for block in zip(*(batch.column(c) for c in ("label", "fold", "bins", "scores")), strict=True):
        label, fold, bins, scores = (x.as_buffer() for x in block)
        label, fold = np.frombuffer(label, np.int32), np.frombuffer(fold, np.int32)
        yield (label, fold, np.frombuffer(bins, np.uint8).reshape(width, len(label)),
               np.frombuffer(scores, float).reshape(len(label), models).copy())


def _bin_batches(borders: list[np.ndarray], base: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _blocks(batch, borders, base)
    return run


# --- gradients, trees over rows --------------------------------------------------------------------------

def probabilities(scores: np.ndarray) -> np.ndarray:
    """(rows, outputs) raw scores to probabilities: of class 1, or of every class."""
    if scores.shape[1] == 1:
        return 1 / (1 + np.exp(-scores))
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients(scores: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the log-loss by output, in whole multiples of 1 / SCALE."""
    p, k = probabilities(scores), scores.shape[1]
    y = label[:, None] if k == 1 else label[:, None] == np.arange(k)
    factor = 1.0 if k == 1 else k / (k - 1)
    return np.rint((p - y) * SCALE).astype(np.int64), np.rint(factor * p * (1 - p) * SCALE).astype(np.int64)


def losses(scores: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Log-loss by row, in whole multiples of 1 / SCALE."""
    p = probabilities(scores)
    p = np.where(label == 1, p[:, 0], 1 - p[:, 0]) if scores.shape[1] == 1 else p[np.arange(len(p)), label]
    return np.rint(-np.log(np.clip(p, 1e-15, None)) * SCALE).astype(np.int64)


def rows_by_node(tree: tuple[np.ndarray, ...], bins: np.ndarray, rows: np.ndarray, wanted: set[int] | None = None) -> dict[int, np.ndarray]:
    """The rows (numbers of columns of ``bins``) by the node they end in; ``wanted``: only below these nodes."""
    at = {0: rows}
    for node, feature, border in zip(*(x.tolist() for x in tree[:3]), strict=True):      # parents come first
        mine = at.pop(node, None)
        if mine is not None and (wanted is None or node in wanted):
            right = bins[feature].take(mine) > border
            at[2 * node + 1], at[2 * node + 2] = mine[~right], mine[right]
    return at


def add_trees(scores: np.ndarray, bins: np.ndarray, trees: list[list[tuple]]) -> None:
    """Add what the trees of every model give its column of ``scores``."""
    rows = np.arange(len(scores))
    for m, more in enumerate(trees):
        for tree in more:
            values = dict(zip(tree[3].tolist(), tree[4].tolist(), strict=True))
            for node, mine in rows_by_node(tree, bins, rows).items():
                scores[mine, m] += values[node]


def cell_sums(bins: np.ndarray, rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(3, features, bins): sums of ``g`` and ``h`` and numbers of some rows; whole numbers far below 2^53."""
    width, bins, g, h = len(bins), bins.take(rows, 1), g[rows], h[rows]
    if len(rows) < BINS:
        cell = (bins + np.arange(width)[:, None] * BINS).ravel()
        return np.stack([np.bincount(cell, np.tile(x, width), width * BINS) for x in (g, h, np.ones(len(g)))]).reshape(3, width, BINS)
    out = np.empty((3, width, BINS))
    g, h = g.astype(float), h.astype(float)
    for f in range(width):
        x = bins[f].astype(np.intp)
        out[0, f], out[1, f], out[2, f] = np.bincount(x, g, BINS), np.bincount(x, h, BINS), np.bincount(x, minlength=BINS)
    return out


@dataclass(frozen=True)
class _Pass:
    """What the tasks of a pass know."""
    width: int
    outputs: int
    all_rows: frozenset[int]            # folds without held-out rows: they learn from all
    recent: list[list[tuple]]           # per model: trees that are not in the written scores
    growing: list[tuple]                # per model: the tree that grows
    large: dict[int, list[int]]         # per model: nodes whose split is asked for and found from sums
    small: dict[int, list[int]]         # the same from rows
    slots: dict[tuple[int, int], int]   # (model, node) -> the partition that finds its splits
    loss: bool

    def wanted(self, m: int) -> set[int]:
        """The nodes above those asked for."""
        out = set()
        for node in (*self.large.get(m, ()), *self.small.get(m, ())):
            while node:
                node = (node - 1) // 2
                out.add(node)
        return out


PARTS = "slot int, model int, node bigint, sums binary, bins binary, g binary, h binary"


def _part(slot: int, model: int, node: int, *values: np.ndarray | None) -> pa.RecordBatch:
    kinds = [("slot", pa.int32()), ("model", pa.int32()), ("node", pa.int64())]
    arrays = [pa.array([x], kind) for x, (_, kind) in zip((slot, model, node), kinds, strict=True)]
    arrays += [pa.array([None if x is None else x.tobytes()], pa.binary()) for x in values]
    return pa.RecordBatch.from_arrays(arrays, [*(n for n, _ in kinds), "sums", "bins", "g", "h"])


def _part_batches(p: _Pass):
    """Of every asked node its sums (large nodes, one row per task) or its rows, packed by block; a fold's held-out
    loss as node -1."""
    wanted = {m: p.wanted(m) for m in range(len(p.growing))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        loss: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(2, np.int64))
        for batch in batches:
            for label, fold, bins, scores in _unpacked(batch, p.width, len(p.growing)):
                add_trees(scores, bins, p.recent)
                for f in range(len(p.growing) // p.outputs):
                    mine = slice(f * p.outputs, (f + 1) * p.outputs)
                    held = fold == f if f not in p.all_rows else np.zeros(len(fold), bool)
                    if p.loss and held.any():
                        loss[f] += [losses(scores[held, mine], label[held]).sum(), held.sum()]
                    asked = [m for m in range(mine.start, mine.stop) if p.large.get(m) or p.small.get(m)]
                    if not asked:
                        continue
                    g, h = (x.T.copy() for x in gradients(scores[:, mine], label))
                    learning = np.flatnonzero(~held)
                    for m in asked:
                        at, gm, hm = rows_by_node(p.growing[m], bins, learning, wanted[m]), g[m - mine.start], h[m - mine.start]
                        for node in p.large.get(m, ()):
                            if len(at[node]):
                                if (m, node) not in sums:
                                    sums[m, node] = np.zeros((3, p.width, BINS), np.int64)
                                sums[m, node] += cell_sums(bins, at[node], gm, hm).astype(np.int64)
                        for node in p.small.get(m, ()):
                            if len(rows := at[node]):
                                yield _part(p.slots[m, node], m, node, None, bins.take(rows, 1), gm[rows], hm[rows])
        for (m, node), x in sums.items():
            yield _part(p.slots[m, node], m, node, x, None, None, None)
        for f, x in loss.items():
            yield _part(0, f, -1, x, None, None, None)
    return run


# --- splits ----------------------------------------------------------------------------------------------

def best_of(sums: np.ndarray, params: BoostParams) -> Split | None:
    """The best split of a node from its sums by (feature, bin). Ties: the lowest feature, then the lowest bin."""
    sums = sums.astype(float)
    gl, hl, nl = np.cumsum(sums, 2)
    gt, ht, nt = (float(x) for x in sums[:, 0].sum(1)) if sums.shape[1] else (0.0, 0.0, 0.0)
    least = max(int(params.min_hessian * SCALE), 1)
    if ht < 2 * least:
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl * gl / hl + (gt - gl) * (gt - gl) / (ht - hl) - gt * gt / ht
    fits = (np.minimum(nl, nt - nl) >= params.min_rows) & (np.minimum(hl, ht - hl) >= least) & (gain > 0)
    if not fits.any():
        return None
    f, b = np.unravel_index(np.where(fits, gain, -1.0).argmax(), gain.shape)
    return Split(int(f), int(b), float(gain[f, b]), int(gt), int(ht), int(nt), int(gl[f, b]), int(hl[f, b]), int(nl[f, b]))


def best_first(known: dict[int, Split | None], params: BoostParams) -> tuple[dict[int, Split], list[int]]:
    """Splits in best-first order as far as ``known`` tells, and the nodes reached whose own split is not known."""
    chosen, unknown, queue = {}, [], []

    def reach(node: int) -> None:
        if node not in known:
            unknown.append(node)
        elif known[node] is not None:
            heapq.heappush(queue, (-known[node].gain, node))

    reach(0)
    while queue and len(chosen) < params.leaves - 1:
        node = heapq.heappop(queue)[1]
        chosen[node] = known[node]
        reach(2 * node + 1)
        reach(2 * node + 2)
    return chosen, unknown


def finished_tree(splits: dict[int, Split], learning_rate: float) -> Tree:
    """Leaf values from the sums on both sides of the splits (no split: a tree that adds nothing)."""
    values = {}
    for node, s in splits.items():
        for right in (False, True):
            child = 2 * node + 1 + right
            if child not in splits:
                g, h, _ = s.child(right)
                values[child] = -g / h * learning_rate
    return Tree(splits, values or {0: 0.0})


def splits_here(top: int, bins: np.ndarray, g: np.ndarray, h: np.ndarray, params: BoostParams) -> dict[int, Split]:
    """All splits below a small node, best first. Sums of the larger child of a split with many rows are its own
    less those of the smaller one (whole numbers: exactly the same)."""
    found, queue = {}, []

    def reach(node: int, rows: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray | None:
        if len(rows) < 2 * params.min_rows:
            return None
        sums = cell_sums(bins, rows, g, h) if sums is None else sums
        s = best_of(sums, params)
        if s is not None:
            heapq.heappush(queue, (-s.gain, node, s, rows, sums if len(rows) > 4 * BINS else None))
        return sums

    reach(top, np.arange(len(g)))
    while queue and len(found) < params.leaves - 1:
        _, node, s, rows, sums = heapq.heappop(queue)
        found[node] = s
        right = bins[s.feature].take(rows) > s.bin
        children = sorted([(2 * node + 1, rows[~right]), (2 * node + 2, rows[right])], key=lambda x: len(x[1]))
        less = reach(*children[0])
        reach(*children[1], None if sums is None or less is None else sums - less)
    return found


def _split_batches(params: BoostParams, width: int):
    """Splits from the parts of a partition's nodes: the best one of a node's sums, or all below a small node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        rows: dict[tuple[int, int], list[tuple]] = defaultdict(list)
        for batch in batches:
            for model, node, *values in zip(*(batch.column(c).to_pylist() for c in ("model", "node", "sums", "bins", "g", "h")), strict=True):
                if values[0] is None:
                    rows[model, node].append(values[1:])
                else:
                    x = np.frombuffer(values[0], np.int64)
                    sums[model, node] = sums[model, node] + x if (model, node) in sums else x
        found = []
        for (model, node), x in sums.items():
            s = Split(-1, 0, 0.0, int(x[0]), 0, int(x[1]), 0, 0, 0) if node < 0 else best_of(x.reshape(3, width, BINS), params)
            found += [] if s is None else [(model, node, s)]
        for model, top in list(rows):
            parts = rows.pop((model, top))
            bins = np.concatenate([np.frombuffer(x[0], np.uint8).reshape(width, len(x[1]) // 8) for x in parts], 1)
            g, h = (np.concatenate([np.frombuffer(x[k], np.int64) for x in parts]) for k in (1, 2))
            found += [(model, node, s) for node, s in splits_here(top, bins, g, h, params).items()]
        if found:
            table = [(model, node, s.feature, s.bin, s.gain, s.g, s.h, s.n, s.gl, s.hl, s.nl) for model, node, s in found]
            schema = pa.schema([(c.split()[0], KINDS[c.split()[1]]) for c in FOUND.split(", ")])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*table, strict=True), schema, strict=True)], schema=schema)
    return run


# --- the fit ---------------------------------------------------------------------------------------------

@dataclass
class BoostedModel:
    """The trees of every fold and class up to the chosen round, with thresholds on raw values."""
    borders: list[np.ndarray]
    trees: list[list[Tree]]
    base: list[float]
    outputs: int

    @property
    def folds(self) -> int:
        return len(self.trees) // self.outputs

    def predict(self, rows: DataFrame, key: Sequence[str], features: str = "features") -> DataFrame:
        """M4: (key..., fold, prob of class 1), or with several classes (key..., fold, probs); one pass over the rows."""
        at = array_column(rows, features)
        trees, base, borders, outputs = [[t.arrays() for t in m] for m in self.trees], self.base, self.borders, self.outputs
        names = list(key)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = np.ascontiguousarray(binned(matrix(batch.column("_features"), len(borders)), borders).T)
                scores = np.tile(np.array(base, float), (len(batch), 1))
                add_trees(scores, bins, trees)
                probs = [probabilities(scores[:, f:f + outputs]).tolist() for f in range(0, len(trees), outputs)]
                folds = pa.array([list(row) for row in zip(*probs, strict=True)], pa.list_(pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), folds], [*names, "_probs"])

        chosen = rows.select(*names, at.alias("_features"))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "_features")
        scored = chosen.mapInArrow(run, f"{kinds}, _probs array<array<double>>").select(*names, F.posexplode("_probs").alias("fold", "probs"))
        return scored if outputs > 1 else scored.select(*names, "fold", F.get("probs", F.lit(0)).alias("prob"))

    def tree_table(self, spark: SparkSession) -> DataFrame:
        """(fold, class, round, node, feature, threshold, gain, n, value): inner nodes and leaves of all trees."""
        rows = []
        for m, trees in enumerate(self.trees):
            for r, tree in enumerate(trees, 1):
                at = (m // self.outputs, m % self.outputs, r)
                rows += [(*at, i, s.feature, float(self.borders[s.feature][s.bin]), s.gain / SCALE, s.n, None) for i, s in tree.splits.items()]
                rows += [(*at, i, None, None, None, None, v) for i, v in tree.values.items()]
        return spark.createDataFrame(rows, "fold int, class int, round int, node bigint, feature int, threshold double, gain double, n bigint, value double")

    def save(self, spark: SparkSession, path: str) -> str:
        """The tree table with one more row per model (round 0: number of features, starting score), by fold."""
        start = [(m // self.outputs, m % self.outputs, 0, -1, len(self.borders), None, None, None, b) for m, b in enumerate(self.base)]
        table = self.tree_table(spark)
        table.unionByName(spark.createDataFrame(start, table.schema)).coalesce(1).write.mode("overwrite").partitionBy("fold").parquet(path)
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedModel:
        """The model that ``save`` wrote; bin borders are the thresholds that occur in it."""
        rows = spark.read.parquet(path).collect()
        start = {(r["fold"], r["class"]): r for r in rows if r["round"] == 0}
        outputs, width = len({c for _, c in start}), max(r["feature"] for r in start.values())
        borders = [np.array(sorted({r["threshold"] for r in rows if r["feature"] == i and r["threshold"] is not None}), float) for i in range(width)]
        trees: list[list[Tree]] = [[] for _ in start]
        for r in sorted((r for r in rows if r["round"]), key=lambda r: r["round"]):
            own = trees[r["fold"] * outputs + r["class"]]
            while len(own) < r["round"]:
                own.append(Tree({}, {}))
            if r["value"] is not None:
                own[-1].values[r["node"]] = r["value"]
            else:
                at = int(np.searchsorted(borders[r["feature"]], r["threshold"]))
                own[-1].splits[r["node"]] = Split(r["feature"], at, r["gain"] * SCALE, 0, 0, r["n"], 0, 0, 0)
        return BoostedModel(borders, trees, [start[k]["value"] for k in sorted(start)], outputs)

    def gain_importance(self, spark: SparkSession, names: Sequence[str]) -> DataFrame:
        """M6: total gain per fold and feature."""
        name = F.get(F.array(*[F.lit(n) for n in names]), F.col("feature"))
        return (self.tree_table(spark).where("feature is not null").groupBy("fold", "feature").agg(F.sum("gain").alias("gain"))
                .select("fold", name.alias("feature"), "gain"))


@dataclass
class Boosting:
    """A fit in progress. ``run`` adds rounds until early stopping or a limit and can be called again."""
    params: BoostParams
    borders: list[np.ndarray]
    base: list[float]
    sizes: list[int]                 # training rows by fold
    held: list[int]                  # folds with held-out rows
    path: str
    state: DataFrame
    trees: list[list[Tree]]
    written: int = 0                 # rounds that the written scores hold
    rounds: int = 0
    stopped: bool = False
    loss: list[dict[int, float]] = field(default_factory=list)    # by round, from 0: fold -> held-out loss

    def _small(self, n: int) -> bool:
        """A node of so many rows is split by one task."""
        return n <= min(self.params.local_rows, LOCAL_CELLS // max(1, len(self.borders)))

    def _find(self, growing: list[dict], asked: dict[int, dict[int, int]], loss: bool) -> tuple[dict, dict[int, float]]:
        """Splits below the asked nodes (model -> node -> rows) and, if asked for, the held-out losses."""
        p, width = self.params, len(self.borders)
        local = {m: [i for i, n in nodes.items() if self._small(n)] for m, nodes in asked.items()}
        large = [(m, i) for m, nodes in asked.items() for i, n in nodes.items() if not self._small(n)]
        step = max(1, p.max_cells // max(1, width * BINS))
        jobs = [large[at:at + step] for at in range(0, len(large), step)] or [[]]
        here = [(m, i) for m, nodes in local.items() for i in nodes]
        recent = [[t.arrays() for t in trees[self.written:]] for trees in self.trees]
        partial = [Tree(splits, {}).arrays() for splits in growing]
        everyone = frozenset(range(len(self.sizes))) - frozenset(self.held)
        found, lost = defaultdict(dict), {}
        for k, sums in enumerate(jobs):
            rows = here if k == 0 else []
            nodes = sorted([*sums, *rows], key=lambda x: -asked[x[0]][x[1]])
            tasks = max(1, min(len(nodes), self.state.sparkSession.sparkContext.defaultParallelism))
            what = _Pass(width, p.outputs, everyone, recent, partial, _by_model(sums), _by_model(rows),
                         {at: i % tasks for i, at in enumerate(nodes)}, loss and k == 0)
            parts = self.state.mapInArrow(_part_batches(what), PARTS).repartitionById(tasks, F.col("slot"))
            for r in parts.mapInArrow(_split_batches(p, width), FOUND).collect():       # at most ``leaves`` rows per asked node
                if r["node"] < 0:
                    lost[r["model"]] = r["g"] / SCALE / r["n"]
                else:
                    found[r["model"]][r["node"]] = Split(*(r[c] for c in ("feature", "bin", "gain", "g", "h", "n", "gl", "hl", "nl")))
            for m, i in nodes:            # what no split was found for is a leaf
                found[m].setdefault(i, None)
        return found, lost

    def _grown(self) -> list[Tree] | None:
        """One more tree per model; None when early stopping says that the round is not needed."""
        p, models = self.params, len(self.trees)
        known: list[dict] = [{} for _ in range(models)]
        first, growing = True, [{} for _ in range(models)]
        while True:
            asked = {}
            for m in range(models):
                growing[m], unknown = best_first(known[m], p)
                for node in unknown:
                    up = growing[m].get((node - 1) // 2) if node else None
                    n = up.child(node % 2 == 0)[2] if up else self.sizes[m // p.outputs]
                    if n < 2 * p.min_rows or (up and self._small(up.n)):   # below a small node all splits are known
                        known[m][node] = None
                    else:
                        asked.setdefault(m, {})[node] = n
            if not asked and not first:
                if not any(best_first(known[m], p)[1] for m in range(models)):
                    return [finished_tree(splits, p.learning_rate) for splits in growing]
                continue
            found, lost = self._find(growing, asked, first)
            if first:
                self._note(lost)
                if self.stopped:
                    return None
            first = False
            for m, splits in found.items():
                known[m].update(splits)

    def _note(self, lost: dict[int, float]) -> None:
        """Keep the losses after ``rounds`` rounds and apply the stopping rule to the fold means."""
        if len(self.loss) == self.rounds:
            self.loss.append(lost)
        if self.held and self.rounds - self.best_round() >= self.params.patience:
            self.stopped = True

    def best_round(self) -> int:
        """The round with the lowest fold-mean held-out loss (the first one; without held-out rows: the last round)."""
        if not self.held or not self.loss:
            return self.rounds
        means = [sum(x.values()) / len(x) for x in self.loss]
        return means.index(min(means))

    def run(self, rounds: int | None = None) -> Boosting:
        """Up to ``rounds`` more rounds, ``max_rounds`` in all; stops early by the held-out loss or when no tree can split."""
        limit = min(self.params.max_rounds, self.rounds + (rounds or self.params.max_rounds))
        while not self.stopped and self.rounds < limit:
            grown = self._grown()
            if grown is None:
                break
            for m, tree in enumerate(grown):
                self.trees[m].append(tree)
            self.rounds += 1
            if not any(t.splits for t in grown):
                self.stopped = True
            elif self.rounds - self.written >= self.params.rewrite_every:
                self._rewrite()
        if len(self.loss) == self.rounds:              # the losses of the last round
            self._note(self._find([{} for _ in self.trees], {}, True)[1])
        return self

    def _rewrite(self) -> None:
        """Write the rows with their scores of today, so that later passes start from them."""
        width, recent = len(self.borders), [[t.arrays() for t in trees[self.written:]] for trees in self.trees]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for label, fold, bins, scores in _unpacked(batch, width, len(recent)):
                    add_trees(scores, bins, recent)
                    yield _packed(label, fold, bins, scores)

        self.state = _written(self.state.mapInArrow(add, self.state.schema), f"{self.path}/round={self.rounds}")
        self.written = self.rounds

    def model(self, rounds: int | None = None) -> BoostedModel:
        """The first trees of every model, up to ``rounds`` (None: the best round, at least one)."""
        n = max(1, self.best_round()) if rounds is None else rounds
        return BoostedModel(self.borders, [t[:n] for t in self.trees], self.base, self.params.outputs)

    def loss_table(self, spark: SparkSession) -> DataFrame:
        """(fold, round, loss): the held-out log-loss after every round; round 0 has the starting score alone."""
        rows = [(f, r, x) for r, by_fold in enumerate(self.loss) for f, x in sorted(by_fold.items())]
        return spark.createDataFrame(rows, "fold int, round int, loss double")


def _by_model(nodes: list[tuple[int, int]]) -> dict[int, list[int]]:
    out = defaultdict(list)
    for m, i in nodes:
        out[m].append(i)
    return dict(out)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def starting_scores(counts: dict[tuple[int, int], int], n_folds: int, params: BoostParams) -> tuple[list[float], list[int], list[int]]:
    """Per model the score of its classes' shares, training rows by fold, and the folds with held-out rows."""
    by_fold = [sum(n for (f, _), n in counts.items() if f == k) for k in range(n_folds)]
    total = sum(counts.values())
    base, sizes, held = [], [], []
    for k in range(n_folds):
        alone = 0 < by_fold[k] < total
        rest = {y: sum(n for (f, label), n in counts.items() if label == y and not (alone and f == k)) for y in range(params.classes)}
        size = sum(rest.values())
        sizes.append(size)
        if alone:
            held.append(k)
        share = [min(max(rest[y] / size, 1e-15), 1 - 1e-15) for y in range(params.classes)] if size else [0.5] * params.classes
        base += [float(np.log(share[1] / (1 - share[1])))] if params.outputs == 1 else [float(np.log(s)) for s in share]
    return base, sizes, held


def start_boosting(df: DataFrame, key: Sequence[str], features: str = "features", label: str = "label", fold: str = "fold",
                   n_folds: int = 5, params: BoostParams | None = None) -> Boosting:
    """Bin the rows and write them with their starting scores; ``run`` on the result trains.

    Model k learns from all folds but k (from all rows, when fold k is empty or everything) and is judged on fold
    k. Labels are 0 .. classes-1; rows without label or fold are left out; null features and NaN count as the largest value.
    Rows that repeat a key are rows of their own. No rows: a model without splits."""
    params = params or BoostParams()
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/boosting-{uuid.uuid4().hex[:12]}"
    rows = df.where(F.col(label).isNotNull() & F.col(fold).isNotNull()).select(
        *key, F.col(label).cast("int").alias("_label"), F.col(fold).cast("int").alias("_fold"), array_column(df, features).alias("_features"))
    rows = _written(rows.select(*key, F.col("_label").alias("label"), F.col("_fold").alias("fold"), F.col("_features").alias("features"))
                    if not {"label", "fold", "features"} & set(key) else
                    rows.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(key)], F.col("_label").alias("label"),
                                F.col("_fold").alias("fold"), F.col("_features").alias("features")), f"{path}/rows")
    keys = [c for c in rows.columns if c not in ("label", "fold", "features")]
    borders = learn_borders(rows, keys, params)
    counts = {(r["fold"], r["label"]): r["count"] for r in rows.groupBy("fold", "label").count().collect()}   # folds x classes
    base, sizes, held = starting_scores(counts, n_folds, params)
    narrow = rows.select("label", "fold", "features")
    state = _written(narrow.mapInArrow(_bin_batches(borders, base), STATE), f"{path}/round=0")
    return Boosting(params, borders, base, sizes, held, path, state, [[] for _ in base])
