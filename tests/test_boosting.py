"""Leaf-wise boosting against a plain greedy fit, resuming, early stopping, odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from veerline.operators import boosting as B
from veerline.plans.model_queries import cv_and_test

UNIT = 1 << 24


def borders_of(values, max_bins=255):
    values = sorted(values)
    distinct = sorted(set(values))
    if len(distinct) > max_bins:
        n = len(values)
        distinct = sorted({values[-1]} | {values[math.ceil(q * n / max_bins) - 1] for q in range(1, max_bins)})
    return distinct[:-1]


def softmax(scores):
    top = max(scores)
    e = [math.exp(s - top) for s in scores]
    return [x / sum(e) for x in e]


class Greedy:
    """One fold's boosting by trying every border of every feature in every leaf, on lists of numbers."""

    def __init__(self, rows, fold, classes, leaves=31, rate=0.1, min_rows=20):
        self.train = [(x, y) for x, y, f in rows if f != fold]
        self.held = [(x, y) for x, y, f in rows if f == fold]
        self.outputs = 1 if classes == 2 else classes
        self.leaves, self.rate, self.min_rows = leaves, rate, min_rows
        columns = list(zip(*(x for x, _, _ in rows), strict=True))
        self.borders = [borders_of(c) for c in columns]
        share = [sum(y == k for _, y in self.train) / len(self.train) for k in range(classes)]
        self.base = [math.log(share[1] / (1 - share[1]))] if classes == 2 else [math.log(s) for s in share]
        self.trees, self.losses = [], []

    def score(self, x):
        out = list(self.base)
        for k, tree in self.trees:
            node = 0
            while node in tree["splits"]:
                feature, border = tree["splits"][node][:2]
                node = 2 * node + (1 if x[feature] <= border else 2)
            out[k] += tree["values"].get(node, 0.0)
        return out

    def probs(self, x):
        s = self.score(x)
        return [1 / (1 + math.exp(-s[0]))] if self.outputs == 1 else softmax(s)

    def best(self, members, g, h):
        gt, ht, found = sum(g[i] for i in members), sum(h[i] for i in members), None
        for feature, borders in enumerate(self.borders):
            order = sorted(members, key=lambda i: self.train[i][0][feature])
            at = gl = hl = 0
            for border in borders:
                while at < len(order) and self.train[order[at]][0][feature] <= border:
                    gl += g[order[at]]
                    hl += h[order[at]]
                    at += 1
                if min(at, len(order) - at) < self.min_rows:
                    continue
                gain = float(gl) * gl / hl + float(gt - gl) * (gt - gl) / (ht - hl) - float(gt) * gt / ht
                if gain > 0 and (found is None or gain > found[0]):
                    found = (gain, feature, border, len(order))
        return found

    def tree(self, g, h):
        rows, open_leaves, splits, values = {0: list(range(len(self.train)))}, {}, {}, {}
        open_leaves[0] = self.best(rows[0], g, h)
        while len(splits) < self.leaves - 1 and any(open_leaves.values()):
            node = min((n for n in open_leaves if open_leaves[n]), key=lambda n: (-open_leaves[n][0], n))
            gain, feature, border, n = open_leaves.pop(node)
            splits[node] = (feature, border, gain / UNIT, n)
            for right in (False, True):
                child = 2 * node + 1 + right
                rows[child] = [i for i in rows[node] if (self.train[i][0][feature] > border) == right]
                open_leaves[child] = self.best(rows[child], g, h)
        for leaf in open_leaves:
            if leaf:
                values[leaf] = -sum(g[i] for i in rows[leaf]) / sum(h[i] for i in rows[leaf]) * self.rate
        return {"splits": splits, "values": values}

    def loss(self):
        lost = 0
        for x, y in self.held:
            p = self.probs(x)
            lost += round(-math.log((p[0] if y == 1 else 1 - p[0]) if self.outputs == 1 else p[y]) * UNIT)
        return lost / UNIT / len(self.held)

    def run(self, rounds):
        self.losses.append(self.loss())
        for _ in range(rounds):
            p = [self.probs(x) for x, _ in self.train]
            new = []
            for k in range(self.outputs):
                wanted = [y if self.outputs == 1 else int(y == k) for _, y in self.train]
                factor = 1 if self.outputs == 1 else self.outputs / (self.outputs - 1)
                g = [round((q[k] - w) * UNIT) for q, w in zip(p, wanted, strict=True)]
                h = [round(factor * q[k] * (1 - q[k]) * UNIT) for q in p]
                new.append((k, self.tree(g, h)))
            self.trees += new
            self.losses.append(self.loss())
        return self


def table(model, spark):
    return {(r["fold"], r["class"], r["round"], r["node"]): (r["feature"], r["threshold"], r["n"], r["gain"] and round(r["gain"], 6),
                                                            r["value"] and round(r["value"], 9)) for r in model.tree_table(spark).collect()}


@pytest.mark.parametrize("classes,label,rounds", [(2, "label", 2), (3, "label3", 1)])
def test_equal_to_a_plain_greedy_fit(spark, classes, label, rounds):
    cv, _ = cv_and_test(spark, SF_SMALL)
    done = B.start_boosting(cv, ["vec_id"], label=label, params=B.BoostParams(classes=classes)).run(rounds)
    got = table(done.model(rounds), spark)
    rows = [(list(r[0]), r[1], r[2]) for r in cv.select("features", label, "fold").collect()]
    expected = {}
    for fold in range(5):
        plain = Greedy(rows, fold, classes).run(rounds)
        for i, (k, tree) in enumerate(plain.trees):
            at = (fold, k, i // plain.outputs + 1)
            expected |= {(*at, n): (f, b, size, round(gain, 6), None) for n, (f, b, gain, size) in tree["splits"].items()}
            expected |= {(*at, n): (None, None, None, None, round(v, 9)) for n, v in tree["values"].items()}
        assert [x[fold] for x in done.loss] == pytest.approx(plain.losses, abs=1e-6)
    assert got == expected


def grid(spark, n=300, folds=3):
    """Rows with equal values, nulls and NaN; the label follows the first feature."""
    rows = []
    for i in range(n):
        x = [float(i % 7), None if i % 11 == 0 else float(i % 5), float("nan") if i % 13 == 0 else i / n]
        rows.append((i, None if i % 29 == 0 else x, int(i % 7 > 3) if i % 3 else 1, i % folds))
    return spark.createDataFrame(rows, "id bigint, features array<double>, label int, fold int")


def test_both_ways_partitions_and_rewrites_give_the_same_trees(spark, classes=3):
    df = grid(spark).withColumn("label", F.when(F.col("id") % 10 == 0, classes - 1).otherwise(F.col("label")))
    kinds = [{}, {"local_rows": 0}, {"local_rows": 60, "rewrite_every": 1}, {"local_rows": 0, "max_cells": 3 * 256 * 4}]
    done = [B.start_boosting(df.repartition(1 + 3 * i), ["id"], n_folds=3, params=B.BoostParams(classes=classes, leaves=5, min_rows=5, **k)).run(2)
            for i, k in enumerate(kinds)]
    assert all(d.loss == done[0].loss and d.trees == done[0].trees for d in done)
    assert any(t.splits for t in done[0].trees[0])


def test_runs_go_on_where_they_stopped_and_stop_early(spark):
    start = lambda **k: B.start_boosting(grid(spark), ["id"], n_folds=3, params=B.BoostParams(leaves=4, min_rows=5, **k))
    whole, parts = start().run(6), start(rewrite_every=2).run(1).run(2).run(3)
    assert parts.trees == whole.trees and parts.loss == whole.loss and len(whole.loss) == 7
    assert start(max_rounds=2).run().rounds == 2
    early = start(patience=2).run(400)
    means = [sum(x.values()) / len(x) for x in early.loss]
    best = means.index(min(means))
    assert early.best_round() == best and (early.rounds == best + 2 or not any(t[-1].splits for t in early.trees))
    assert all(len(t) == max(1, best) for t in early.model().trees)


def test_best_first_order_and_the_number_of_leaves():
    def split(gain):
        return B.Split(0, 0, gain, 0, 1, 10, 0, 1, 5)
    known = {0: split(9.0), 1: split(1.0), 2: split(5.0), 5: split(4.0), 6: None, 11: split(3.0), 12: None}
    chosen, unknown = B.best_first(known, B.BoostParams(leaves=4))
    assert list(chosen) == [0, 2, 5] and unknown == []           # depth before the weaker sibling
    chosen, unknown = B.best_first(known, B.BoostParams(leaves=31))
    assert list(chosen) == [0, 2, 5, 11, 1] and unknown == [23, 24, 3, 4]


def test_saved_models_and_probabilities(spark, tmp_path):
    for classes in (2, 3):
        df = grid(spark).withColumn("label", F.when(F.col("id") % 10 == 0, classes - 1).otherwise(F.col("label")))
        model = B.start_boosting(df, ["id"], n_folds=3, params=B.BoostParams(classes=classes, leaves=5, min_rows=5)).run(3).model(3)
        again = B.BoostedModel.load(spark, model.save(spark, str(tmp_path / f"m{classes}")))
        one, two = (sorted(map(tuple, m.predict(df, ["id"]).collect())) for m in (model, again))
        assert one == two and len(one) == 900
        for _, _, p in one:
            assert 0 <= p <= 1 if classes == 2 else abs(sum(p) - 1) < 1e-12
        gains = model.gain_importance(spark, ["a", "b", "c"]).groupBy("fold").agg(F.sum("gain").alias("g")).collect()
        assert len(gains) == 3 and all(r["g"] > 0 for r in gains)


def test_few_rows_one_class_one_fold_and_none(spark):
    schema = "id bigint, features array<double>, label int, fold int"
    for rows in ([], [(1, [1.0], 1, 0)], [(i, [float(i)], 1, i % 5) for i in range(100)], [(i, [float(i)], i % 2, 0) for i in range(100)],
                 [(1, [1.0], None, 0), (2, [1.0], 0, None)]):
        done = B.start_boosting(spark.createDataFrame(rows, schema), ["id"]).run(3)
        model = done.model()
        probs = [r["prob"] for r in model.predict(spark.createDataFrame(rows[:3], schema), ["id"]).collect()]
        assert all(0 <= p <= 1 for p in probs) and len(probs) == 5 * len(rows[:3])


def test_borders_from_a_bounded_part_of_the_rows(spark):
    rows = spark.range(4000).select("id", F.array(F.col("id") / 7).alias("features"), (F.col("id") % 2).cast("int").alias("label"),
                                    (F.col("id") % 3).cast("int").alias("fold"))
    done = B.start_boosting(rows, ["id"], n_folds=3, params=B.BoostParams(bin_rows=1000, max_bins=16))
    assert 2 <= len(done.borders[0]) <= 16
    assert B.bin_borders(np.array([1.0, 1.0, 2.0, float("nan")]), 255).tolist() == [1.0]


def test_a_node_sends_one_row_of_sums_per_task_and_packed_rows(spark):
    """what a pass shuffles must not be a row per bin or per row of the table."""
    params = B.BoostParams(leaves=4, min_rows=5)
    fit = B.start_boosting(grid(spark).repartition(2), ["id"], n_folds=3, params=params)
    assert fit.state.count() <= 2                                   # blocks, not rows
    tree, trees = B.Tree({}, {}).arrays(), [[], [], []]
    for large in (True, False):
        nodes = {m: [0] for m in range(3)}
        what = B._Pass(3, 1, frozenset(), trees, [tree] * 3, nodes if large else {}, {} if large else nodes, {(m, 0): m for m in range(3)}, True)
        parts = fit.state.mapInArrow(B._part_batches(what), B.PARTS).collect()
        assert sum(r["node"] == 0 for r in parts) <= 6 and all((r["sums"] is not None) == large for r in parts if r["node"] == 0)


def test_sums_of_children_by_difference_and_by_rows_give_the_same_splits():
    rng = np.random.default_rng(5)
    bins = rng.integers(0, 200, (4, 6000)).astype(np.uint8)
    g = np.rint((0.5 - (bins[1] + 40 * rng.random(6000) > 130)) * UNIT).astype(np.int64)
    h = rng.integers(UNIT // 8, UNIT // 4, 6000)
    params = B.BoostParams(leaves=12)
    found = B.splits_here(0, bins, g, h, params)
    assert len(found) == 11
    trees = B.Tree(found, {}).arrays()
    for node, s in found.items():                                   # every split from the rows themselves
        above = {k: v for k, v in found.items() if k < node}
        rows = B.rows_by_node(B.Tree(above, {}).arrays(), bins, np.arange(6000))[node]
        assert B.best_of(B.cell_sums(bins, rows, g, h), params) == s and len(rows) == s.n
    leaves = B.rows_by_node(trees, bins, np.arange(6000))
    assert sorted(np.concatenate(list(leaves.values()))) == list(range(6000)) and len(leaves) == 12
