"""Neighbour graphs against all distances, and the reduction against a dense solution."""

import numpy as np
import pytest

from veerline.operators import neighbours as N

SF_LARGE = "/root/testdata/sf0.1"


def vectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    local = rows.toPandas()
    return rows, local.vec_id.to_numpy(), np.array([np.asarray(v, dtype=float) for v in local.embedding])


def exact(ids, x, k):
    order = np.argsort(ids)
    ids, x = ids[order], x[order]
    d = np.array([((x - row) ** 2).sum(axis=1) for row in x])
    np.fill_diagonal(d, np.inf)
    return {(int(ids[i]), int(ids[j])): float(d[i, j] ** 0.5) for i in range(len(ids)) for j in np.argsort(d[i], kind="stable")[:k]}


def test_recall_against_all_distances(spark):
    rows, ids, x = vectors(spark, SF_LARGE)
    want = exact(ids, x, 10)
    got = {(r.id, r.neighbour): (r.distance, r.rank) for r in N.neighbour_graph(rows, "vec_id", "embedding", 10).collect()}
    assert len(got) == len(want) == 10 * len(ids)
    assert len(got.keys() & want.keys()) >= 0.9 * len(want)
    assert all(abs(got[p][0] - want[p]) < 1e-9 for p in got.keys() & want.keys())
    assert sorted(r for _, r in got.values()) == sorted(list(range(1, 11)) * len(ids))


def test_small_tables_ties_and_odd_rows(spark):
    schema = "id long, v array<double>"
    same = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(5)] + [(9, [3.0, 4.0]), (None, [1.0, 1.0]), (7, None), (8, [])], schema)
    got = {(r.id, r.neighbour): (r.distance, r.rank) for r in N.neighbour_graph(same, "id", "v", 15).collect()}
    assert got.keys() == {(a, b) for a in (0, 1, 2, 3, 4, 9) for b in (0, 1, 2, 3, 4, 9) if a != b}
    assert got[9, 0] == (5.0, 1) and got[9, 4] == (5.0, 5) and got[0, 1] == (0.0, 1) and got[0, 9] == (5.0, 5)
    assert N.neighbour_graph(same.limit(0), "id", "v").count() == 0
    assert N.neighbour_graph(same.where("id = 1"), "id", "v").count() == 0
    assert N.reduce_by_neighbours(same.limit(0), "id", "v", 2).count() == 0
    assert N.reduce_by_neighbours(same, "id", "v", 2, k=3, extra=4, rounds=2).count() == 6


def test_a_hub_and_partitions(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]                       # a sphere, all of it near its centre
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    a, b = ({(r.id, r.neighbour, r.rank) for r in N.neighbour_graph(df.repartition(n), "id", "v", 6).collect()} for n in (1, 7))
    assert a == b
    want = exact(np.arange(301), np.vstack((x, np.zeros(6))), 6)
    assert len({p[:2] for p in a} & want.keys()) >= 0.95 * len(want)


@pytest.mark.parametrize("shape", ["ring", "three groups"])
def test_coordinates_against_a_dense_solution(spark, shape):
    rng = np.random.default_rng(2)
    if shape == "ring":
        t = np.sort(rng.uniform(0, 2 * np.pi, 120))
        x = np.stack((np.cos(t), np.sin(t)), axis=1)
    else:
        x = np.concatenate([rng.normal(c, 0.6, size=(40, 2)) for c in ((0, 0), (2, 0), (0, 2.5))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    graph = N.neighbour_graph(df, "id", "v", 8)
    cells = N.affinities(graph).collect()
    w = np.zeros((120, 120))
    for c in cells:
        w[c.a, c.b] = c.x
    far = np.zeros((120, 120))
    for r in graph.collect():
        far[r.id, r.neighbour] = r.distance
    s = far.max(axis=1)
    plain = np.where(far > 0, np.exp(-far ** 2 / np.outer(s, s)), 0.0)
    assert np.allclose(w, (plain + plain.T) / 2, atol=1e-12)
    degree = w.sum(axis=1)
    values, dense = np.linalg.eigh(np.eye(120) / 2 + w / np.sqrt(np.outer(degree, degree)) / 2)
    got = {r.id: r.reduced for r in N.reduce_by_neighbours(df, "id", "v", 3, k=8, extra=40, rounds=10).collect()}
    y = np.array([got[i] for i in range(120)]) * np.sqrt(degree)[:, None]
    assert np.allclose(y.T @ y, np.eye(3), atol=1e-6)
    m = np.eye(120) / 2 + w / np.sqrt(np.outer(degree, degree)) / 2
    assert np.allclose(np.diag(y.T @ m @ y), values[::-1][1:4], atol=1e-3)
    assert np.abs(m @ y - y * values[::-1][1:4]).max() < 0.01


def test_meetings_give_only_what_may_stay(spark):
    x = np.random.default_rng(3).normal(size=(200, 5))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    links = vectors.selectExpr("0L as a", "id as m", "true as fresh")
    found = N._measured(links, vectors, None, 7, 200)
    got = {(r.a, r.b): r.d for r in found.collect()}
    want = exact(np.arange(200), x, 7)
    assert found.count() == len(got) == 7 * 200 and got.keys() == want.keys()     # not all pairs
    assert all(abs(got[p] ** 0.5 - want[p]) < 1e-12 for p in got)
    assert {(r.a, r.b) for r in N._measured(links, vectors, found, 7, 200).collect()} == got.keys()     # nothing nearer
    assert N._measured(links.withColumn("fresh", links.m < 0), vectors, found, 7, 200).count() == 0


def test_repeated_ids_and_missing_components(spark):
    schema = "id long, v array<float>"
    df = spark.createDataFrame([(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [None, 1.0]), (4, [0.0, 1.0])], schema)
    got = {(r.id, r.neighbour): r.distance for r in N.neighbour_graph(df, "id", "v", 10).collect()}
    assert got.keys() == {(a, b) for a in range(1, 5) for b in range(1, 5) if a != b}
    assert got[1, 2] == got[2, 1] == 5.0 and got[1, 4] == 1.0 and got[1, 3] is got[3, 4] is None
