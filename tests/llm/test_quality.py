"""Quality ranking: held-out accuracy, the Bradley-Terry optimum, odd rows."""

import zlib

import numpy as np
import pandas as pd

from tests.conftest import SF_MID
from tests.llm.helpers import clashing, docs
from veerline.llm import queries
from veerline.llm.quality import N_FEATURES, features, fit_ranking, learn_ranking, preference_pairs, quality_scores


def test_held_out_accuracy(spark):
    out = queries.QUERIES["op2_quality_ranking"](spark, SF_MID).toPandas()
    labels = pd.read_parquet(f"{SF_MID}/labels.parquet")
    assert len(out) == len(pd.read_parquet(f"{SF_MID}/documents.parquet", columns=["doc_id"]))
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()
    held = out[out.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.95


def test_fit_is_the_minimum_of_the_pair_loss():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, N_FEATURES))
    y = (x[:, 0] - 0.5 * x[:, 3] + rng.normal(size=400) > 0).astype(int)
    m = fit_ranking(x, y, 5000, 0.3)
    rng = np.random.default_rng(7)                      # the same preference pairs
    z = np.clip((x - m.mean) / m.scale, -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[rng.choice(good, 5000)] - z[rng.choice(bad, 5000)]
    loss = lambda w: np.logaddexp(0, -d @ w).mean() + 0.5e-3 * w @ w
    for k in range(N_FEATURES):
        for e in (-1e-3, 1e-3):
            assert loss(m.w) <= loss(m.w + e * np.eye(N_FEATURES)[k]) + 1e-12
    # the threshold is the quantile of the share labelled 0, and gets the accepted score
    assert abs((m.rank(x) < m.threshold).mean() - (y == 0).mean()) < 0.01
    assert abs(1 / (1 + np.exp(-np.log(0.3 / 0.7))) - 0.3) < 1e-9 and (m.score(x) >= 0.3).mean() == (m.rank(x) >= m.threshold).mean()


def test_features_are_finite():
    for t in (b"", b" ", b"\n\n", b"a", b"!" * 100_000, "é\U0001f600".encode() * 50):
        f = features(t)
        assert f.shape == (N_FEATURES,) and np.isfinite(f).all()


def test_odd_rows(spark):
    rows = [(i, "a plain sentence of words here. " * (1 + i % 3) if i % 4 else "bad$$$ words&&& here%%% " * 4) for i in range(80)]
    odd = [(100, None), (101, ""), (102, "w " * 300_000), (None, "a plain sentence"), (103, "x"), (103, "x")]
    labels = spark.createDataFrame([(i, 1 if i % 4 else 0) for i in range(80)] + [(100, None), (None, 1)], "doc_id long, quality int")
    out = quality_scores(clashing(docs(spark, rows + odd)), labels).collect()
    assert len(out) == 86 and all(0 <= r.score <= 1 for r in out)
    assert all(r.predicted == (1 if r.doc_id % 4 else 0) for r in out if r.doc_id is not None and r.doc_id < 80)
    assert quality_scores(docs(spark, []), labels).count() == 0
    alone = quality_scores(docs(spark, rows), labels.where("quality = 1")).collect()
    assert {round(r.score, 9) for r in alone} == {0.3}


def labelled(spark, x, y):
    return spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))], "_id long, x array<double>, y int")


def test_every_labelled_row_is_learned_from(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30_000, N_FEATURES))[:, :2]
    x = np.c_[x, np.zeros((30_000, N_FEATURES - 2))]
    y = (x[:, 0] > -0.5).astype(int)
    rows = labelled(spark, x[:300], y[:300])
    good, bad = int(y[:300].sum()), 300 - int(y[:300].sum())
    met = preference_pairs(rows, 1, good, bad, 10, 3).collect()
    assert len(met) == 3 * good and len({tuple(r.more) for r in met}) == good and len({tuple(r.less) for r in met}) == bad
    assert preference_pairs(rows, 1, good, bad, 60_000, 3).distinct().count() == good * bad    # few rows: all pairs
    m = learn_ranking(spark.createDataFrame(pd.DataFrame({"_id": range(30_000), "x": x.tolist(), "y": y}), "_id long, x array<double>, y int"), 1000, 0.3)
    np.testing.assert_allclose(m.mean, x.mean(axis=0), atol=1e-9)                              # no sample: the moments of all rows
    np.testing.assert_allclose(m.scale, np.maximum(x.std(axis=0), 1e-6), atol=1e-9)
    s = np.sort(m.rank(x))
    n = int((y == 0).sum())
    assert abs(m.threshold - (s[n - 1] + s[n]) / 2) < 1e-9
    assert abs(m.slope - 8 / (np.median(s[n:]) - np.median(s[:n]))) < 1e-6
