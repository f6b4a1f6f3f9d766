"""Learned vectors against plain counting and a dense solution."""

import math
from collections import Counter

import numpy as np

from tests.conftest import SF_SMALL
from veerline.operators import wordvectors as W
from veerline.plans import vector_queries as Q


def dense(cells):
    words = sorted({c["a"] for c in cells})
    at = {w: i for i, w in enumerate(words)}
    m = np.zeros((len(words), len(words)))
    for c in cells:
        m[at[c["a"]], at[c["b"]]] = c["x"]
    return words, m


def test_counts_and_information_against_plain_counting(spark):
    texts = ["a b c a b", "b a", "a a a", "c", "", "x a b x"] * 3
    docs = spark.createDataFrame([(i, t.split() or None) for i, t in enumerate(texts)], "id int, words array<string>")
    got = {(r["a"], r["b"]): r["n"] for r in W.cooccurrences(docs, "words", 2, 6).collect()}
    seen, pairs = Counter(w for t in texts for w in t.split()), Counter()
    for t in texts:
        w = t.split()
        for i in range(len(w)):
            for j in range(i + 1, min(i + 3, len(w))):
                pairs[w[i], w[j]] += 1
                pairs[w[j], w[i]] += 1
    expected = {p: n for p, n in pairs.items() if all(seen[w] >= 6 for w in p)}
    assert got == expected
    total, sums = sum(expected.values()), Counter()
    for (a, _), n in expected.items():
        sums[a] += n
    x = {(r["a"], r["b"]): r["x"] for r in W.positive_information(W.cooccurrences(docs, "words", 2, 6)).collect()}
    plain = {p: math.log(n * total / (sums[p[0]] * sums[p[1]])) for p, n in expected.items()}
    assert x.keys() == {p for p, v in plain.items() if v > 0} and all(abs(x[p] - plain[p]) < 1e-12 for p in x)


def test_pairs_are_counted_once(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"])], "id int, words array<string>")
    counts = W.cooccurrences(docs, "words", 2, 1)
    assert counts.inputFiles() and all("/vectors/pairs-" in f for f in counts.inputFiles())


def test_leading_values_and_vectors_against_a_dense_solution(spark):
    cells = Q.associations(spark, SF_SMALL)
    found = W.word_vectors(cells, 8, extra=40, rounds=14)
    words, m = dense(cells.collect())
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(-np.abs(values))[:8]
    assert np.allclose(found.values, values[order], rtol=1e-3)
    rows = {r["word"]: r["y"] for r in found.vectors.collect()}
    mine = np.array([rows[w] for w in words])
    assert np.allclose(mine.T @ mine, np.eye(8), atol=1e-6)
    for k in range(8):
        assert np.abs(m @ mine[:, k] - found.values[k] * mine[:, k]).max() < 0.02 * abs(found.values[k])
        assert mine[:, k].max() >= -mine[:, k].min() - 1e-9


def test_low_rank_empty_and_partitions(spark):
    schema = "a string, b string, x double"
    one = spark.createDataFrame([(a, b, 1.0) for a in "abc" for b in "abc"], schema)
    found = W.word_vectors(one, 4, extra=4)
    assert len(found.values) == 1 and abs(found.values[0] - 3) < 1e-9
    assert all(abs(r["y"][0] - 3 ** -0.5) < 1e-9 for r in found.vectors.collect())
    assert W.word_vectors(one.limit(0), 4).values == []
    cells = Q.associations(spark, SF_SMALL)
    a, b = (W.word_vectors(cells.repartition(n), 4, extra=8, rounds=1).values for n in (1, 5))
    assert np.allclose(a, b, rtol=1e-9)


def test_text_vectors_are_means_of_known_words(spark):
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, -2.0])], "word string, vector array<double>")
    docs = spark.createDataFrame([(1, ["a", "a", "b", "zz"]), (2, ["zz", None]), (3, []), (4, None)], "id int, words array<string>")
    got = {r["id"]: (r["vector"], r["n_known"]) for r in W.embed_by_words(docs, "id", "words", vectors, 2).collect()}
    assert got[1][1] == 3 and np.allclose(got[1][0], [5 / 3, 2 / 3])
    assert got[2] == got[3] == got[4] == ([0.0, 0.0], 0)
    assert W.embed_by_words(docs.limit(0), "id", "words", vectors, 2).count() == 0
