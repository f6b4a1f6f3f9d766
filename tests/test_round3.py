"""Subwords, row-balanced group folds, run tables, nested records."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from veerline.operators import docs as D
from veerline.operators import model as M
from veerline.operators import subword as S
from veerline.plans import subword_queries
from veerline.sources import io


def cut(word, vocab, max_chars=100):
    """Longest match from the left, character by character."""
    at, out = 0, []
    while at < len(word):
        size = next((n for n in range(len(word) - at, 0, -1) if ("##" if at else "") + word[at:at + n] in vocab), 0)
        if not size or len(word) > max_chars:
            return [D.UNK_ID]
        out.append(vocab[("##" if at else "") + word[at:at + size]])
        at += size
    return out or [D.UNK_ID]


def table(spark, vocab):
    return spark.createDataFrame(list(vocab.items()), "token string, token_id bigint")


def test_longest_match_against_a_plain_walk(spark):
    rng = random.Random(5)
    pieces = {"".join(rng.choices("abcé", k=rng.randint(1, 4))) for _ in range(60)}
    vocab = {t: i for i, t in enumerate([p for p in sorted(pieces)] + ["##" + p for p in sorted(pieces) if rng.random() < .7], 10)}
    rows = [(i, ["".join(rng.choices("abcéd", weights=[9, 9, 9, 3, 1], k=rng.randint(1, 9))) for _ in range(rng.randint(0, 12))]) for i in range(120)]
    rows += [(500, None), (501, []), (502, [None, "ab", None]), (503, ["a" * 100, "a" * 101, "##a", "##", ""])]
    got = {r["id"]: r["ids"] for r in S.encode_subwords(spark.createDataFrame(rows, "id bigint, words array<string>"), "id", "words", table(spark, vocab)).collect()}
    assert got == {i: [x for w in ws or [] if w is not None for x in cut(w, vocab)] for i, ws in rows}
    assert any(D.UNK_ID in ids for ids in got.values())


def test_empty_vocabulary_and_no_documents(spark):
    docs = spark.createDataFrame([(1, ["a", "b"])], "id bigint, words array<string>")
    assert S.encode_subwords(docs, "id", "words", table(spark, {"x": 9}).limit(0)).first()["ids"] == [D.UNK_ID] * 2
    assert S.encode_subwords(docs.limit(0), "id", "words", table(spark, {"x": 9})).count() == 0


def test_substrings_are_not_broadcast(spark):
    words = spark.createDataFrame([(f"word{i}",) for i in range(50)], "word string")
    found = S.longest_matches(words, table(spark, {"w": 4, "##o": 5}))
    assert found.count() == 100 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_both_decode_rules_fire_on_the_fixture(spark):
    ids, vocab = subword_queries.encoded(spark, SF_SMALL)
    tokens = {r["token_id"]: r["token"] for r in vocab.collect()}
    used = Counter(x for r in ids.collect() for x in r["ids"])
    inside = sum(n for x, n in used.items() if tokens.get(x, "").startswith("##"))
    assert inside and used[D.UNK_ID] and sum(used.values()) > inside + used[D.UNK_ID]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_group_folds_are_balanced_in_rows(spark, seed):
    rng = random.Random(seed)
    sizes = {g: int(rng.paretovariate(1)) for g in range(80)}
    rows = [(f"g{g}", g % 3) for g, n in sizes.items() for _ in range(min(n, 60))]
    df = spark.createDataFrame(rows, "account string, label int")
    got = M.stratified_group_folds(df, "account", seed=seed).collect()
    folds, per, largest = defaultdict(set), Counter(), Counter()
    for r in got:
        folds[r["account"]].add(r["fold"])
        per[r["label"], r["fold"]] += 1
    for g, n in sizes.items():
        largest[g % 3] = max(largest[g % 3], min(n, 60))
    assert len(got) == len(rows) and all(len(f) == 1 for f in folds.values())
    for label in range(3):
        counts = [per[label, k] for k in range(5)]
        assert max(counts) - min(counts) <= largest[label]


def test_group_folds_with_mixed_groups_and_nulls(spark):
    rows = [("a", 0), ("a", 1), ("a", 1), ("b", 0), (None, 0), (None, 1), ("c", None)]
    df = spark.createDataFrame(rows, "account string, label int")
    got = M.stratified_group_folds(df, "account", n_folds=2).collect()
    assert sorted(map(repr, ((r["account"], r["label"]) for r in got))) == sorted(map(repr, rows))
    assert all(len({r["fold"] for r in got if r["account"] == a}) == 1 for a in ("a", "b", "c", None))


def test_writing_a_run_again_replaces_only_that_run(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = lambda *folds: spark.createDataFrame([(f, "f1", f / 10) for f in folds], "fold int, metric string, value double")
    for run, folds in (("a", (0, 1, 2)), ("b", (0,)), ("a", (1, 5)), ("a", (1, 2))):
        io.replace_run(rows(*folds), path, run)
    assert sorted((r["run"], r["fold"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("a", 2), ("b", 0)]


def test_nested_ids_keep_nulls(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "id int, ids array<bigint>")
    back = {r["id"]: r["ids"] for r in io.nest_ids(df, "ids").collect()}
    assert back == {1: [[1, 2]], 2: [[]], 3: None}
