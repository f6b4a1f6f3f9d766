"""Array elements looked up block by block: the plans of encoding and decoding, and rows against a plain-Python statement."""

import random

import pytest
from pyspark.sql import functions as F

from veerline.operators import blocks as B
from veerline.operators import docs as D

TABLE = [(1, "a"), (2, "b"), (3, "c"), (3, "b"), (4, "long piece"), (5, "")]


def folded(rows):
    """What every key's elements find, by place and then by value; an element that finds nothing gives '-'."""
    found = {x: sorted(v for k, v in TABLE if k == x) or ["-"] for x in (None, *range(8))}
    out = {}
    for k, xs in rows:
        out.setdefault(k, []).extend((p, v) for p, x in enumerate(xs or []) for v in found[x])
    return {k: [v for _, v in sorted(items)] for k, items in out.items()}


@pytest.mark.parametrize("keys", [[None, 1, 2, 3], list(range(40)), [*range(39), 3]])
@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_elements_find_their_rows(spark, keys, size):
    rng = random.Random(size)
    rows = [(keys[i % len(keys)], None if i % 9 == 4 else [rng.choice([None, 1, 2, 3, 4, 5, 6]) for _ in range(rng.randrange(12))]) for i in range(40)]
    table = spark.createDataFrame(TABLE, "x int, v string")
    blocks = B.in_blocks(spark.createDataFrame(rows, "k bigint, xs array<int>"), "k", "xs", size)
    got = B.look_up(blocks, "k", table, "x", F.coalesce("v", F.lit("-")), "vs").collect()
    assert {r["k"]: r["vs"] for r in got} == folded(rows) and len(got) == len(folded(rows))


def test_blocks_hold_each_element_once(spark):
    rows = [(i, [f"t{(i * j) % 300}" for j in range(50)]) for i in range(100)]
    blocks = B.in_blocks(spark.createDataFrame(rows, "k int, xs array<string>").coalesce(1), "k", "xs", 2000).collect()
    assert len({b["block"] for b in blocks}) == len(blocks) == 3
    assert sorted(k for b in blocks for k in b["keys"]) == list(range(100)) and all(sum(b["sizes"]) <= 2000 for b in blocks)
    assert all(len(set(b["items"])) == len(b["items"]) == b["n"] <= 300 for b in blocks)


def test_empty_input_and_nested_keys(spark):
    table = spark.createDataFrame(TABLE, "x int, v string")
    docs = spark.createDataFrame([(1, "a b", [1, 6]), (2, None, [])], "k int, `s t` string, xs array<bigint>").select(F.struct("k", "s t").alias("id"), "xs")
    found = lambda df: B.look_up(B.in_blocks(df, "id", "xs"), "id", table, "x", F.coalesce("v", F.lit("-")), "vs").collect()
    assert found(docs.limit(0)) == []
    assert {(r["id"]["k"], r["id"]["s t"]): r["vs"] for r in found(docs)} == {(1, "a b"): ["a", "-"], (2, None): []}


def test_repeated_documents_are_one_text(spark):
    """As when every token was shuffled: documents of one id are folded together by place, then by id and by piece."""
    docs = spark.createDataFrame([(1, ["b", "a", None]), (1, ["c"]), (None, ["d"]), (None, []), (2, None), (3, ["a", "d"])], "id int, tokens array<string>")
    vocab, ids = D.vocabulary_and_ids(docs, "id", "tokens")
    at = {r["token"]: r["token_id"] for r in vocab.collect()}
    assert sorted(at.values()) == [4, 5, 6, 7]
    first = sorted([at["b"], at["c"]])
    expect = {1: [*first, at["a"], D.UNK_ID], None: [at["d"]], 2: [], 3: [at["a"], at["d"]]}
    assert {r["id"]: r["ids"] for r in ids.collect()} == expect
    decoded = {r["id"]: r["decoded"] for r in D.decode_pieces(docs.select("id", F.transform("tokens", lambda t: F.when(t == "b", at["b"]).otherwise(
        F.when(t == "c", at["c"]).otherwise(F.when(t == "d", at["d"]))).cast("bigint")).alias("ids")), "id", "ids", vocab).collect()}
    assert decoded == {1: "bc", None: "d", 2: "", 3: "d"}


def test_only_distinct_elements_of_blocks_are_shuffled(spark):
    docs = spark.createDataFrame([(i, [f"t{j % 5}" for j in range(200)]) for i in range(30)], "id int, tokens array<string>")
    vocab, ids = D.vocabulary_and_ids(docs, "id", "tokens")
    decoded = D.decode_pieces(ids, "id", "ids", vocab)
    for df in (ids, decoded):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "posexplode(items" in plan and plan.count("explode(") == 1
    assert ids.count() == decoded.count() == 30
