"""Golden values for token, vector and evaluation helpers."""

from pyspark.sql import functions as F

from veerline.operators import docs as D
from veerline.operators import evaluate as E
from veerline.operators import vectors as V


def vocab(spark):
    return spark.createDataFrame([("play", 4), ("##ing", 5), ("ball", 6), ("<s>", 7)], "token string, token_id bigint")


def test_decode_pieces_special_token_rules(spark):
    ids = spark.createDataFrame([(1, [2, 4, 5, 3, 6, 1, 7, 0]), (2, None), (3, [])], "k int, ids array<bigint>")
    got = {r["k"]: r["decoded"] for r in D.decode_pieces(ids, "k", "ids", vocab(spark)).collect()}
    # [CLS] removed, '##' removed, [SEP] -> blank, [UNK] removed, '<s>' removed, [PAD] kept
    assert got == {1: "playing ball[PAD]", 2: "", 3: ""}


def test_decode_whole_keeps_special_tokens(spark):
    ids = spark.createDataFrame([(1, [2, 4, 5, 6, 3])], "k int, ids array<bigint>")
    assert D.decode_whole(ids, "k", "ids", vocab(spark)).first()["decoded"] == "[CLS] playing ball [SEP]"


def test_truncate_and_mask(spark):
    df = spark.createDataFrame([(list(range(10, 20)),)], "ids array<bigint>")
    t = df.select(D.truncate_tokens("ids", 5).alias("t")).first()["t"]
    assert t == [2, 10, 11, 12, 3]
    m = df.select(D.attention_mask(F.array(*[F.lit(x) for x in (2, 10, 3, 0)])).alias("m")).first()["m"]
    assert m == [True, True, False, False]


def test_cosine_distance_and_zero_vector(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])],
                               "a array<double>, b array<double>")
    got = [r["d"] for r in df.select(V.cosine_distance("a", "b").alias("d")).collect()]
    assert abs(got[0] - 1.0) < 1e-12 and abs(got[1]) < 1e-12 and got[2] is None


def test_letter_counts(spark):
    df = spark.createDataFrame([("abca",)], "t string")
    assert df.select(V.letter_counts("t", "abc").alias("v")).first()["v"] == [2.0, 1.0, 1.0]


def test_importance_prefixes_are_anchored(spark):
    ratios = spark.createDataFrame([("posts_embedding_1", 0.25), ("reposts_embedding_1", 0.5), ("posts_like", 0.25)],
                                   "feature string, importance_ratio double")
    got = {r["prefix"]: r["ratio"] for r in E.importance_by_prefix(ratios).collect()}
    assert got == {"posts_embedding": 0.25, "reposts_embedding": 0.5, "posts_like": 0.25}


def test_outcomes(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (1, 0), (0, 0), (2, 1)], "label int, pred int")
    rows = df.select(E.outcome_binary("label", "pred").alias("o"), E.outcome_multiclass("label", "pred").alias("m")).collect()
    assert [r["o"] for r in rows] == ["tp", "fp", "fn", "tn", None]
    assert [r["m"] for r in rows] == ["t1", "f0", "f1", "t0", "f2"]
    assert df.select(E.argmax_prediction(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.5))).alias("a")).first()["a"] == 1


def test_encode_with_checked_broadcast(spark):
    docs = spark.createDataFrame([(1, ["ball", "play", "x"]), (2, [])], "k int, tokens array<string>")
    plain = {r["k"]: r["ids"] for r in D.encode_tokens(docs, "k", "tokens", vocab(spark)).collect()}
    small = {r["k"]: r["ids"] for r in D.encode_tokens(docs, "k", "tokens", vocab(spark), broadcast_max_rows=10).collect()}
    over = {r["k"]: r["ids"] for r in D.encode_tokens(docs, "k", "tokens", vocab(spark), broadcast_max_rows=2).collect()}
    assert plain == small == over == {1: [6, 4, 1], 2: []}


def test_ids_are_folded_in_natural_order_without_a_comparator(spark):
    docs = spark.createDataFrame([(1, [f"t{i % 7}" for i in range(300)]), (2, []), (3, None)], "id bigint, tokens array<string>")
    vocab, ids = D.vocabulary_and_ids(docs, "id", "tokens")
    at = {r["token"]: r["token_id"] for r in vocab.collect()}
    assert {r["id"]: r["ids"] for r in ids.collect()} == {1: [at[f"t{i % 7}"] for i in range(300)], 2: [], 3: []}
    decoded = D.decode_pieces(ids, "id", "ids", vocab)
    assert all("array_sort" not in x._jdf.queryExecution().optimizedPlan().toString() for x in (ids, decoded))


def test_checked_broadcast_shows_in_plan(spark):
    import io
    from contextlib import redirect_stdout
    docs = spark.createDataFrame([(1, ["ball"])], "k int, tokens array<string>")
    buf = io.StringIO()
    with redirect_stdout(buf):
        D.encode_tokens(docs, "k", "tokens", vocab(spark), broadcast_max_rows=10).explain()
    assert "BroadcastHashJoin" in buf.getvalue()


def test_metrics_on_empty_input(spark):
    empty = spark.createDataFrame([], "label int, pred int")
    m = E.binary_metrics(empty).first()
    assert (m["accuracy"], m["precision"], m["tp"]) == (0.0, 0.0, 0)
    gains = spark.createDataFrame([(0, "f", 0.0)], "fold int, feature string, gain double")
    assert E.importance_mean_ratio(gains, 5).first()["importance_ratio"] == 0.0


def test_hashed_embedding_idf_pca(spark):
    df = spark.createDataFrame([(i, f"word{i % 3} common text {i}") for i in range(20)], "k int, t string")
    out = V.hashed_embedding(df, "t", dim=64, idf=True, pca_k=4).collect()
    assert len(out) == 20 and all(len(r["embedding"]) == 4 for r in out)
    plain = V.hashed_embedding(df, "t", dim=64).collect()
    assert all(abs(sum(x * x for x in r["embedding"]) - 1.0) < 1e-5 for r in plain)


def test_embed_text_with_factory(spark):
    import numpy as np

    def factory():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(1, "abc"), (2, None)], "k int, t string")
    got = {r["k"]: r["embedding"] for r in V.embed_text(df, "t", dim=2, encode_factory=factory).collect()}
    assert got == {1: [3.0, 1.0], 2: [0.0, 1.0]}
