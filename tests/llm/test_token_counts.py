import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.llm.helpers import clashing, docs, documents
from veerline.llm import token_counts as T
from veerline.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def counts(spark, rows, **kw):
    return [tuple(r) for r in T.token_counts(docs(spark, rows), MODEL, **kw).collect()]


def test_fixture_against_the_library(spark, library):
    got = QUERIES["op12_token_counts"](spark, SF_SMALL).toPandas().set_index("doc_id")
    table = documents().fillna({"text": ""}).set_index("doc_id")
    assert len(got) == len(table)
    for doc_id, text in table.text.items():
        n = len(library.encode(text))
        assert (got.n_bytes[doc_id], got.n_tokens[doc_id], got.over_limit[doc_id]) == (len(text.encode()), n, n > 4096)


def test_random_strings_against_the_library(library):
    rng = random.Random(7)
    letters = "abcdehilnorst  ▁\n\tèéüß中日本語😀\x00<s>0123456789aaa​́    "
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(5000)]
    assert T.PieceCounter(MODEL).count(texts) == [len(x) for x in library.encode(texts)]


def test_runs_on_both_sides_of_the_long_limit(library):
    texts = [c * n for c in ("a", "ab", " ", "é", "中", "-", "0", "\n", "😀") for n in (1, T.LONG // len(c), T.LONG + 1, 3 * T.LONG)]
    assert T.PieceCounter(MODEL).count(texts) == [len(x) for x in library.encode(texts)]


def test_queue_and_arrays_agree():
    rng = random.Random(3)
    model = T.PieceCounter(MODEL)
    words = ["".join(rng.choices("aaeinorstlh▁中\n", k=rng.randint(1, 60))) for _ in range(800)]
    assert model.merged(words) == [model.merged_long(w) for w in words]


def test_cuts_are_where_no_piece_crosses(library):
    model = T.PieceCounter(MODEL)
    pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    inner = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
    cut = model.pretokens("Some  words,\nand naïve   ones 中文\t!")
    assert "".join(cut) == library.normalize("Some  words,\nand naïve   ones 中文\t!")
    for a, b in zip(cut, cut[1:], strict=False):
        assert a[-1] + b[0] not in inner


def test_memory_of_pretokens_is_bounded(monkeypatch, library):
    monkeypatch.setattr(T, "REMEMBERED", 5)
    model = T.PieceCounter(MODEL)
    texts = [f"word{i} another{i}" for i in range(50)]
    assert [model.count([t])[0] for t in texts] == [len(x) for x in library.encode(texts)]
    assert len(model.seen) < 30


def test_nulls_empty_special_repeated_and_long(spark, library):
    long = "one two three four five " * 40_000
    rows = [(1, None), (2, ""), (3, "<s></s><unk>"), (4, " "), (None, "x y"), (5, "same"), (5, "same"), (6, long)]
    expected = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in rows]
    assert sorted(counts(spark, rows), key=repr) == sorted(expected, key=repr)
    assert counts(spark, []) == []


def test_limit_is_the_last_count_allowed(spark, library):
    n = len(library.encode("a few words here"))
    assert [counts(spark, [(1, "a few words here")], limit=k)[0][3] for k in (n - 1, n)] == [True, False]


def test_clashing_columns_and_string_ids(spark):
    rows = docs(spark, [(1, "a b"), (2, "c")])
    extra = clashing(rows).withColumn("n_tokens", F.lit(9)).withColumn("n_bytes", F.lit(9))
    assert sorted(map(tuple, T.token_counts(extra, MODEL).collect())) == sorted(map(tuple, T.token_counts(rows, MODEL).collect()))
    named = rows.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r["doc_id"] for r in T.token_counts(named, MODEL).collect()} == {"d1", "d2"}


def test_a_missing_file_is_an_error():
    with pytest.raises(RuntimeError):
        T.PieceCounter("/nowhere.model")
