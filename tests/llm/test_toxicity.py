"""Toxicity: restoring hidden words, Viterbi against all paths, held-out accuracy, odd rows."""

import zlib
from itertools import product

import numpy as np
import pandas as pd
import pytest

from tests.conftest import SF_MID
from tests.llm.helpers import clashing, docs
from veerline.llm import queries
from veerline.llm.toxicity import (
    HINTS,
    SUSPECT,
    TAIL_HINT,
    TAILED,
    Restorer,
    _code,
    character_model,
    count_characters,
    decode,
    evidence,
    lattice,
    toxicity_scores,
)


@pytest.fixture(scope="module")
def model(spark):
    return character_model(count_characters(spark.read.parquet(f"{SF_MID}/documents.parquet")))


def test_held_out_accuracy(spark):
    out = queries.QUERIES["op9_toxicity"](spark, SF_MID).toPandas()
    labels = pd.read_parquet(f"{SF_MID}/labels.parquet")
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.7)).all()
    held = out[out.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.toxic).mean() > 0.93
    assert (held.predicted[held.toxic == 0] == 0).mean() > 0.98


def test_character_counts(spark):
    texts = ["ab  c\nd", "É1", "", None, "abcd"]
    counts = count_characters(docs(spark, list(enumerate(texts))).coalesce(1))
    # every text by itself, with runs of white space as one; no string crosses two texts
    want = {}
    for t in texts:
        stream = (t or "").encode()
        symbols = [0 if c in b" \n" else c - 96 if 97 <= c <= 122 else c - 64 if 65 <= c <= 90 else 27 if c > 127 else 28 for c in stream]
        symbols = [s for i, s in enumerate(symbols) if s or not i or symbols[i - 1]]
        for i in range(len(symbols) - 3):
            want[tuple(symbols[i:i + 4])] = want.get(tuple(symbols[i:i + 4]), 0) + 1
    assert {tuple(map(int, k)): int(counts[tuple(k)]) for k in np.argwhere(counts)} == want


def test_hidden_words_are_restored(model):
    r = Restorer(model)
    for hidden, plain in [("1d10t", "idiot"), ("i d i o t", "idiot"), ("idiooot", "idiot"), ("w0rthl3ss", "worthless"),
                          ("m.o.r.o.n", "moron"), ("l0ser", "loser"), ("L-O-S-E-R", "loser")]:
        assert r.restore(f"the {hidden} and") == f"the {plain} and"
    for clean in ("the 2nd of 226.203.165.104 and", "a$$$ thouhe$$$ sh!!", "plain words. are left\nalone, always", ""):
        assert r.restore(clean) == clean


def test_counts_do_not_depend_on_the_split(spark, monkeypatch):
    rows = [(i, ("word%d  of\ttext " % i) * (i % 7)) for i in range(60)]
    whole = count_characters(docs(spark, rows).coalesce(1))
    assert (count_characters(docs(spark, rows).repartition(5)) == whole).all()
    assert whole.sum() == sum(max(0, len(" ".join(t.split())) + (t != "") - 3) for _, t in rows)


@pytest.mark.parametrize("hidden, word", [
    ("i  d  i  o  t", "idiot"), ("i/d/i/o/t", "idiot"), ("i - d - i - o - t", "idiot"), ("i**d**i**o**t", "idiot"), ("i|d|i|o|t", "idiot"),
    ("i\nd\ni\no\nt", "idiot"), ("s.c*u.m", "scum"), ("b a d", "bad"), ("idi" + "o" * 50 + "t", "idiot"), ("1d" + "1" * 2 + "o" * 30 + "t", "idiot"),
    ("m1serabl3" + "w0rthl3ss" * 3, "miserable" + "worthless" * 3)])
def test_wide_gaps_short_words_and_long_runs_are_restored(model, hidden, word):
    found = Restorer(model).restore(f"the {hidden} and")
    assert found == f"the {word} and" or hidden.startswith("1d11") and found.startswith("the idi") and found.endswith("ot and")


def test_words_that_end_in_signs_count_both_ways(model):
    r = Restorer(model)
    for hidden, plain, read in [("a$$", "a", "ass"), ("dumba55", "dumba", "dumbass"), ("id1o7", "idio", "idiot")]:
        assert r.restore(f"the {hidden} and")[4:5] == hidden[0]
        assert read in r.marks(f"the {hidden} and") and {"the", "and"} <= r.marks(f"the {hidden} and")
        assert plain == "idio" or plain in r.marks(f"the {hidden} and")
    assert r.marks("plain words only") == r.marks("PLAIN words only") and r.marks("") == set()


def test_long_hidden_spans_are_read_whole(model):
    r = Restorer(model)
    spaced = " ".join("idiot" * 4000)
    assert r.restore(spaced).replace(" ", "") == "idiot" * 4000
    assert len(r.restore("ab1" * 20_000)) == 60_000


def test_every_mark_counts():
    odds = {f"w{i}": 2.0 for i in range(40)}
    scores = [evidence(set(list(odds)[:n]), odds) for n in range(41)]
    assert scores[0] == 0 and scores[1] == 2 and all(a < b for a, b in zip(scores, scores[1:], strict=False)) and scores[40] < 2 + 0.25 / 0.125 * 2


def test_hints_miss_no_match():
    rng = np.random.default_rng(3)
    for _ in range(20_000):
        text = "".join(rng.choice(list("ab1$! ._/*Z\n"), rng.integers(1, 14))).lower()
        assert not SUSPECT.search(text) or any(h.search(" " + text) for h in HINTS), text
        assert not TAILED.search(text) or TAIL_HINT.search(text), text


def test_viterbi_is_the_best_of_all_paths(model):
    for span in ("1d10t", "i.d 1.o", "aaab", "b@d!1", "s-c-u-m", "i//d//1//t", "b*t*c*h"):
        def score(text):
            total, last = 0.0, (0, 0, 0)
            for ch in text + " ":
                total += float(model[(*last, _code(ch))])
                last = (*last[1:], _code(ch))
            return total
        paths = ["".join(p) for p in product(*lattice(span))]
        assert abs(score(decode(span, model)) - max(map(score, paths))) < 1e-3


def test_odd_rows(spark):
    rows = [(i, f"some words in here number{i} " + ("idiot" if i % 4 == 0 else "friend")) for i in range(200)]
    odd = [(300, None), (301, ""), (302, "words " * 200_000 + " 1d10t"), (None, "an idiot"), (303, "i d i o t"), (303, "i d i o t"), (304, "!!!")]
    labels = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0) for i in range(200)] + [(300, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity_scores(clashing(docs(spark, rows + odd)), labels).collect()
    assert len(out) == 207
    got = {r.doc_id: r.predicted for r in out}
    assert all(got[i] == (1 if i % 4 == 0 else 0) for i in range(200))
    assert (got[300], got[301], got[302], got[303], got[304], got[None]) == (0, 0, 1, 1, 0, 1)
    assert toxicity_scores(docs(spark, []), labels).count() == 0
    assert all(r.predicted == 0 for r in toxicity_scores(docs(spark, rows), labels.where("toxic = 0")).collect())
