"""Language id: held-out accuracy on the fixture; code lengths against a plain PPM."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tests.llm.helpers import clashing, docs, documents
from tests.conftest import SF_SMALL
from veerline.llm import language_id, queries
from veerline.llm.language_id import FOLD, Ppm, count_grams, identify


def test_held_out_accuracy(spark):
    out = queries.QUERIES["op8_language_id"](spark, SF_SMALL).toPandas().set_index("doc_id")
    table = documents().set_index("doc_id")
    assert len(out) == len(table)
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.index]).all()
    held = out[out.held_out]
    assert (held.lang_pred == table.lang[held.index]).mean() > 0.98
    assert out.score.between(0, 1).all()


def plain_bits(train, text):
    """Textbook PPM-C with frozen counts: contexts of 3, 2, 1 and 0 bytes."""
    seen = defaultdict(Counter)
    for t in train:
        b = bytes(FOLD[list(b"\n\n\n" + t.encode())])
        for i in range(3, len(b)):
            for o in range(4):
                seen[b[i - o:i]][b[i]] += 1
    b = bytes(FOLD[list(b"\n\n\n" + text.encode())])
    bits = 0.0
    for i in range(3, len(b)):
        p = 1.0
        for o in (3, 2, 1, 0):
            c = seen.get(b[i - o:i])
            if not c:
                continue
            n, d = sum(c.values()), len(c)
            if c[b[i]]:
                p *= c[b[i]] / (n + d)
                break
            p *= d / (n + d)
        else:
            p /= 256
        bits -= math.log2(p)
    return bits


def test_code_lengths_are_those_of_ppm():
    train = {"x": ["the cat sat on the mat", "a cat is that"], "y": ["der hund und die katze", "und der"]}
    texts = ["the mat", "and the hat sat", "der katze", "the cat sat on the mat", "", "Die Katze!"]
    model = Ppm(["x", "y"], [count_grams(pa.array(train[k])) for k in ("x", "y")], 32)
    model.pair_id[:] = 0                                       # keep all pairs of the texts too
    pairs = sorted({int(a) << 8 | int(b) for t in texts + train["x"] + train["y"]
                    for s in [FOLD[list(b"\n\n\n" + t.encode())]] for a, b in zip(s[:-1], s[1:], strict=True)})
    model.pair_id[pairs] = np.arange(1, len(pairs) + 1)
    model.width = len(pairs) + 1
    model.bits = np.stack([model._code_lengths(g.astype(np.int64), n, np.array(pairs)).ravel()
                           for g, n in (count_grams(pa.array(train[k])) for k in ("x", "y"))], axis=1).astype(np.float32)
    got, _ = model.code_lengths(pa.array(texts))
    for i, t in enumerate(texts):
        for k, lang in enumerate(("x", "y")):
            assert abs(got[i, k] - plain_bits(train[lang], t)) < 1e-2


def test_long_texts_are_scored_in_pieces(monkeypatch):
    model = Ppm(["x"], [count_grams(pa.array(["the cat sat on the mat"]))], 32)
    texts = pa.array(["the cat " * 50, "sat", None, "on the mat " * 9, ""])
    whole, _ = model.code_lengths(texts)
    monkeypatch.setattr(language_id, "STEP", 16)
    assert np.allclose(model.code_lengths(texts)[0], whole)


def test_odd_rows(spark):
    rows = [(i, "the cat sat on the mat and that is that" if i % 2 else "der hund und die katze sind hier", "en" if i % 2 else "de")
            for i in range(60)]
    odd = [(100, None), (101, ""), (102, "12 + 34 = ?"), (103, "x"), (104, "the cat " * 200_000), (None, "und die katze", "de"),
           (105, "the mat", None), (105, "the mat", None)]
    out = identify(clashing(docs(spark, rows + odd))).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 68
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0.0
    assert got[104].lang_pred == "en" and got[105].lang_pred == "en" and got[None].lang_pred == "de"
    assert got[None].held_out is False
    assert identify(docs(spark, [])).count() == 0
    assert {r.lang_pred for r in identify(docs(spark, [(1, "abc", None)])).collect()} == {"und"}
