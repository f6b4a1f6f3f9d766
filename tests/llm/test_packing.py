"""Packing: pieces rebuild every document, windows are gapless, padding is small."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.helpers import clashing, docs, documents
from tests.conftest import SF_SMALL
from veerline.llm import queries
from veerline.llm.packing import LevelPacker, pack_documents


def ids_of(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(pieces, table, window=2048):
    """Every id once, crc right, sequences gapless; lengths are full or powers of two."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(table)
    for i, ids in table.items():
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window or at < window and at & (at - 1) == 0


def test_fixture_against_the_tokenizer(spark):
    table = documents()
    out = queries.QUERIES["op7_packing"](spark, SF_SMALL).collect()
    check(out, dict(zip(table.doc_id, ids_of(table.text), strict=True)))


def test_level_rule_is_the_smallest_sum_of_squares():
    """The chosen level minimises the sum of squares, by trying every level."""
    rng = np.random.default_rng(3)
    w = 32
    packer = LevelPacker(w, lambda *a: None)
    for k in range(400):
        size = int(rng.integers(1, w))
        before = packer.count.copy()

        def cost(h):
            n = before.copy()
            if h:
                n[h] -= 1
            if h + size < w:
                n[h + size] += 1
            return (n[1:w] ** 2).sum()

        allowed = [h for h in range(w - size + 1) if h == 0 or before[h]]
        chosen = packer.level_for(size)
        assert chosen in allowed and cost(chosen) == min(map(cost, allowed))
        packer.place((k, 0, np.zeros(size, dtype="<i4"), size))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "<|endoftext|> a"), (7, "<|im_end|> a <|endoftext|>b<|endoftext|><|endoftext|"), (8, "x<|endoftext|>" * 3000), (4, "long text " * 30_000), (5, "é\U0001f600 x" * 50), (6, "\n\n  ")]
    out = pack_documents(clashing(docs(spark, rows).coalesce(1))).collect()
    check(out, dict(zip([r[0] for r in rows], ids_of([r[1] for r in rows]), strict=True)))
    assert all(len(r.ids) == r.length for r in out)
    again = pack_documents(docs(spark, [(1, "a b"), (1, "a b"), (None, "c")]).coalesce(1)).collect()
    assert sum(p.length for p in again) == 3 + 3 + 2
    assert pack_documents(docs(spark, [])).count() == 0
