"""Fingerprints against plain Python sketches and exact shingle likeness."""

import hashlib
import re
import struct

import xxhash

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.llm.helpers import clashing, docs, documents
from veerline.llm import queries
from veerline.llm.fingerprints import SCALE, containment, fingerprint_documents, jaccard, merged, plain, sketch, with_next


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def plain_sketch(text, scale=SCALE):
    words = [signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in re.findall(r"[^\x20\x09-\x0D]+", text.lower())]

    def chain(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64(struct.pack("<q", v), seed=seed).intdigest()
        return signed(seed)

    if not words:
        return []
    if len(words) <= 5:
        a = 0
        for w in words:
            a = chain([a, w])
        hashes = {a}
    else:
        hashes = {chain(words[i:i + 5]) for i in range(len(words) - 4)}
    return sorted(h for h in hashes if h < -(2 ** 63) + 2 ** 64 // scale) or [min(hashes)]


def plain_rows(table):
    """(doc_id, text) rows with unique ids -> expected rows."""
    rows = sorted(table, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        third = len(t) // 3
        edited = t[:len(t) - third] + nxt[:third]
        a, b, c = plain_sketch(t), plain_sketch(edited), plain_sketch(nxt)

        def near(x, y):
            x, y = set(x), set(y)
            return len(x & y) / len(x | y) if x | y else 1.0

        show = lambda s: " ".join(f"{h % (1 << 64):016x}" for h in s)
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), show(a), show(b), round(near(a, b), 9), round(near(a, c), 9))
    return out


def got_rows(df):
    return {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))
            for r in df.collect()}


def test_fixture_against_brute_force(spark):
    table = documents()
    out = queries.QUERIES["op3_fingerprints"](spark, SF_SMALL)
    assert got_rows(out) == plain_rows(list(zip(table.doc_id, table.text, strict=True)))


def test_likeness_estimates_exact_likeness(spark):
    table = documents()
    out = {r.doc_id: r for r in fingerprint_documents(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).collect()}
    errors = []
    rows = sorted(zip(table.doc_id, table.text, strict=True), reverse=True)
    for (i, t), (_, nxt) in zip(rows, rows[1:], strict=False):
        third = len(t) // 3
        a, b = ({" ".join(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split(), (t[:len(t) - third] + nxt[:third]).lower().split()))
        if len(a) >= 200:
            errors.append(abs(out[i].near_edited - len(a & b) / len(a | b)))
    assert sum(errors) / len(errors) < 0.06


def test_ranges_pair_each_row_with_the_next(spark):
    rows = [(i * 7 % 1000, f"t{i * 7 % 1000}") for i in range(1000)]
    for per in (10, 100, 5000):
        got = with_next(plain(docs(spark, rows), "doc_id", "text"), {}, rows_per_range=per).collect()
        assert {(r.doc_id, r.next_text) for r in got} == {(i, f"t{(i - 1) % 1000}") for i in range(1000)}
    gaps = [(10 ** 17 + 1, "a"), (10 ** 17, "b"), (-5, "c"), (3, "d")]
    got = with_next(plain(docs(spark, gaps), "doc_id", "text"), {}, rows_per_range=1).collect()
    assert {(r.text, r.next_text) for r in got} == {("a", "b"), ("b", "d"), ("d", "c"), ("c", "a")}


def test_merging_and_containment(spark):
    a, b = "one two three four five six seven eight nine ten " * 3, "eleven twelve thirteen fourteen fifteen sixteen seventeen"
    row = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, both string").select(
        *[sketch(F.col(c), scale=1).alias(c) for c in ("a", "b", "both")])
    r = row.select(containment(F.col("a"), F.col("both")).alias("c"), jaccard(F.col("a"), F.col("a")).alias("same"),
                   F.size(F.array_except(merged(F.col("a"), F.col("b"), 1), F.col("both"))).alias("rest")).first()
    assert (r.c, r.same, r.rest) == (1.0, 1.0, 0)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x" * 10), (4, "\U0001f600é ab" * 40), (5, "word " * 50_000), (6, "one two three"), (7, "a b c d e f")]
    assert got_rows(fingerprint_documents(clashing(docs(spark, rows)))) == plain_rows([(i, t or "") for i, t in rows])
    ties = [(1, "a"), (1, "b"), (1, "b"), (None, "c"), (None, "d")]
    assert fingerprint_documents(docs(spark, ties)).count() == 5
    assert [r.edited_sha256 for r in fingerprint_documents(docs(spark, [(None, "abc")])).collect()] == [hashlib.sha256(b"aba").hexdigest()]
    assert fingerprint_documents(docs(spark, [])).count() == 0


def test_string_ids_in_many_ranges(spark):
    rows = [(f"id{i * 7 % 1000:04d}", f"t{i * 7 % 1000}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    for per in (10, 100, 5000):
        got = with_next(plain(df, "doc_id", "text"), {}, rows_per_range=per).collect()
        assert {(r.doc_id, r.next_text) for r in got} == {(f"id{i:04d}", f"t{(i - 1) % 1000}") for i in range(1000)}
    assert fingerprint_documents(df).count() == 1000
