"""Line dedup against all pairs in plain Python, on the fixture and on made-up lines."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from tests.conftest import SF_SMALL
from tests.llm.helpers import clashing, docs, documents
from veerline.llm import queries
from veerline.llm import line_dedup as module
from veerline.llm.line_dedup import VariantHashes, line_dedup


def within_one(a, b):
    """Edit distance of at most one."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def plain_dedup(rows, min_chars=16):
    """rows: (doc_id, text) with unique ids, in id order -> doc_id: kept text."""
    seen, out = {}, {}
    by_length = {}
    for i, text in rows:
        kept = []
        for line in (text or "").split("\n"):
            if line.strip(" \t\v\f\r") == "":
                kept.append(line)
                continue
            near = line in seen
            if not near and len(line) >= min_chars:
                near = any(within_one(line, other) for n in (-1, 0, 1) for other in by_length.get(len(line) + n, ()))
            if line not in seen:
                seen[line] = True
                if len(line) >= min_chars:
                    by_length.setdefault(len(line), []).append(line)
            if not near:
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


def test_fixture_against_brute_force(spark):
    table = documents()
    want = plain_dedup(sorted(zip(table.doc_id, table.text, strict=True)))
    out = queries.QUERIES["op5_line_dedup"](spark, SF_SMALL).collect()
    texts = dict(zip(table.doc_id, table.text, strict=True))
    assert {r.doc_id: (r.n_lines, r.kept_chars, r.kept_sha256) for r in out} == {
        i: (texts[i].count("\n") + 1, len(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in want.items()}


def made_up(seed):
    rnd = random.Random(seed)
    lines = ["the first of all lines here", "number 000 of many lines", "aaaaaaaaaaaaaaaaaaaaaaaa", "short", "", "  ", "é\U0001f600 and a line of signs"]
    for _ in range(400):
        line = rnd.choice(lines[-60:])
        for _ in range(rnd.choice([0, 1, 1, 2])):
            k = rnd.randrange(len(line) + 1)
            line = rnd.choice([line[:k] + rnd.choice("ab0é") + line[k:], line[:k] + line[k + 1:], line[:k] + rnd.choice("ab1") + line[k + 1:]])
        lines.append(line)
    lines += [f"number {k} of many lines" for k in range(120)]
    rnd.shuffle(lines)
    return [(i, "\n".join(lines[i * 10:i * 10 + 10])) for i in range(len(lines) // 10)]


def test_edits_chains_and_hot_variants(spark):
    for seed in (1, 2, 3):
        rows = made_up(seed)
        for broadcast_rows in (500_000, 3):
            out = line_dedup(clashing(docs(spark, rows)), broadcast_rows=broadcast_rows).collect()
            assert {r.doc_id: r.text for r in out} == plain_dedup(rows)


def test_variant_hashes():
    h = VariantHashes()
    for line in ("abca", "aab", "x", "é\U0001f600é"):
        _, variants, starts = h.of(line)
        for i in range(len(line)):
            whole, _, _ = h.of(line[:i] + line[i + 1:])
            assert (variants[:, i] == whole).all()
        assert starts.tolist() == [i == 0 or line[i] != line[i - 1] for i in range(len(line))]
    assert not np.array_equal(h.of("ab")[0], h.of("ba")[0])


def test_odd_rows(spark):
    long = "y" * 100_000
    rows = [(1, None), (2, ""), (3, "a line of some length\n\n\na line of some length"), (4, "a line of some lengths\nshort"),
            (5, "short\nshor"), (6, long), (7, long + "y"), (8, "one\n" * 5000), (9, " \t\n ")]
    out = {r.doc_id: r for r in line_dedup(docs(spark, rows)).collect()}
    assert {i: r.text for i, r in out.items()} == plain_dedup(rows)
    assert (out[1].n_lines, out[1].kept_lines) == (1, 1) and out[4].text == "short" and out[7].kept_lines == 0
    ties = [(1, "same line in two rows"), (1, "same line in two rows"), (1, "another line of it"), (None, "same line in two rows"), (None, "alone")]
    got = sorted((r.doc_id is None, r.text) for r in line_dedup(docs(spark, ties)).collect())
    assert got == [(False, "another line of it"), (False, "same line in two rows"), (False, "same line in two rows"), (True, ""), (True, "alone")]
    exact = line_dedup(docs(spark, [(1, "a line of some length"), (2, "a line of some lengths")]), max_edits=0).collect()
    assert all(r.kept_lines == 1 for r in exact)
    assert line_dedup(docs(spark, [])).count() == 0


def within(a, b, k):
    """Edit distance of at most ``k``, by the whole table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1] <= k


def test_wider_bounds_and_short_lines(spark):
    for seed, k, min_chars, broadcast_rows in ((4, 2, 0, 500_000), (5, 3, 16, 3), (6, 4, 0, 3), (7, 3, 0, 500_000), (8, 1, 0, 3)):
        rnd, lines = random.Random(seed), []
        for _ in range(60):
            line = "".join(rnd.choice("abc dé\U0001f600") for _ in range(rnd.choice((1, 2, 3, 5, 9, 14, 20, 33, 70)))).strip() or "x"
            lines.append(line)
            for _ in range(rnd.choice((0, 1, 2))):
                for _ in range(rnd.randrange(1, k + 3)):
                    at = rnd.randrange(len(line) + 1)
                    line = rnd.choice([line[:at] + rnd.choice("ab ") + line[at:], line[:at] + line[at + 1:], line[:at] + "z" + line[at + 1:]])
                lines.append(line)
        rnd.shuffle(lines)
        seen, want = [], {}
        for i, line in enumerate(lines):
            late = any(line == x or (min(len(line), len(x)) >= min_chars and within(line, x, k)) for x in seen)
            want[i] = line if not late or not line.strip() else ""
            seen += [line] if line.strip() else []
        out = line_dedup(docs(spark, list(enumerate(lines))), max_edits=k, min_chars=min_chars, broadcast_rows=broadcast_rows).collect()
        assert {r.doc_id: r.text for r in out} == want, (seed, k)


def test_query_finds_three_edits(spark, tmp_path):
    rows = [(1, "the first line of this text, quite long"), (2, "a first line of his text, quite long"), (3, "the first of this text, quite long")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.QUERIES["op5_line_dedup"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.kept_chars for r in out} == {1: 39, 2: 36, 3: 34}
    near = [(1, rows[0][1]), (2, "the frst line of his text, quite lung")]
    docs(spark, near).write.parquet(str(tmp_path / "near" / "documents.parquet"))
    out = queries.QUERIES["op5_line_dedup"](spark, str(tmp_path / "near")).collect()
    assert {r.doc_id: r.kept_chars for r in out} == {1: 39, 2: 0}


def edited(rnd, line, edits):
    for _ in range(edits):
        at = rnd.randrange(len(line) + 1)
        line = rnd.choice([line[:at] + rnd.choice("ab ") + line[at:], line[:at] + line[at + 1:], line[:at] + "z" + line[at + 1:]])
    return line


def test_partners_share_a_key_and_keys_are_few():
    rnd = random.Random(9)
    for k in (2, 3, 4, 7):
        lines = ["".join(rnd.choice("abcdefgh é\U0001f600") for _ in range(rnd.randrange(1, 260))) for _ in range(300)]
        lines += [edited(rnd, line, rnd.randrange(k + 1)) or "x" for line in lines]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(lines))), pa.array(lines)], ["l1", "line"])
        keys = [set(x) for b in module._coded(k, 0)(iter([batch])) for x in b.column(b.num_columns - 1).to_pylist()]
        assert len(keys) == len(lines) and all(keys[i] & keys[i + 300] for i in range(300)), k
        assert k != 3 or sum(len(x) for x, line in zip(keys, lines, strict=True) if len(line) > 127) < 9 * sum(len(line) > 127 for line in lines)


def test_only_lines_of_like_signatures_are_compared(spark, monkeypatch):
    rnd, seen = random.Random(10), []
    word = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(30)) for _ in range(42)]
    rows = [(i, word[0] + word[i + 1] + word[i + 2] + word[i + 3]) for i in range(38)]      # unlike lines with a common first piece
    rows += [(38, rows[5][1][:50] + "z" + rows[5][1][51:])]
    near = module.near_lines_within

    def counted(lines, max_edits):
        seen.append(lines.count())
        return near(lines, max_edits)

    monkeypatch.setattr(module, "near_lines_within", counted)
    for crowd in (64, 2):
        monkeypatch.setattr(module, "CROWD", crowd, raising=False)
        out = line_dedup(docs(spark, rows), max_edits=3).collect()
        assert {r.doc_id for r in out if not r.kept_lines or not r.text} == {38}
    assert seen == [2, 39]
