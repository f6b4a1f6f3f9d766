import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.llm.helpers import clashing, duck, same_rows
from veerline.llm import merkle
from veerline.llm.queries import ORACLE, QUERIES

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def flanks(tree, i):
    out = []
    for level in tree[:-1]:
        a = i // 3 * 3
        out.append(("".join(level[a:i]), "".join(level[i + 1:a + 3])))
        i //= 3
    return out


def brute(rows):
    """The contract on plain lists."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in by_source[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by_source[s]):
            path = flanks(trees[s], i) + flanks(top, k)
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf((*r[:4], r[4].replace("\n", "") if hit else r[4]))
            for a, b in path:
                node = digest(a + node + b)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], digest("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def check(spark, rows):
    got = sorted([tuple(r) for r in merkle.merkle_manifest(spark.createDataFrame(rows, SCHEMA)).select(COLUMNS).collect()], key=repr)
    assert got == brute(rows)
    return got


def row(i, source="s", text="a\nb"):
    return (i, source, "en", 3, text)


def test_fixture_against_sql(spark):
    got = QUERIES["op13_merkle_manifest"](spark, SF_SMALL).toPandas()
    assert same_rows(got, duck(ORACLE["op13_merkle_manifest"]), COLUMNS)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 30])
def test_every_size_of_a_tree_in_small_blocks(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "DEPTH", 1)          # a level a round: every size meets the borders of blocks
    check(spark, [row(i) for i in range(n)] + [row(100, "t"), row(101, "u"), row(102, "v"), row(103, None)])


def test_blocks_of_two_levels_and_many_sources(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DEPTH", 2)
    check(spark, [row(i, f"s{i * i % 31}" if i % 3 else "hot", f"text {i}\n") for i in range(400)])


def test_nulls_repeated_rows_and_names(spark):
    rows = [row(None), row(None), row(1, None, None), row(1, None, ""), row(1, "", "x"), row(1, "-", "x"), row(1, "é", "x\ny"),
            row(1, "zz", "x\ny"), (7, "s", None, None, "\n" * 5), (7, "s", None, None, "\n" * 5), (-3, "s", "", -1, "ß\n")]
    check(spark, rows)


def test_one_row_and_no_row(spark):
    (only,) = check(spark, [row(0, text="plain")])
    assert only[1] == only[2] == only[3] == only[5] and only[4] == digest("") and only[6]
    assert check(spark, []) == []


def test_tampering_shows_only_where_text_changed(spark):
    rows = [row(i, text="a\nb" if i < 20 else "ab") for i in range(40)]
    for r in check(spark, rows):
        assert r[6] == (r[0] >= 20 or zlib.crc32(str(r[0]).encode()) % 2 == 1)


def test_same_for_any_partitioning_with_long_text_and_clashing_columns(spark):
    rows = [row(i, "hot" if i % 3 else None, "line\n" * (200_000 if i == 5 else 2)) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    names = ["t", "digest", "tampered", "rank", "total", "members", "path", "levels", "subroot", "pos"]
    extra = clashing(df).select("*", *[F.lit(1).alias(c) for c in names])
    frames = [df.repartition(1), df.repartition(7), extra]
    results = [sorted(map(tuple, merkle.merkle_manifest(d).select(COLUMNS).collect()), key=repr) for d in frames]
    assert results[0] == results[1] == results[2] == brute(rows)
