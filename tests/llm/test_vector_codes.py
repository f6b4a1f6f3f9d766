import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.llm.helpers import duck, same_rows
from veerline.llm import vector_codes as V
from veerline.llm.queries import ORACLE, QUERIES

SCHEMA = "vec_id bigint, embedding array<double>, label int"
COLUMNS = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def brute(rows, n_parts=8, n_entries=16, rounds=6):
    """The contract on Python's integers: all distances, in the plain space."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not rows:
        return []
    size = max(1, math.ceil(max(len(r[1]) for r in rows) / n_parts))
    whole = [[math.floor(Fraction(x) * 4096) for x in r[1]] + [0] * (n_parts * size - len(r[1])) for r in rows]
    cut = [[w[p * size:(p + 1) * size] for p in range(n_parts)] for w in whole]
    books = [[c[p] for c in cut[:n_entries]] for p in range(n_parts)]

    def nearest(part, book):
        at = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in book]
        return at.index(min(at)), min(at)

    for _ in range(rounds):
        for p in range(n_parts):
            members = {}
            for c in cut:
                members.setdefault(nearest(c[p], books[p])[0], []).append(c[p])
            books[p] = [[sum(x) // len(members[e]) for x in zip(*members[e], strict=True)] if e in members else old
                        for e, old in enumerate(books[p])]
    found = [[nearest(c[p], books[p]) for p in range(n_parts)] for c in cut]
    errors = [sum(d for _, d in f) for f in found]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()

    def fits(x):
        return None if x is None or x >= 2 ** 63 else x

    def by_label(label):
        mine = [fits(e) for r, e in zip(rows, errors, strict=True) if r[2] == label]
        return None if None in mine else fits(sum(mine))
    return [(r[0], "".join(f"{e:02x}" for e, _ in f), fits(error), by_label(r[2]), digest)
            for r, f, error in zip(rows, found, errors, strict=True)]


def check(spark, rows, schema=SCHEMA, **kw):
    df = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in V.compress_vectors(df, **kw).select(COLUMNS).collect()]
    sizes = {"n_parts": kw.get("parts", 8), "n_entries": kw.get("entries", 16), "rounds": kw.get("rounds", 6)}
    expected = brute([tuple(r) for r in df.collect()], **sizes)
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    return got


def test_fixture_against_sql(spark):
    got = QUERIES["op11_vector_codes"](spark, SF_SMALL).toPandas()
    assert same_rows(got, duck(ORACLE["op11_vector_codes"]), COLUMNS)


@pytest.mark.parametrize("size", [1, 2, 4, 8, 16])
def test_sequency_matrix(size):
    h = V.sequency_matrix(size)
    assert (h @ h.T == size * np.eye(size, dtype=int)).all()
    assert [(row[1:] != row[:-1]).sum() for row in h] == list(range(size))


@pytest.mark.parametrize("length,kind", [(1, np.int64), (3, np.int64), (8, np.int64), (5, object)])
def test_nearest_entry_against_all_distances(length, kind):
    rng = np.random.default_rng(length)
    scale = 10 ** 30 if kind is object else 1
    parts, entries = (rng.integers(-4, 5, (n, length)).astype(kind) * scale for n in (300, 16))  # many ties
    entry, error = V.nearest(parts, entries)
    all_of_them = ((parts[:, None, :].astype(object) - entries[None].astype(object)) ** 2).sum(2)
    assert entry.tolist() == [row.index(min(row)) for row in all_of_them.tolist()]
    assert error.tolist() == all_of_them.min(1).tolist()


def test_rows_that_are_dropped_and_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0] * 64, None), (5, [1.0] * 64, None), (5, [0.5] * 64, 7), (None, [2.0] * 64, 1), (1, None, 1),
            (2, [None] + [1.0] * 63, 2), (3, [nan] * 64, 1), (4, [-inf] * 64, 2), (7, [], 1), (9, [0.5] * 13, None),
            (10, [-0.00001] * 64, 3)]
    got = check(spark, rows)
    assert sorted(r[0] or 0 for r in got) == [0, 5, 5, 5, 7, 9, 10]


def test_empty_table_and_none_kept(spark):
    assert check(spark, []) == [] and check(spark, [(1, None, 1), (2, [float("nan")], None)]) == []
    assert check(spark, [(1, [], 1)])[0][1:4] == ("00" * 8, 0, 0)


def test_large_components_stay_exact(spark):
    for big in (1e6, 1e30, 1e300):
        rows = [(i, [float((i * 7919 + j * 104729) % 1000) * (big if i % 3 == 0 else 1e-3) for j in range(16)], i % 2) for i in range(40)]
        check(spark, rows)


def test_other_sizes_hot_label_and_partitions(spark):
    rows = [(i, [((i * 37 + j * 11) % 23) / 7 - 1 for j in range(12)], None if i % 3 else i) for i in range(90)]
    check(spark, rows, parts=4, entries=3, rounds=2)
    df = spark.createDataFrame(rows, SCHEMA)
    one, many = (sorted(map(tuple, V.compress_vectors(df.repartition(n)).collect()), key=repr) for n in (1, 7))
    assert one == many


def test_clashing_columns_and_string_ids(spark):
    rows = [(f"v{i}", [float(i % 5), 1.0 * i] * 8, i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>, label int")
    extra = df.select("*", *[F.lit(1).alias(c) for c in ("v", "code", "error", "part", "entry", "value", "_label", "_sum", "label_error")])
    plain, clash = (sorted(map(tuple, V.compress_vectors(d).collect())) for d in (df, extra))
    assert plain == clash and len(plain) == 20


def test_sums_beyond_one_limb():
    for value in (0, -1, 5, 2 ** 40, -(2 ** 40) - 1, 3 ** 100, -(3 ** 100)):
        assert sum(limb << (V.LIMB * at) for at, limb in V._limbs(value)) == value
