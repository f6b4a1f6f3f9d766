"""SimHash components against all pairs in plain Python."""

import random

import numpy as np
import xxhash

from tests.llm.helpers import Union, clashing, docs, documents
from tests.conftest import SF_SMALL
from veerline.llm import queries
from veerline.llm.simhash import components, near_duplicates, near_links, spanning_links


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(pairs, bits=4):
    """pairs: (doc_id, fingerprint)."""
    u = Union()
    for i, a in pairs:
        u.find(i)
        for j, b in pairs:
            if j < i and (a ^ b).bit_count() <= bits:
                u.join(i, j)
    return {i: u.find(i) for i, _ in pairs}


def test_fixture_against_brute_force(spark):
    out = queries.QUERIES["op6_simhash_near_dedup"](spark, SF_SMALL).collect()
    table = documents()
    prints = {i: plain_fingerprint(t) for i, t in zip(table.doc_id, table.text, strict=True)}
    assert {r.doc_id: r.fingerprint for r in out} == {i: f"{f:016x}" for i, f in prints.items()}
    assert {r.doc_id: r.component_id for r in out} == plain_components(sorted(prints.items()))


def test_links_of_planted_fingerprints(spark):
    """Chains, dense clusters and split cells: components over fingerprints alone."""
    rnd = random.Random(5)
    values = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(40):
        x = rnd.getrandbits(64)
        values.add(x)
        for _ in range(rnd.choice([0, 1, 5, 30])):
            x ^= sum(1 << b for b in rnd.sample(range(64), rnd.choice([1, 2, 3, 4, 5])))
            values.add(x)
    x = rnd.getrandbits(64)
    values |= {x ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(300)}
    values = sorted(values)
    fps = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    expected = plain_components(list(enumerate(values)))
    for segments, cell_rows in (((1,) * 24 + (2,) * 4, 20_000), ((2,) * 16, 16), ((4,) * 8, 20_000), ((2,) * 6 + (3, 5, 4, 4, 4), 20_000)):
        got = components(near_links(fps, 4, segments, cell_rows)).collect()
        index = {int(np.uint64(v).view(np.int64)): i for i, v in enumerate(values)}
        roots = {index[r.node]: r.root for r in got}
        mine = {}
        for i in range(len(values)):
            mine.setdefault(roots.get(i, ("own", i)), []).append(i)
        wanted = {}
        for i, c in expected.items():
            wanted.setdefault(c, []).append(i)
        assert sorted(mine.values()) == sorted(wanted.values())


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (5, "one TWO"), (None, "one two"),
            (None, "a lonely text of seven words here"), (7, "word " * 60_000), (8, "WORD " * 60_000), (9, "é É"), (10, "é é")]
    out = near_duplicates(clashing(docs(spark, rows))).collect()
    got = sorted(((r.doc_id, r.component_id) for r in out), key=repr)
    assert [c for i, c in got if i in (1, 2, 3)] == [1, 1, 1]
    assert [c for i, c in got if i in (4, 5)] == [4, 4, 4]
    assert sorted(c or -1 for i, c in got if i is None) == [-1, 4]
    assert dict(got)[7] == 7 and dict(got)[8] == 7 and dict(got)[9] != dict(got)[10]
    assert len(out) == len(rows)
    assert near_duplicates(docs(spark, [])).count() == 0


def test_spanning_forest_is_a_forest():
    a = np.array([0, 1, 3, 7, 15, 31, 0xFFFF << 40], dtype=np.uint64)
    left, right = spanning_links(a, 4)
    assert len(left) == 5 and all(int(x ^ y).bit_count() <= 4 for x, y in zip(left, right, strict=True))


def test_chain_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 2000), (1500, 2000)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1500: 1000, 2000: 1000}
    assert components(links.limit(0)).count() == 0
