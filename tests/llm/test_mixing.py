"""Curriculum mixing against SQL, and against integrating the schedule by small steps."""

from tests.llm.helpers import clashing, docs, duck, same_rows
from tests.conftest import SF_SMALL
from veerline.llm import queries
from veerline.llm.mixing import curriculum_positions, training_order


def test_fixture_against_sql(spark):
    out = queries.QUERIES["op10_curriculum_mix"](spark, SF_SMALL).toPandas()
    want = duck(queries.ORACLE["op10_curriculum_mix"])
    assert same_rows(out, want, ["doc_id", "size", "source_size", "target", "taken"])
    assert (out.taken <= 2 * out["size"]).all()
    per = want.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"), n=("taken", "size"))
    assert (abs(per.taken - per.target) <= 2 * per.most * (1 + per.n // 10_000)).all()


def filled(sizes, weights=(3, 1, 2), share=1.5):
    """Targets by sharing the excess again and again."""
    w = [weights[i % 3] for i in range(len(sizes))]
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free:
        total = sum(w[i] for i in free)
        over = {i for i in free if left * w[i] / total > 2 * sizes[i]}
        if not over:
            for i in free:
                target[i] = left * w[i] / total
            break
        for i in over:
            target[i] = 2.0 * sizes[i]
            left -= target[i]
        free -= over
    return target


def rows_of(sizes):
    out, i = [], 0
    for s, (name, n) in enumerate(sizes):
        for k in range(n):
            out.append((i, " ".join(["w"] * (1 + (i * 7 + k) % 9)), None, name))
            i += 1
    return out


def test_targets_positions_and_order(spark):
    rows = rows_of([("a", 300), ("B", 20), ("é", 200), (None, 40), ("\U0001f600", 3), ("zz", 150)])
    names = ["B", "a", "zz", "é", "\U0001f600", None]
    mix = curriculum_positions(docs(spark, rows)).collect()
    size = {n: sum(r["size"] for r in mix if r.doc.source == n) for n in names}
    want = dict(zip(names, filled([size[n] for n in names]), strict=True))
    for r in mix:
        assert r.source_size == size[r.doc.source] and abs(r.target - want[r.doc.source]) < 1e-6
        assert all(0 <= p < 1 for p in r.positions) and len(r.positions) <= 2
    for n in names:
        taken = sum(r["size"] * len(r.positions) for r in mix if r.doc.source == n)
        assert abs(taken - want[n]) <= 9
    # the words of a source placed before time t are its integrated schedule up to t
    tilts = dict(zip(names, (1.5, 1.0, 0.5) * 2, strict=True))
    for n in names:
        for t in (0.25, 0.5, 0.75):
            placed = sum(r["size"] for r in mix if r.doc.source == n for p in r.positions if p < t)
            steps = 2000
            demand = sum(want[n] * (tilts[n] + 2 * (1 - tilts[n]) * (k + 0.5) / steps * t) * t / steps for k in range(steps))
            assert abs(placed - demand) <= 10
    order = training_order(curriculum_positions(docs(spark, rows))).collect()
    assert [r.position for r in order] == sorted(p for r in mix for p in r.positions)


def test_odd_rows(spark):
    rows = [(1, None, None, "a"), (2, "", None, "a"), (3, "one two", None, None), (3, "one two", None, None), (None, "x", None, "a"),
            (5, "word " * 200_000, None, "b")]
    out = curriculum_positions(clashing(docs(spark, rows))).collect()
    assert len(out) == len(rows) and sorted(r["size"] for r in out) == [0, 0, 1, 2, 2, 200_000]
    assert all(len(r.positions) <= 2 for r in out)
    again = curriculum_positions(docs(spark, rows).repartition(7)).collect()
    key = lambda rs: sorted(repr((r.doc.doc_id, r["size"], r.target, r.positions)) for r in rs)
    assert key(out) == key(again)
    assert curriculum_positions(docs(spark, [])).count() == 0
    assert [r.positions for r in curriculum_positions(docs(spark, [(1, "", None, "a")])).collect()] == [[]]
