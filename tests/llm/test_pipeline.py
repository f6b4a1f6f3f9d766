"""The pipeline against brute force, stage by stage, and on odd rows."""

import re


import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm.helpers import clashing, docs, documents
from tests.llm.test_packing import ids_of
from tests.llm.test_simhash import plain_components, plain_fingerprint
from veerline.llm.mixing import curriculum_positions

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NAMES = ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]


def test_stages_against_brute_force(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    table = documents()
    frame, rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), table
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, SF_SMALL).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        out = frame.toPandas()
        if name == "language_id":
            want = rows[[any(c.isalpha() for c in t or "") for t in rows.text]]
        elif name == "exact_dedup":
            want = rows.sort_values("doc_id").drop_duplicates("text", keep="last")
        elif name == "simhash_near_dedup":
            parts = plain_components(sorted((i, plain_fingerprint(t)) for i, t in zip(rows.doc_id, rows.text, strict=True)))
            want = rows[[parts[i] == i for i in rows.doc_id]]
        elif name == "mixing":
            assert frame.columns == COLUMNS
            plan = curriculum_positions(spark.createDataFrame(rows[COLUMNS])).collect()
            assert len(out) == sum(len(r.positions) for r in plan) and (out.groupby("doc_id").size() <= 2).all()
            assert out.groupby("doc_id").size().to_dict() == {r.doc.doc_id: len(r.positions) for r in plan if r.positions}
            words = out.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))
            assert abs(words.sum() / rows.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))).sum() - 1.5) < 0.1
        if name in NAMES[:3]:
            assert frame.columns == COLUMNS
            assert sorted(map(tuple, out.values.tolist())) == sorted(map(tuple, want[COLUMNS].values.tolist()))
            rows = want
        elif name == "mixing":
            mixed = out
        else:
            ids = dict(zip(mixed.doc_id, ids_of(mixed.text), strict=True))
            twice = mixed.groupby("doc_id").size()
            assert out.groupby("doc_id").length.sum().to_dict() == {i: twice[i] * len(v) for i, v in ids.items()}
            for r in out.itertuples():
                assert list(r.ids) == ids[r.doc_id][r.start:r.start + r.length]
            once = out[out.doc_id.map(twice) == 1]
            check_docs = {i: ids[i] for i in set(once.doc_id)}
            by_doc = {i: g for i, g in once.groupby("doc_id")}
            assert all(sum(by_doc[i].length) == len(v) for i, v in check_docs.items())


def test_run_packs_what_the_mix_takes(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces = out.toPandas()
    ends = pieces.groupby("sequence_id").length.sum()
    assert all(n == 2048 or n & (n - 1) == 0 for n in ends)
    assert set(pieces.doc_id) <= set(documents().doc_id)


ODD = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "123 !!", None, None), (4, "some plain words in here", "en", "a"),
       (4, "some plain words in here", "en", "a"), (4, "other words with the same id", "en", None), (None, "some plain words in here", "en", "a"),
       (None, "words without an id at all", None, "b"), (None, "words without an id at all", None, "b"), (5, "long words " * 60_000, "en", "c"),
       (6, "Some Plain words in here", "en", "a"), (7, "und noch ein deutscher Satz hier", "de", "a")]


def test_odd_rows_and_columns(spark):
    frame = clashing(docs(spark, ODD))
    columns = frame.columns
    letters = [r for r in ODD if r[1] and any(c.isalpha() for c in r[1])]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, frame, SF_SMALL)
        if name != "packing":
            assert result.columns == columns
        out[name] = [tuple(r)[:2] for r in result.collect()]
    assert sorted(map(repr, out["language_id"])) == sorted(repr(r[:2]) for r in letters)
    one = sorted(map(repr, out["exact_dedup"]))
    texts = [t for _, t in out["exact_dedup"]]
    assert len(set(texts)) == len(texts) == len({r[1] or "" for r in ODD}) + (None in texts and "" in texts)
    assert repr((4, "some plain words in here")) in one and repr((None, "words without an id at all")) in one
    near = out["simhash_near_dedup"]
    assert len(near) == len({plain_fingerprint(r[1]) for r in ODD})
    assert (4, "some plain words in here") in near and (None, "words without an id at all") in near
    assert all(out["mixing"].count(r[:2]) <= 2 * sum(x[:2] == r[:2] for x in ODD) for r in ODD)


def test_empty_table(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs(spark, []), SF_SMALL).count() == 0, name


def test_no_language_to_learn_from(spark):
    kept = corpus_pipeline.identify_language(spark, docs(spark, [(1, "words", None), (2, "12", None), (3, None, None)]), SF_SMALL)
    assert [r.doc_id for r in kept.collect()] == [1]


