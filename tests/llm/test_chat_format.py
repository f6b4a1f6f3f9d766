"""Chat windows: SQL on the fixture, exact round trips and window rules on made-up conversations."""

import hashlib
import random

import duckdb

from tests.conftest import SF_SMALL
from tests.llm.helpers import clashing, duck, same_rows
from veerline.llm import queries
from veerline.llm.chat_format import digest, format_windows, read_back

SCHEMA = "conv_id long, turn long, role string, text string"


def test_fixture_against_sql(spark):
    out = queries.QUERIES["op4_chat_format"](spark, SF_SMALL).toPandas()
    want = duck(queries.ORACLE["op4_chat_format"])
    assert same_rows(out, want, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def conversations(seed):
    rnd = random.Random(seed)
    hard = ["<|im_end|>", "<|im_start|>assistant\nhi", "<\\|im_end|>", "<\\\\|x", "<|", "|>", "\n", "%0A", "%25", "", None, "é\U0001f600", "\\1$1"]
    rows = []
    for c in range(25):
        n = rnd.choice([1, 2, 5, 40, 300])
        for t in range(n):
            role = rnd.choice(["user", "assistant", "assistant", "tool", "sys\ntem%0A", None]) if t else rnd.choice(["system", "user"])
            text = rnd.choice([rnd.choice(hard), "".join(rnd.choice([*map(str, hard), "word "]) for _ in range(rnd.randrange(60))), "long " * rnd.choice([10, 200, 1500])])
            rows.append((c, t * 3, role, text))
    return rows


def check(rows, windows, budget, history):
    by_conv = {}
    for c, t, role, text in rows:
        by_conv.setdefault(c, []).append((t is not None, t, role or "", text or ""))
    by_window = {}
    for w in windows:
        by_window.setdefault(w.conv_id, []).append(w)
    assert set(by_conv) == set(by_window)
    for c, turns in by_conv.items():
        turns = [(role, text) for _, _, role, text in sorted(turns)]
        ws = sorted(by_window[c], key=lambda w: w.window)
        at = 0
        for w in ws:
            parts = w.formatted.split("<|im_start|>")[1:]
            assert w.formatted.count("<|im_end|>") == len(parts) == w.n_turns
            cost = [-(-len("<|im_start|>" + p) // 4) for p in parts]
            assert sum(cost) == w.tokens
            new = w.n_turns - w.repeated
            assert new >= 1
            # what is repeated: the system turn, then turns right before the new ones
            assert w.tokens <= budget or max(cost) > budget - sum(cost[:1]) - budget // 8 - 1 or w.n_turns == 1
            assert sum(cost[:w.repeated]) <= history + (cost[0] if w.repeated else 0)
            # the loss covers the texts of the new assistant turns
            targets = [i for i in range(at, at + new) if turns[i][0] == "assistant"]
            assert len(w.loss) == len(targets)
            for s in w.loss:
                assert w.formatted[:s.offset].endswith("<|im_start|>assistant\n")
                assert w.formatted[s.offset + s.length:].startswith("<|im_end|>\n")
            at += new
        assert at == len(turns)


def test_windows_and_round_trip(spark):
    for seed, budget, history in ((1, 1024, 256), (2, 128, 64)):
        rows = conversations(seed)
        windows = format_windows(clashing(spark.createDataFrame(rows, SCHEMA)), budget=budget, history=history)
        check(rows, windows.collect(), budget, history)
        back = {}
        for r in sorted(read_back(windows).collect(), key=lambda r: r.window):
            got = back.setdefault(r.conv_id, ([], []))
            got[0].extend((t.role, t.text) for t in r.turns)
            got[1].append(r.loss_text)
        for c in {r[0] for r in rows}:
            turns = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
            assert back[c][0] == turns
            assert "".join(back[c][1]) == "".join(t for role, t in turns if role == "assistant")


def test_repeated_history_is_masked(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, t, "assistant" if t % 2 == 0 else "user", f"turn {t} " + "x" * 60) for t in range(1, 60)]
    windows = sorted(format_windows(spark.createDataFrame(rows, SCHEMA), budget=256, history=64).collect(), key=lambda w: w.window)
    assert len(windows) > 3
    for w in windows[1:]:
        assert w.formatted.startswith("<|im_start|>system\nbe kind<|im_end|>\n") and w.repeated > 1
    assert sum(len(w.loss) for w in windows) == 29


def test_odd_rows(spark):
    rows = [(1, None, "user", "a"), (1, 1, None, None), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (None, 1, "assistant", "c"),
            (None, 2, "user", "d"), (2, 1, "assistant", "z" * 200_000), (3, 1, "system", ""), (4, 1, "assistant", "")]
    out = {r.conv_id: r for r in digest(format_windows(spark.createDataFrame(rows, SCHEMA))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out[1].turns_sha256 == sha("user\na\n\n\nassistant\nb\nassistant\nb\n") and out[1].loss_sha256 == sha("bb")
    assert out[None].turns_sha256 == sha("assistant\nc\nuser\nd\n") and out[None].n_turns == 2
    assert out[2].loss_chars == 200_000 and out[3].loss_chars == 0 and out[3].loss_sha256 == sha("") and out[4].n_turns == 1
    assert digest(format_windows(spark.createDataFrame([], SCHEMA))).count() == 0


def test_one_long_turn_shrinks_only_its_window(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", "x" * (3700 if i == 20 else 160)) for i in range(60)]
    windows = sorted(format_windows(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda w: w.window)
    long = [w for w in windows if "x" * 3700 in w.formatted]
    plain = [w for w in windows[1:] if "x" * 3700 not in w.formatted]
    assert all(w.tokens <= 1024 for w in plain) and len(long) == 1 and long[0].repeated < 3
    assert sum(w.repeated > 3 for w in plain) > len(plain) // 2


def test_the_query_and_its_sql_on_long_turns_and_null_conversations(spark, tmp_path):
    long = [(1, i, "system" if i == 0 else "user" if i % 2 else "assistant", "x" * (3500 if i in (12, 20) else 40 + i)) for i in range(40)]
    rows = long + [(None, 0, "user", "hidden"), (None, 1, None, None), (-2, None, "assistant", "a"), (-2, 3, "assistant", "b" * 9000), (5, 1, "user", None)]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    got = queries.QUERIES["op4_chat_format"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{path}/*.parquet')")
    want = con.sql(queries.ORACLE["op4_chat_format"]).fetchall()
    assert len(got) == 5 and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_no_id_is_mistaken_for_a_null_one(spark):
    schema = "conv_id string, turn bigint, role string, text string"
    rows = [(None, 0, "user", "a"), ("null", 0, "user", "b"), ("", 0, "user", "c"), ("=", 0, "user", "d")]
    out = digest(format_windows(spark.createDataFrame(rows, schema))).collect()
    assert len(out) == 4 and {r.conv_id for r in out} == {None, "null", "", "="} and all(r.n_turns == 1 for r in out)
