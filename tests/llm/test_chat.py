from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from nightjar.llm import chat

PARTS = st.lists(st.sampled_from(["#", "##", "###", "\\", "</turn>", "<", "/turn>", " ", "a", "\n", ":", ": ", "### user: "]),
                 max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(PARTS, PARTS)
def test_template_is_reversible(role, text):
    formatted = chat.head(role) + chat.escape(text) + chat.END
    assert chat.parse(formatted) == [(role, text)]
    assert "###" not in chat.escape(text) and "</turn>" not in chat.escape(text)


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, row string")


def test_windows_keep_system_and_history(spark):
    rows = [(1, 0, "system", "be brief", "")]
    rows += [(1, 1 + i, ("user", "assistant")[i % 2], f"turn {i} " + "word " * 20, "") for i in range(12)]
    got = chat.format_windows(turns(spark, rows), budget=150, history=60).orderBy("window").collect()
    assert len(got) > 2
    new = []
    for w in got:
        parsed = chat.parse(w.formatted)
        assert parsed[0] == ("system", "be brief") and w.n_tokens <= 150
        assert w.fresh[0] == (w.window == 0)
        repeated = [p for p, f in zip(parsed[1:], w.fresh[1:]) if not f]
        assert repeated == new[len(new) - len(repeated):]
        if w.window:
            assert repeated
        new += [p for p, f in zip(parsed, w.fresh) if f]
        for (role, _), f, loss in zip(parsed, w.fresh, w.loss):
            assert loss == (f and role == "assistant")
        for (_, text), a, b in zip(parsed, w.starts, w.ends):
            assert chat.unescape(w.formatted[a:b]) == text
    assert new == [(r[2], r[3]) for r in rows]


def test_a_long_turn_is_a_window_of_its_own(spark):
    rows = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "word " * 500, ""), (1, 2, "user", "bye", "")]
    got = chat.format_windows(turns(spark, rows), budget=100, history=50).orderBy("window").collect()
    assert [sum(w.fresh) for w in got] == [1, 1, 1] and [len(w.fresh) for w in got][1] == 1


def test_digests(spark):
    hard = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", hard, ""), (-7, 1, "assistant", hard, ""), (2, 0, None, None, ""), (2, 1, "assistant", None, ""),
            (2, 1, "assistant", None, ""), (None, 3, "assistant", "x" * 9000, ""), (None, None, "user", "first", "")]
    got = {r.conv_id: r for r in chat.digests(chat.format_windows(turns(spark, rows))).collect()}
    want = {-7: [("user", hard), ("assistant", hard)], 2: [("", ""), ("assistant", ""), ("assistant", "")],
            None: [("user", "first"), ("assistant", "x" * 9000)]}
    for conv, said in want.items():
        r, spoken = got[conv], "".join(t for role, t in said if role == "assistant")
        assert r.n_turns == len(said) and r.loss_chars == len(spoken)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(spoken.encode()).hexdigest()
    assert chat.digests(chat.format_windows(turns(spark, rows).limit(0))).count() == 0
