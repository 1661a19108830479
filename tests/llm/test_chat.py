"""Chat formatting: exact round trips, spans of the loss mask, digests against hand-made ones."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from punctual.llm import chat

PIECES = st.lists(st.sampled_from(["<turn>", "<text>", "</turn>", "\\", "\\\\", "\n", "a", "<", ">", "é", "\U0001f600", "</turn"]), max_size=9)
STRINGS = PIECES.map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(STRINGS, STRINGS), max_size=5))
def test_turns_come_back(turns):
    made = [chat.render(*t) for t in turns]
    assert chat.parse("".join(m[0] for m in made)) == (turns, "")
    for (out, start, end), (_, text) in zip(made, turns, strict=True):
        assert out[start:end] == chat.escape(text) and out[end:] == "</turn>\n"


def test_clean_turns_stay_as_they_are():
    assert chat.render("user", "a \\ b < c")[0] == "<turn>user<text>a \\ b < c</turn>\n"
    assert chat.render("user", "\\</turn>")[0] == "<turn>user<text>\\\\\\</turn></turn>\n"


@pytest.mark.parametrize("bad", ["x", "<turn>a</turn>\n", "<turn>a<text>b</turn>c", "<turn>a<text>b<text>c</turn>\n"])
def test_conflicts_are_seen(bad):
    with pytest.raises(chat.Conflict):
        chat.parse(bad)


def test_unfinished_turns_are_left():
    whole = chat.render("u", "x")[0]
    for n in range(1, len(whole)):
        assert chat.parse(whole + whole[:n]) == ([("u", "x")], whole[:n])


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, turns in convs.items():
        turns.sort()
        learned = "".join(t for _, _, r, t in turns if r == "assistant")
        all_ = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        chars = sum(len(chat.render(r, t)[0]) for _, _, r, t in turns)
        sha = [hashlib.sha256(s.encode()).hexdigest() for s in (all_, learned)]
        out.append((c, len(turns), sha[0], len(learned), sha[1], chars))
    return sorted(out, key=repr)


SCHEMA = "conv_id long, turn long, role string, text string, formatted string, n long"


def test_round_trip(spark):
    rnd = random.Random(3)
    parts = ["<turn>", "</turn>", "<text>", "\\", "word ", "\n", "ü"]
    rows = [(c, t, rnd.choice(["user", "assistant", "<text>", None]), "".join(rnd.choices(parts, k=rnd.randint(0, 12)))) for c in range(40) for t in range(c % 7)]
    rows += [(99, None, "user", None), (99, 0, "assistant", ""), (99, 1, None, "x"), (None, 0, "assistant", "lost"), (None, 1, None, None)]
    rows += [(50, t, "assistant", "same") for t in range(300)] + [(51, 0, "assistant", "w </turn> " * 200_000)]
    rows += [(60, 1, "user", "tie"), (60, 1, "user", "tie"), (60, 1, "assistant", "tie")]
    rnd.shuffle(rows)
    got = chat.round_trip(spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_no_rows(spark):
    assert chat.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
