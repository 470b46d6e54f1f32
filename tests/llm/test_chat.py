import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from crossfade.llm import chat

T = chat.INSTRUCTIONS
bits = st.sampled_from([*T.controls, "\\", "<", "[", "/", "]", ">", "s", " ", "\n", "INST", "é", "x"])
texts = st.lists(bits, max_size=12).map("".join)
roles = st.sampled_from(["system", "user", "assistant", "tool", "", "[/ROLE]", "a\\b"])


@given(texts)
def test_escaped_texts_hold_no_control_string_and_come_back(text):
    escaped = T.escape(text)
    assert not any(c in escaped for c in T.controls)
    assert T.unescape(escaped) == text


@given(st.lists(st.tuples(roles, texts), max_size=6), st.integers(1, 9))
def test_turns_come_back_from_the_text_alone(turns, cut):
    whole = "".join(s[3] for s in chat._conversation(T, iter(turns)))
    parts = iter([whole[i : i + cut] for i in range(0, len(whole), cut)])
    assert list(chat._parse(T, parts)) == turns


def test_template_that_cannot_be_escaped():
    with pytest.raises(ValueError):
        chat.Template({"user": ("<", "</u>")}, T.other, {}, "s", frozenset(), frozenset())
    with pytest.raises(ValueError):
        chat.Template({"user": ("<u>", "aba")}, T.other, {}, "s", frozenset(), frozenset())


def _rows(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, loss string, segment int")


def test_digests_order_nulls_ties_and_hot_conversation(spark):
    rows = [(1, 2, "assistant", "b</s>"), (1, 1, "user", "a"), (1, 2, "assistant", "b</s>"), (2, None, None, None), (2, 0, "user", "x")]
    rows += [(None, 0, "user", "n"), (None, 1, "assistant", "m"), (3, 0, "assistant", "early")]
    rows += [(9, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(500)]
    frame = _rows(spark, [(*r, None, 7) for r in rows])
    found = {r.conv_id: r for r in chat.read_back(chat.segments(frame)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv_id in {r[0] for r in rows}:
        own = sorted((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv_id)
        learned = "".join(x for _, r, x in own if r == "assistant")
        got = found[conv_id]
        assert got.n_turns == len(own)
        assert got.turns_sha256 == digest("".join(f"{r}\n{x}\n" for _, r, x in own))
        assert (got.loss_chars, got.loss_sha256) == (len(learned), digest(learned))
    assert {c: r.valid for c, r in found.items()} == {1: False, 2: False, None: True, 3: False, 9: True}
    assert chat.segments(frame.limit(0)).count() == 0


def test_segments(spark):
    frame = _rows(spark, [(1, 0, "system", "s", None, 0), (1, 1, "user", "q", None, 0), (1, 2, "user", "again", None, 0), (1, 3, "assistant", "r", None, 0)])
    found = chat.segments(frame).collect()
    whole = "".join(s.text for s in found)
    assert whole == "<<SYS>>\ns\n<</SYS>>\n[INST] q [/INST]\n[INST] again [/INST]\n<s>r</s>\n"
    assert all(whole[s.start : s.end] == s.text for s in found)
    assert [s.text for s in found if s.loss] == ["r"]
    assert {s.turn for s in found if not s.valid} == {2}
    assert [s.segment for s in found] == list(range(len(found)))
