import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from orrery.llm import chat_format as cf

PARTS = [*cf.CONTROL, "\\", " ", "a", "[", "]", "<", "/", "s>", "INST]", "\n", "</"]


@settings(max_examples=1500, deadline=None)
@given(st.sampled_from(["user", "assistant", "system", "to]ol", "", "x\\"]), st.lists(st.sampled_from(PARTS), max_size=8).map("".join))
def test_round_trip(role, text):
    piece, lo, hi = cf.round_trip(role, text)
    assert cf.parse_piece(piece) == (role, text)
    assert cf.unescape(piece[lo:hi]) == text


@settings(max_examples=500, deadline=None)
@given(
    st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "to]ol", "", "[ROLE", "x\\"]), st.lists(st.sampled_from([*PARTS, "[ROLE", "[/ROLE"]), max_size=6).map("".join)), max_size=5),
    st.lists(st.integers(0, 200), max_size=5),
)
def test_joined_conversation_cut_anywhere(turns, cuts):
    joined = cf.BEGIN + "".join(cf.round_trip(*t)[0] for t in turns)
    edges = sorted({0, len(joined), *(c for c in cuts if c < len(joined))})
    reader, got = cf.Conversation(), []
    for a, b in zip(edges, edges[1:]):
        got += reader.feed(joined[a:b])
    reader.close()
    assert got == turns


def test_control_string_that_the_template_completes():
    piece, lo, hi = cf.round_trip("user", "see [ROLE")
    assert piece == "[INST] see \\[ROLE [/INST]" and cf.unescape(piece[lo:hi]) == "see [ROLE"


def test_turn_that_swallows_the_next_is_noticed():
    reader = cf.Conversation()
    assert list(reader.feed("<s>[INST] open")) == [] and list(reader.feed(" ok</s>")) == []
    with pytest.raises(ValueError):
        reader.close()


def test_plain_text_is_not_escaped():
    assert cf.round_trip("user", "hello [there]")[0] == "[INST] hello [there] [/INST]"
    assert cf.round_trip("assistant", "ok")[0] == " ok</s>"
    assert cf.parse_piece("[INST] no end") is None and cf.parse_piece("[INST] a [/INST] b [/INST]") is None


def test_digests(spark):
    rows = [(1, 0, "user", "hi </s>", "x"), (1, 1, "assistant", "yes\\no [INST]", "x"), (1, 2, "assistant", None, None), (2, 5, None, "t" * 300_000, "x"), (None, 0, "assistant", "é", "x"), (1, 0, "user", "hi </s>", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")
    pieces = cf.format_turns(df)
    text = {(r.conv_id, r.turn): r.piece for r in pieces.collect()}
    got = {r.conv_id: r for r in cf.read_back(pieces).collect()}
    assert set(got) == {1, 2, None}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 4
    assert got[1].turns_sha256 == sha("user\nhi </s>\n" * 2 + "assistant\nyes\\no [INST]\n" + "assistant\n\n")
    assert (got[1].loss_chars, got[1].loss_sha256) == (13, sha("yes\\no [INST]"))
    assert got[1].formatted_chars == 3 + 2 * len(text[1, 0]) + len(text[1, 1]) + len(text[1, 2])
    assert got[2].loss_chars == 0 and got[2].loss_sha256 == sha("")
    assert cf.read_back(cf.format_turns(df.limit(0))).count() == 0
