import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from windrow.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, extra int"
NASTY = st.lists(st.sampled_from([*"\\<>/turnx:\n é🎉", "<turn", "</turn>", "\n</turn>\n", "<turn:user\n"]), max_size=12).map("".join)


@given(st.lists(st.tuples(NASTY, NASTY), max_size=6))
def test_template_reads_back(turns):
    text = "".join("".join(C.turn_text(r, t)) + C.TURN_END for r, t in turns)
    assert C.read_turns(text) == turns


def run(spark, rows):
    return C.expand_prefix_targets(spark.createDataFrame(rows, SCHEMA))


def test_each_reply_is_an_example(spark):
    rows = [(1, 0, "system", "s", 0), (1, 1, "user", "u", 0), (1, 2, "assistant", C.PROBE, 0), (1, 3, "user", "v", 0), (1, 4, "assistant", "b", 0)]
    got = run(spark, rows).orderBy("example").collect()
    assert [(r.example, r.n_turns, r.last) for r in got] == [(0, 3, False), (1, 5, True)]
    assert [C.unescape(r.text[r.loss_start : r.loss_end]) for r in got] == [C.PROBE, "b"]
    assert got[1].text.startswith(got[0].text) and len(C.read_turns(got[0].text)) == 3


def test_tail_and_conversations_without_replies(spark):
    got = run(spark, [(1, 0, "assistant", "a", 0), (1, 1, "user", "u", 0), (2, 0, "user", "u", 0)]).orderBy("conv_id", "example").collect()
    assert [(r.conv_id, r.n_turns, r.loss_start is None, r.last) for r in got] == [(1, 1, False, False), (1, 2, True, True), (2, 1, True, True)]


def told(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        replies = [t for _, role, t in own if role == "assistant"]
        out[conv] = (len(own), sha("".join(f"{r}\n{t}\n" for _, r, t in own)), len("".join(replies)), sha("".join(replies)))
    return out


def test_digests_with_nulls_repeats_and_long_texts(spark):
    rows = [
        (1, 0, "user", None, 0), (1, 1, "assistant", "x" * 300_000, 0), (1, 1, "assistant", "x" * 300_000, 0), (2, 0, None, "t", 0), (None, 0, "assistant", "n", 0),
        (3, None, "assistant", "é🎉", None), (4, 2, "assistant", "later", 0), (4, 1, "assistant", "", 0), (5, 0, "a\nb", "</turn>\\", 0),
    ]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.digest_examples(run(spark, rows)).collect()}
    assert got == told(rows)


def test_empty_table(spark):
    assert C.digest_examples(run(spark, [])).count() == 0


@pytest.mark.parametrize("turns", [300])
def test_long_conversation(spark, turns):
    rows = [(1, i, ("user", "assistant")[i % 2], "word " * 20, 0) for i in range(turns)]
    examples = run(spark, rows)
    assert examples.count() == turns // 2
    assert C.digest_examples(examples).first().n_turns == turns
