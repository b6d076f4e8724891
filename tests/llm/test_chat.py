import hashlib
from collections import defaultdict

import plain
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pricing_engine.llm import chat, queries

SF_DIR = "/root/testdata/sf0.001"
TURN = "conv_id long, turn long, role string, text string"


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def expected(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns[conv].append((role or "", text or ""))
    out = set()
    for conv, own in turns.items():
        loss = "".join(t for r, t in own if r == "assistant")
        out.add((conv, len(own), digest(f"{r}\n{t}\n" for r, t in own), len(loss), digest([loss])))
    return out


def test_query_reads_back_every_turn(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in plain.read(spark, SF_DIR, "conversations")]
    control = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", control), (-1, 1, "assistant", control)]
    found = queries.op3_chat_examples(spark, SF_DIR).collect()
    assert {tuple(r)[:5] for r in found} == expected(rows) and len(found) == len(expected(rows))
    made = chat.examples(spark.createDataFrame(rows, TURN)).collect()
    lengths = defaultdict(int)
    for r in made:
        lengths[r.conv_id] += len(r.text)
    assert {r.conv_id: r.formatted_chars for r in found} == lengths
    shown = next(r for r in made if r.conv_id == -1)
    assert "</s>" not in shown.text and "[INST]" not in shown.text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=8), st.lists(st.sampled_from([*chat.CONTROL, "\\", "\n", "<", "[", "x", "é"]), max_size=8).map("".join))))
def test_formatting_is_reversible(turns):
    text = "".join(chat.turn_text(r, t)[0] for r, t in turns)
    assert list(chat.parse(text)) == turns
    for role, body in turns:
        whole, start, end = chat.turn_text(role, body)
        assert chat.unescape(whole[start:end]) == body
        assert not any(c in chat.escape(body) for c in chat.CONTROL)


def test_an_example_for_every_reply(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "user", "v"), (1, 4, "assistant", "b"), (1, 5, "user", "w")]
    made = chat.examples(spark.createDataFrame(rows, TURN)).collect()
    assert [(r.example, r.trainable, r.text[r.loss_start : r.loss_end]) for r in made] == [(0, True, "a"), (1, True, "b"), (2, False, "")]
    assert [len(list(chat.parse(r.text))) for r in made] == [3, 5, 6]
    assert made[1].text.startswith(made[0].text)


@pytest.mark.parametrize(
    "rows",
    [
        [(1, None, None, None), (1, 0, "assistant", None), (None, 0, "user", "x"), (None, 1, "assistant", "y")],
        [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (2, 0, "tool\nname\\", "")],
        [(3, 0, "user", "long " * 50_000), (3, 1, "assistant", "<|im_end|>" * 1000)],
        [],
    ],
)
def test_edge_cases(spark, rows):
    schema = TURN + ", example int, loss_start int"
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], schema)
    assert {tuple(r)[:5] for r in chat.digests(chat.examples(frame)).collect()} == expected(rows)
