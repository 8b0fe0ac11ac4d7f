from __future__ import annotations

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parleystat.llm import chat, queries
from parleystat.llm.common import table

TEXT = st.text(alphabet="\\#</>turn \nab🎉é:", max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=6))
def test_template_is_reversible(turns):
    marked = [chat.format_turn(role, text) for role, text in turns]
    whole = "".join(m for m, _, _ in marked)
    assert list(chat.parse_turns(whole)) == turns
    assert whole.count(chat.CLOSE) == len(turns)
    for (m, start, end), (_, text) in zip(marked, turns):
        assert chat.unescape(m[start:end]) == text
        assert "</turn>" not in m[start:end] and "###" not in m[start:end]


USER, BOT = ("user", "q"), ("assistant", "a")


@pytest.mark.parametrize(
    "record, layout, turns",
    [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages", [USER, BOT]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 3}, "conversations", [USER, BOT]),
        ({"data": {"dialog": [{"speaker": "human", "utterance": "q"}, {"speaker": "bot"}]}}, "dialog", [USER, ("assistant", "")]),
        ({"instruction": "q", "output": "a"}, "instruction", [USER, BOT]),
        ({"instruction": "q", "input": "r", "output": "a", "system": "s"}, "instruction", [("system", "s"), ("user", "q\n\nr"), BOT]),
        ({"instruction": "q", "input": "", "output": "a"}, "instruction", [USER, BOT]),
        ({"prompt": "q", "response": "a", "meta": {"x": [1]}}, "prompt_response", [USER, BOT]),
        ({"prompt": "q", "completion": None}, None, []),
        ({"prompt": "q", "completion": "a"}, "prompt_completion", [USER, BOT]),
        ({"question": "q", "context": "c", "answer": "a"}, "question_answer", [("user", "c\n\nq"), BOT]),
        ({"turn": 2, "role": "human", "text": "q"}, "turn_row", [("human", "q")]),
        ({"turn": 2, "role": "user"}, "turn_row", [("user", "")]),
        ({"messages": []}, None, []),
        ({"other": 1, "fields": {"x": 2}, "prompt": "q"}, None, []),
        ([1, 2], "turn_row", None),
    ],
)
def test_layouts(record, layout, turns):
    found = chat.Mapper()(json.dumps(record))
    if turns is None:
        assert found[0] is None
    else:
        assert (found[0], found[3]) == (layout, turns)


def test_fingerprints_tell_layouts_apart():
    marks = [m for x in chat.LAYOUTS for m in x.fingerprints()]
    assert len(marks) == len(set(marks))
    assert chat.fingerprint_of({"b", "a"}) == chat.fingerprint_of({"a", "b"})
    assert chat.paths_of({"a": [{"b": 1}, {"c": None}], "d": {}, "e": [1]}) == {"a[]", "a[].b", "e[]"}


def brute(rows):
    by_conv: dict = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by_conv.items():
        said = [(role, text) for _, _, role, text in sorted(turns)]
        loss = "".join(t for r, t in said if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in said)
        out.append((conv, len(said), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def test_table_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", queries.ESCAPED), (-7, 1, "assistant", queries.ESCAPED)]
    found = queries.op10_chat(spark, folder).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == brute(rows)
    assert all(r.formatted_chars > r.loss_chars for r in found)


def test_edge_cases(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, 0, "user", "x"),
            (2, None, None, None), (3, 0, "assistant", "é🎉" * 3000), (3, 1, "we\nird ### role", "</turn>\n### user\n")]
    records = [(c, json.dumps({k: v for k, v in zip(("turn", "role", "text"), r) if v is not None})) for c, *r in rows]
    records += [(9, "not json"), (9, None), (9, '{"unknown": 1, "prompt": 2}')]
    turns = chat.canonical_turns(spark.createDataFrame(records, "conv_id long, record string"))
    assert turns.where("layout is null").count() == 4  # the row without a role is one of them
    for segment in (1, 1 << 20):
        found = chat.read_back(chat.format_conversations(turns, segment)).collect()
        assert sorted((tuple(r)[:5] for r in found), key=str) == brute([r for r in rows if r[0] != 2])
    empty = chat.canonical_turns(spark.createDataFrame([], "conv_id long, record string"))
    assert chat.read_back(chat.format_conversations(empty)).collect() == []


def test_odd_json_fits_no_layout_or_a_defined_one(spark):
    """Records that once ended the job: nested too deeply, half a surrogate pair, places that are no longs."""
    deep, objects = "[" * 100_000 + "]" * 100_000, '{"a":' * 3000 + "1" + "}" * 3000
    turn = '{"turn": %s, "role": "user", "text": "x \\ud800 y"}'
    records = [deep, objects, '{"prompt": ' + objects + ', "response": "r"}', turn % "1", turn % 10**23, turn % "true", turn % ("9" * 5000), "\ud83d"[:0]]
    frame = spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")
    rows = {}
    for r in chat.canonical_turns(frame).collect():
        rows.setdefault(r.conv_id, []).append(r)
    assert set(rows) == set(range(len(records)))
    assert all(rows[k][0].layout is None for k in (0, 1, 6, 7))
    assert [(rows[k][0].place, rows[k][0].role, rows[k][0].text) for k in (3, 4, 5)] == [(1, "user", "x \ufffd y")] + [(None, "user", "x \ufffd y")] * 2
    formatted = chat.format_conversations(chat.canonical_turns(frame))
    assert formatted.count() >= 1
