from __future__ import annotations

import json
import random

import pytest

from weftgraph.llm import chat

PARTS = ["<s>", "</s>", "\\", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<", "[", "/", "s>", "\n", "n", "a", "é", "😀", "user", ""]


def test_templates_read_back():
    rng = random.Random(2)
    text = lambda k: "".join(rng.choices(PARTS, k=rng.randint(0, k)))
    for _ in range(5000):
        turns = [(rng.choice(("assistant", "user", text(3))), text(8)) for _ in range(rng.randint(0, 4))]
        formatted, starts, ends = chat.render(turns)
        assert chat.read_back(formatted) == turns
        assert chat.loss_text(formatted, starts, ends) == "".join(t for r, t in turns if r == "assistant")
        assert not chat.CONTROL.search("".join(chat.escape(t) for _, t in turns[:1]))


@pytest.mark.parametrize(("record", "layout", "turns"), [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]}, "messages", [("user", "q"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "from_value", [("user", "q"), ("assistant", "a")]),
    ({"prompt": "p", "completion": "c", "score": 3, "meta": {"x": [1]}}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"instruction": "i", "input": "x", "output": "o"}, "instruction_input", [("user", "i\n\nx"), ("assistant", "o")]),
    ({"instruction": "i", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"question": "q", "answer": 4}, "question_answer", [("user", "q"), ("assistant", "4")]),
    ({"turns": [{"speaker": "bot", "utterance": "u"}]}, "turns", [("assistant", "u")]),
    ({"system": "s", "prompt": "p", "response": "r"}, "system_prompt_response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"messages": [{"role": "user", "content": "", "text": "t"}, {"role": "bot", "content": "c", "text": "u"}]}, "message_either",
     [("user", "t"), ("assistant", "c")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]}]},
     "message_parts", [("user", "ab")]),
    ({"messages": [{"role": "user", "content": [{"text": "a"}]}, {"role": "assistant", "content": "b"}]}, "message_mixed",
     [("user", "a"), ("assistant", "b")]),
    ({"system": "s", "messages": [{"role": "user", "content": "q"}]}, "system_messages", [("system", "s"), ("user", "q")]),
    ({"system": "", "conversations": [{"from": "human", "value": "q"}]}, "system_from_value", [("user", "q")]),
    ({"system": "s", "instruction": "i", "input": "", "output": "o"}, "system_instruction_input",
     [("system", "s"), ("user", "i"), ("assistant", "o")]),
    ({"other": 1}, None, []), ([1], None, []), ({}, None, []), ({"messages": []}, None, []), ({"messages": {"role": "r"}}, None, []),
    ({"messages[]": {"role": "r", "content": "c"}}, None, []), ({"messages[].role": 1, "messages[].content": 2}, None, []),
    ({"messages": {"[].role": 1, "[].content": 2}}, None, []), ({"prompt": ["p"], "completion": "c"}, None, []),
])
def test_fingerprints_choose_the_mapping(record, layout, turns):
    name, _, found = chat.canonical(json.dumps(record))
    assert (name, found) == (layout, turns)


def test_broken_records():
    assert chat.canonical(None) == chat.canonical("{") == (None, None, [])
    deep = "[" * 100_000 + "]" * 100_000
    assert chat.canonical(deep) == chat.canonical('{"prompt": "p", "completion": ' + deep + "}") == (None, None, [])
    assert chat.canonical('{"prompt": "p", "completion": "c", "x": ' + "[" * 500 + "]" * 500 + "}")[0] == "prompt_completion"


def test_lone_surrogates_are_replaced(spark):
    record = '{"messages": [{"role": "user", "content": "a\\ud800b \\ud83d\\ude00"}], "x\\udc00": 1}'
    assert chat.canonical(record)[2] == [("user", "a\ufffdb 😀")]
    rows = spark.createDataFrame([(1, record)], "id long, record string")
    found = chat.format_records(rows, id_col="id", record_col="record").first()
    assert chat.read_back(found["formatted"]) == [("user", "a\ufffdb 😀")] and found["n_turns"] == 1


def test_turn_tables(spark):
    rows = [
        (1, 1, "assistant", "</s>[INST] ok [/INST]", "x"), (1, 0, "user", None, "y"), (2, 0, None, "", None), (None, 0, "user", "n", None),
        (3, 0, "assistant", "b", None), (3, 0, "assistant", "a", None), (3, 0, "assistant", "a", None), (4, None, "x\ny", "\\", None),
        (5, 0, "assistant", "long " * 50_000, None),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record string")
    records = chat.records_of_turns(turns)
    found = {r["id"]: r for r in chat.format_records(records, id_col="id", record_col="record").collect()}
    assert chat.read_back(found[1]["formatted"]) == [("user", ""), ("assistant", "</s>[INST] ok [/INST]")]
    assert [t for _, t in chat.read_back(found[3]["formatted"])] == ["a", "a", "b"] and found[3]["loss_chars"] == 3
    assert chat.read_back(found[4]["formatted"]) == [("x\ny", "\\")] and found[4]["loss_chars"] == 0
    assert chat.read_back(found[2]["formatted"]) == [("", "")] and found[None]["n_turns"] == 1 and found[5]["loss_chars"] == 250_000
    # in whatever layout a conversation is written, it reads the same
    several = chat.records_of_turns(turns, layouts=chat.LISTS)
    again = chat.format_records(several, id_col="id", record_col="record").collect()
    assert {r["id"]: r["formatted"] for r in again} == {i: r["formatted"] for i, r in found.items()}
    for name in chat.LISTS:
        rows_ = chat.format_records(chat.records_of_turns(turns, layouts=(name,)), id_col="id", record_col="record").collect()
        assert {(r["layout"], r["formatted"]) for r in rows_} == {(name, r["formatted"]) for r in found.values()}
    assert chat.format_records(chat.records_of_turns(turns.limit(0)), id_col="id", record_col="record").count() == 0
