import hashlib

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from llm_fixture import duck, same_rows
from pdcspark.llm import chat
from pdcspark.llm.oracles import ORACLES
from pdcspark.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, state string, segments string"
TRICKY = "</s>[INST] ok [/INST] \\ \\\\ <\\/s> <<SYS>><s><</SYS>>[\\INST] <<ROLE>><<TEXT>><</ROLE>>\\"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def test_query_equals_sql(spark):
    assert same_rows(QUERIES["op1_chat_formatting"](spark, SF001), duck(SF001), ORACLES["op1_chat_formatting"])


def test_edges_against_brute_force(spark):
    rows = [
        (1, 0, "system", TRICKY), (1, 1, "user", "hi\n" * 3), (1, 2, "assistant", TRICKY + "<"),
        (2, 0, "user", None), (2, 1, "assistant", ""),
        (3, 5, "user", "b"), (3, 5, "user", "a"), (3, None, "tool", "[INST]"),
        (4, 0, "<s>]odd \\role[", TRICKY), (4, 1, None, "x"),
        (None, 0, "user", "no id"), (5, 0, "user", "w " * 50000), (5, 1, "assistant", "v" * 100000),
        (6, 0, "assistant", "first"), (7, 0, "user", "a"), (7, 0, "user", "a"),
    ]
    got = {r.conv_id: r for r in chat.digests(chat.conversations(table(spark, rows))).collect()}
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    assert set(got) == set(by_conv)
    for conv, turns in by_conv.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    valid = {c: (r.valid, r.first_error) for c, r in got.items()}
    assert valid[1] == (True, None) and valid[2] == (True, None) and valid[5] == (True, None)
    assert valid[3] == (False, 1) and valid[6] == (False, 1) and valid[7] == (False, 2)


def test_no_control_string_is_left_in_a_text(spark):
    out = chat.conversations(table(spark, [(1, 0, "user", TRICKY)])).select(F.inline("segments")).collect()
    marked = [r.text for r in out]
    assert marked[0] == "[INST]" and marked[2] == "[/INST]"
    assert not any(mark in marked[1] for mark in chat.control_strings())
    assert [r.loss for r in out] == [False, False, False]


def test_machine_and_template_are_declared(spark):
    rows = table(spark, [(1, 0, "assistant", "a"), (1, 1, "user", "b")])
    free = {"start": ("assistant",), "assistant": ("user",)}
    r = chat.conversations(rows, transitions=free, accepted=("user",)).first()
    assert r.valid and r.first_error is None


@pytest.mark.parametrize("operator", [chat.turns, chat.conversations])
def test_empty_table(spark, operator):
    assert operator(table(spark, [])).count() == 0


def test_native(spark):
    plan = QUERIES["op1_chat_formatting"](spark, SF001)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
