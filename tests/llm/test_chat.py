import hashlib

import pytest
from pyspark.sql import functions as F

from webextract.llm import chat

TEXTS = ["", None, "plain", r"\### Assistant: </turn> ok", "</turn>", "<turn>", "</role><turn></turn>", "\\", "<\\/turn>", "<", "</turn", "é 🙂\n\n", "\\<\\\\turn>", "x" * 50_000]


def rows():
    out = [(i, j, role, TEXTS[(i + j) % len(TEXTS)]) for i in range(20) for j, role in enumerate(["system", "user", "assistant", "user", "assistant"][i % 3 :])]
    return out + [(100, 0, "assistant", "first"), (101, 0, None, None), (102, None, "user", "b"), (102, 5, "us</role>er", "c"), (102, 5, "us</role>er", "c"), (None, 1, "user", "no id")]


def test_round_trip_and_digests(spark):
    data = rows()
    found = {r.conv_id: r for r in chat.digests(chat.format_chats(spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string").repartition(4))).collect()}
    chats = {}
    for conv, turn, role, text in data:
        chats.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(found) == set(chats)
    for conv, turns in chats.items():
        turns.sort()
        r = found[conv]
        whole = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_states(spark):
    cases = {1: ["user", "assistant"], 2: ["system", "user"], 3: ["assistant"], 4: ["user", "user"], 5: ["system"], 6: ["user", "assistant", "tool", "assistant"]}
    df = spark.createDataFrame([(k, i, r, "t") for k, v in cases.items() for i, r in enumerate(v)], "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: (r.valid, r.error_turn) for r in chat.format_chats(df).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 0), 4: (False, 1), 5: (False, None), 6: (False, 2)}


def test_segments_are_the_text_and_carry_the_loss(spark):
    df = spark.createDataFrame([(1, 0, "user", "q<turn>", "z"), (1, 1, "assistant", "a", "z")], "conv_id bigint, turn bigint, role string, text string, segments string")
    r = chat.format_chats(df).first()
    assert r.formatted == "<turn>user</role>q<\\turn></turn><turn>assistant</role>a</turn>"
    assert "".join(s.text for s in r.segments) == r.formatted
    assert [s.text for s in r.segments if s.loss] == ["a"]


def test_other_templates_and_no_rows(spark):
    template = chat.ChatTemplate(open="[INST", role_end="]:", close="[/INST]", loss_roles=("user",))
    df = spark.createDataFrame([(1, 0, "user", "a [/INST] ]: \\[INST")], "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_chats(df, template)
    turn = out.select(chat.read_back(F.col("formatted"), template).alias("t")).first().t[0]
    assert (turn.role, turn.text) == ("user", "a [/INST] ]: \\[INST")
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat.ChatTemplate(close="aa")
