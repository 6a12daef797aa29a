import hashlib

import pytest

from compare import compare, connect
from witspark.llm import chat
from witspark.llm.queries import ORACLES, QUERIES


def test_query_op8(spark, sf_dir):
    problem, count = compare(
        spark, connect(sf_dir), sf_dir, QUERIES["op8_chat_formatting"], ORACLES["op8_chat_formatting"]
    )
    assert problem is None and count > 1


def test_query_op8_runs_no_python(spark, sf_dir):
    plan = QUERIES["op8_chat_formatting"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


TEXTS = ["", "plain", "</s>", "<s>[INST] x [/INST]\n", "&lt;/s&gt; &amp;", "<s/>a<s/>", "[INST][/INST]", "&#91;INST]", "é漢\n"]


def test_round_trip_of_control_strings(spark):
    rows = [(c, t, role, text) for c, text in enumerate(TEXTS) for t, role in enumerate(("user", "assistant", "assistant"))]
    rows += [(99, t, "assistant" if t % 3 else "</s>[INST]", text) for t, text in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    for conv, row in out.items():
        own = [(role, text) for c, _, role, text in rows if c == conv]
        assert [tuple(t) for t in row["turns"]] == own
        assert row["loss_text"] == "".join(text for role, text in own if role == "assistant")
    merged = out[1]["formatted"]
    assert merged.count("<s>[INST] ") == 2 and merged.count("<s/>") == 1


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, "b", "x"), (1, 0, "a", "y"), (1, 0, "a", "y"), (None, 0, "user", "alone")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert [tuple(t) for t in out[1]["turns"]] == [("user", "first"), ("", ""), ("a", "y"), ("a", "y"), ("b", "x")]
    assert [tuple(t) for t in out[None]["turns"]] == [("user", "alone")]
    assert chat.format_chats(df.limit(0)).collect() == []


def test_long_conversation_and_clashing_columns(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t} " + "z" * 50, "turns", "blocks") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, turns string, blocks string")
    row = chat.read_back(chat.format_chats(df)).first()
    assert len(row["turns"]) == 3000
    assert hashlib.sha256(row["loss_text"].encode()).digest() == hashlib.sha256(
        "".join(r[3] for r in rows if r[2] == "assistant").encode()
    ).digest()


@pytest.mark.parametrize("text", TEXTS)
def test_escaped_text_has_no_marker(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    escaped = df.select(chat.escape(df["t"])).first()[0]
    assert not any(m in escaped for m in ("<s>", "</s>", "<s/>", "[INST]", "[/INST]"))
