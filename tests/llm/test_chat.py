"""Chat formatting against a plain loop, and every turn read back."""

import random

import pytest
from pyspark.sql import functions as F

from wayread.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, bucket int, key string, turns string, segments string"
PIECES = ["###", "#", "</turn>", "\n", "</turn", ">", "\\", "h", "s", "t", " ", "### User: ", "é", "(", ")", ": ", "ok"]
ORDER = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("tool", "assistant")}


def read_back(spark, rows):
    table = spark.createDataFrame([(*r, 1, "k", "t", "s") for r in rows], SCHEMA).repartition(3)
    out = chat.formatted(table)
    back = out.select("*", chat.turns_of(F.col("formatted")).alias("back"), chat.under_loss(F.col("segments")).alias("under"))
    return {r["conv_id"]: r for r in back.collect()}


def plain(rows):
    conversations = {}
    for conv, turn, role, text in rows:
        conversations.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [(r, t) for _, _, r, t in sorted(turns)] for conv, turns in conversations.items()}


def first_bad(roles):
    before = None
    for i, role in enumerate(roles):
        if role not in ORDER.get(before, ()):
            return i
        before = role
    return None


def test_random_conversations(spark):
    draw = random.Random(5)
    roles = ["system", "user", "assistant", "tool", "judge: (x)", "", "System", None]
    rows = []
    for conv in range(60):
        for turn in range(draw.randint(1, 9)):
            text = None if draw.random() < 0.1 else "".join(draw.choice(PIECES) for _ in range(draw.randint(0, 12)))
            role = draw.choice(roles) if draw.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((conv if conv else None, None if draw.random() < 0.05 else turn // draw.choice([1, 1, 2]), role, text))
    rows += rows[:7]  # repeated rows are turns of their own
    expected, found = plain(rows), read_back(spark, rows)
    assert found.keys() == expected.keys()
    for conv, turns in expected.items():
        row = found[conv]
        assert [tuple(t) for t in row["back"]] == turns
        assert row["under"] == "".join(t for r, t in turns if r == "assistant")
        assert "".join(s["text"] for s in row["segments"]) == row["formatted"]
        assert [s["loss"] for s in row["segments"] if s["kind"] == "text"] == [r == "assistant" for r, _ in turns]
        assert not any(s["loss"] for s in row["segments"] if s["kind"] != "text")
        bad = first_bad([r for r, _ in turns])
        assert row["bad_turn"] == bad
        assert row["valid"] == (bad is None and turns[-1][0] in ("user", "assistant"))


def test_texts_that_quote_the_template(spark):
    said = "\\### Assistant: </turn> ok"
    row = read_back(spark, [(-7, 0, "user", said), (-7, 1, "assistant", said)])[-7]
    assert row["formatted"] == "### User: \\s\\h Assistant: \\t ok</turn>\n### Assistant: \\s\\h Assistant: \\t ok</turn>\n"
    assert [tuple(t) for t in row["back"]] == [("user", said), ("assistant", said)] and row["under"] == said


def test_one_long_conversation_among_short_ones(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i} " + "word " * 50) for i in range(3000)] + [(i, 0, "user", "hi") for i in range(2, 300)]
    found = read_back(spark, rows)
    assert len(found) == 299 and found[1]["valid"] and len(found[1]["back"]) == 3000
    assert found[1]["under"].count("turn ") == 1500


def test_empty_table(spark):
    assert read_back(spark, []) == {}


def test_plan_is_native(spark):
    table = spark.createDataFrame([(1, 0, "user", "x", 1, "", "", "")], SCHEMA)
    plan = chat.formatted(table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") <= 2


def test_templates_are_checked():
    with pytest.raises(ValueError):
        chat.Template(escapes={"###": "s", "</turn>": "t"})
    with pytest.raises(ValueError):
        chat.Template(closing="\n")
