"""Prefix-target examples against plain Python, and the template's escapes."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelftally.llm import chat, queries

SF = "/root/testdata/sf0.01"
TURNS = "conv_id long, turn long, role string, text string, example long, place string"
NASTY = ["[INST]", "[/INST]", "</s>", "\\", "\\\\", "[", "/INST]", "<", "/s>", " ", "\n", "[\\INST]", "<\\/s>", "a"]


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], TURNS)


def escaped(s):
    s = s.replace("\\", "\\\\")
    for control in ("[INST]", "[/INST]", "</s>"):
        s = s.replace(control, control[0] + "\\" + control[1:])
    return s


def test_examples(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "r</s>"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "bye")]
    got = sorted(chat.prefix_targets(turns(spark, rows)).collect(), key=lambda r: r["example"])
    assert [(r["turns"], r["whole"], r["loss_chars"]) for r in got] == [(3, False, 6), (5, False, 0), (6, True, 0)]
    head = "[INST] system [/INST] s</s>[INST] user [/INST] u</s>[INST] assistant [/INST] r<\\/s></s>"
    assert got[0]["text"] == head and head[got[0]["loss_start"] :][:6] == "r<\\/s>"
    assert got[2]["text"].startswith(got[1]["text"]) and got[1]["text"].startswith(head)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "[/INST]", "x [/INST", ""]), st.lists(st.sampled_from(NASTY), max_size=6).map("".join)), min_size=1, max_size=12))
def test_escapes_round_trip(spark, pairs):
    rows = [(n // 3, n, role, text) for n, (role, text) in enumerate(pairs)]
    got = {r["conv_id"]: r for r in chat.read_back(chat.prefix_targets(turns(spark, rows))).collect()}
    for conv in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == conv]
        loss = "".join(t for _, _, role, t in mine if role == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in mine).encode()).hexdigest()
        assert got[conv]["n_turns"] == len(mine)
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_defined_cases(spark):
    rows = [(None, 1, "user", "a"), (None, None, None, None), (2, 1, "assistant", "b"), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (3, 9, "user", "x" * 500_000)]
    got = {r["conv_id"]: r for r in chat.read_back(chat.prefix_targets(turns(spark, rows))).collect()}
    assert got[None]["n_turns"] == 2 and got[None]["turns_sha256"] == hashlib.sha256(b"user\na\n\n\n").hexdigest()
    assert got[2]["loss_sha256"] == hashlib.sha256(b"aab").hexdigest()
    assert got[3]["formatted_chars"] == 500_000 + len("[INST] user [/INST] </s>") and got[3]["loss_chars"] == 0
    assert chat.prefix_targets(turns(spark, [])).count() == 0


def test_many_turns(spark):
    rows = spark.range(400).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), F.lit("word " * 50).alias("text"))
    examples = chat.prefix_targets(rows)
    assert examples.count() == 200
    assert chat.read_back(examples).first()["loss_chars"] == 200 * 250


def test_planted_conversation_and_plan(spark):
    frame = queries.op1_chat_prefix_targets(spark, SF)
    planted = frame.where("conv_id = -7").first()
    assert planted["loss_sha256"] == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()
    plan = frame._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
