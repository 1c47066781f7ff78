from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from larder.llm import chat

HOSTILE = ["", "\\", "<|", "<\\|", "<|end|>", "\\<|turn|>\\", "a<", "|>", "<|text|>x\n\n", "\\### Assistant: </turn> ok", "é<|😀|>", "x" * 300_000]


def formatted(spark, rows, **how):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(F.col("text")))
    return chat.format_chat(turns, **how).withColumn("read", chat.read_chat(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("segments")))


@pytest.mark.parametrize("second", [0, 5, 9])
def test_round_trip(spark, second):
    rows = [(1, i, "assistant" if i % 2 else HOSTILE[second], t) for i, t in enumerate(HOSTILE)]
    got = formatted(spark, rows).collect()[0]
    assert [(r.role, r.text) for r in got.read] == [(r[2], r[3]) for r in rows]
    assert got.loss == "".join(t for i, t in enumerate(HOSTILE) if i % 2)
    for s, (_, _, role, text) in zip(got.segments, rows, strict=True):
        body = got.formatted[s.start : s.start + s.length]
        assert re.sub(r"(?s)\\(.)", r"\1", body) == text
        assert s.loss == (role == "assistant")


def test_nulls_ties_and_repeats(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 0, None, "b"), (1, None, "user", "first"), (None, 1, "user", "n")]
    got = {r.conv_id: r for r in formatted(spark, rows).collect()}
    assert [(r.role, r.text) for r in got[1].read] == [("user", "first"), ("", "b"), ("user", ""), ("user", "")]
    assert [(r.role, r.text) for r in got[None].read] == [("user", "n")]
    assert formatted(spark, []).count() == 0


def test_typed_parts(spark):
    part = lambda kind, text=None, ref=None, tokens=None: (kind, text, ref, tokens)
    rows = [
        (1, 0, "user", [part("text", "see "), part("image", ref="i1"), part(None, " <|image|> "), part("audio", ref="a1", tokens=7)], "x"),
        (1, 1, "assistant", [part("document", ref="d1"), part("weird", ref="w1")], "y"),
        (1, 2, "user", None, "z"),
    ]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}, formatted string")
    got = chat.format_chat(turns).collect()[0]
    assert got.formatted == "<|turn|>user<|text|>see <|image|> <\\|image|> <|audio|><|end|><|turn|>assistant<|text|><|document|><|document|><|end|><|turn|>user<|text|><|end|>"
    assert [(a.ordinal, a.turn_index, a.type, a.ref, a.tokens) for a in got.attachments] == [(0, 0, "image", "i1", 256), (1, 0, "audio", "a1", 7), (2, 1, "document", "d1", 512), (3, 1, "document", "w1", 512)]
    assert got.attachment_tokens == 256 + 7 + 512 + 512


def test_long_conversation(spark):
    """A hundred thousand turns take seconds: their places are a running sum."""
    turns = spark.range(100_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), chat.text_parts(F.concat(F.lit("t"), F.col("id"))).alias("parts"))
    got = chat.format_chat(turns).collect()[0]
    assert [got.formatted[s.start : s.start + s.length] for s in got.segments] == [f"t{i}" for i in range(100_000)]
    read = spark.createDataFrame([(got.formatted,)], "t string").select(F.size(chat.read_chat(F.col("t"))).alias("n"))
    assert read.first().n == 100_000


def test_no_python_in_the_plan(spark):
    plan = formatted(spark, [(1, 0, "user", "x")])._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_query_equals_sql(spark, compare):
    got = compare(spark, "op2_chat_format", "sf0.01")
    assert (got["conv_id"] == -7).sum() == 1
