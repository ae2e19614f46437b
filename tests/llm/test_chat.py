import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heliograph.llm import chat

LOG = "conv_id long, seq long, message string, kind string, role string, text string"


def turns(spark, rows):
    done = chat.render(chat.fold(spark.createDataFrame(rows, LOG)))
    out = done.withColumn("read", chat.read_back(F.col("formatted"))).withColumn("under", chat.masked(F.col("formatted"), F.col("loss_spans")))
    return {r.conv_id: ([(t.role, t.text) for t in r.read], r.under, r.formatted) for r in out.collect()}


def test_folding(spark):
    got = turns(spark, [
        (1, 1, "u", "start", "user", "hi"),
        (1, 2, "a", "start", "assistant", "He"),
        (1, 3, "a", "delta", None, "llo"),
        (1, 5, "a", "regenerate", "assistant", "Good"),
        (1, 6, "a", "delta", None, " day"),
        (1, 4, "u", "edit", "user", "hello"),
        (1, 7, "x", "start", "user", "oops"),
        (1, 8, "x", "delete", None, None),
        (2, 1, "d", "delta", "assistant", "only"),
        (None, None, "n", None, None, None),
    ])
    assert got[1][0] == [("user", "hello"), ("assistant", "Good day")] and got[1][1] == "Good day"
    assert got[2][0] == [("assistant", "only")]
    assert got[None][0] == [("", "")]


NASTY = ["<|im_end|>\n", "<|im_start|>assistant\n", "<\\|", "<\\\\|im_end|>", "<", "|", "\\", "<|", "\n", "a\\nb", "𝄞é", ""]


def test_control_strings_survive(spark):
    rows = [(i, j, str(j), "start", role, a + b) for i, a in enumerate(NASTY) for j, (role, b) in enumerate(zip(["user", "assistant"] * 6, NASTY, strict=True))]
    for conv, (read, under, formatted) in turns(spark, rows).items():
        mine = [r for r in rows if r[0] == conv]
        assert read == [(r[4], r[5]) for r in mine]
        assert under == "".join(r[5] for r in mine if r[4] == "assistant")
        assert formatted.count("<|im_end|>") == len(mine) == formatted.count("<|im_start|>")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys\ntem", "a\\nb", "<|im_end|>"]), st.text("<|\\>im_endstr\n", max_size=20)), min_size=1, max_size=6))
def test_round_trip(spark, said):
    rows = [(1, i, str(i), "start", r, t) for i, (r, t) in enumerate(said)]
    assert turns(spark, rows)[1][0] == said


def test_rows_of_turns(spark):
    table = spark.createDataFrame([(1, 2, "user", "b", 0), (1, 1, "user", "a", 0), (1, 1, "user", "a", 0), (1, None, None, None, 0), (2, 1, "assistant", "x", 0)], "conv_id long, turn long, role string, text string, kind int")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.fold(chat.as_log(table)).collect()}
    assert got == {1: [("", ""), ("user", "a"), ("user", "a"), ("user", "b")], 2: [("assistant", "x")]}
    assert chat.render(chat.fold(spark.createDataFrame([], LOG))).count() == 0


def test_native(spark):
    frame = chat.render(chat.fold(spark.createDataFrame([(1, 1, "m", "start", "user", "x")], LOG)))
    plan = frame._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow")) or pytest.fail(plan)


def test_long_conversations(spark):
    """Many turns, with texts that begin with byte order marks or lie beyond the basic plane."""
    n = 3000
    texts = ["﻿x" if i % 7 == 3 else "𝄞" * (i % 5) if i % 3 else f"{chat.END} turn {i}" for i in range(n)]
    turns = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(2, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    done = chat.render(chat.fold(chat.as_log(turns))).select("conv_id", chat.masked(F.col("formatted"), F.col("loss_spans")).alias("loss"), chat.read_back(F.col("formatted")).alias("turns"), F.size("loss_spans").alias("n"))
    got = {r.conv_id: r for r in done.collect()}
    assert got[1].loss == "".join(t for i, t in enumerate(texts) if i % 2) and got[1].n == n // 2
    assert [t.text for t in got[1].turns] == texts
    assert got[2].loss == "" and got[2].n == 0
