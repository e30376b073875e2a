"""Chat formatting: round trips and a plain version."""

import random

from pyspark.sql import functions as F

from riskweave.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segments string, formatted string"


def run(spark, rows):
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    return {r["conv_id"]: r for r in chat.parse_formatted(chat.format_conversations(frame)).collect()}


NASTY = ["<|end|>\n", "<|sep|>", "<\\|role:user|>\n", "<\\\\|", "<|", "<", "\\", "|>", "\n", "é漢", "", "$1 \\1", "<<|end|>", "<|role:assistant|>\nhi"]


def test_round_trip_of_nasty_texts(spark):
    rng = random.Random(4)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "a|>b\\p\\e|", "<|sep|>"]), "".join(rng.choices(NASTY, k=rng.randrange(5)))))
    shuffled = rows[:]
    rng.shuffle(shuffled)
    got = run(spark, shuffled)
    for c in range(60):
        mine = [(r[2], r[3]) for r in rows if r[0] == c]
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == mine
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(mine, mine[1:]))
        assert len(got[c]["blocks"]) == blocks
        assert got[c]["formatted"] == "".join(s["text"] for s in got[c]["segments"])
        learnt = [s["text"] for s in got[c]["segments"] if s["loss"]]
        assert len(learnt) == sum(r == "assistant" for r, _ in mine)


def test_nulls_ties_and_repeats(spark):
    rows = [(1, None, "user", "first"), (1, 2, None, None), (1, 2, "assistant", "b"), (1, 2, "assistant", "a"), (1, 3, "user", "x"), (1, 3, "user", "x"),
            (None, 1, "assistant", "lost")]
    got = run(spark, rows)
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", "first"), ("", ""), ("assistant", "a"), ("assistant", "b"), ("user", "x"), ("user", "x")]
    assert len(got[1]["blocks"]) == 4 and [t["text"] for t in got[None]["turns"]] == ["lost"]


def test_empty_and_long(spark):
    assert run(spark, []) == {}
    long = [(1, t, "user" if t % 3 else "assistant", "z" * 50) for t in range(5000)]
    got = run(spark, long)[1]
    assert len(got["turns"]) == 5000 and got["turns"][4999]["text"] == "z" * 50


def test_plan_stays_in_expressions(spark):
    frame = chat.op6_chat_formatting(spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1
    assert frame.where(F.col("conv_id") == -7).first()["n_turns"] == 2
