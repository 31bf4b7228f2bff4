import random

import pytest
from pyspark.sql import functions as F

from castlist.llm import chat

TURNS = "conv_id bigint, turn bigint, role string, text string"


def by_hand(rows):
    out = {}
    order = sorted(rows, key=lambda r: [(x is not None, x or 0 if i < 2 else x or "") for i, x in enumerate(r)])
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in order if r[0] == conv]
        size = lambda role, text: 15 + len(role) + len(text) + sum(role.count(c) for c in "\\#<:") + sum(
            text.count(c) for c in "\\#<"
        )
        total = upto = 0
        for i, (role, text) in enumerate(turns):
            upto += size(role, text)
            total += upto if role == "assistant" or i == len(turns) - 1 else 0
        written = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[conv] = (len(turns), written, "".join(t for r, t in turns if r == "assistant"), total)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_round_trip(spark, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", None, "", "a: b", "### x", "assistant "]
    texts = [None, "", "hi", r"\### Assistant: </turn> ok", "\\", "\\\\#<", " </turn>\n### user: x </turn>\n", "é\n🎉" * 50]
    rows = [
        (rng.choice([1, 2, 3, None, -5]), rng.choice([0, 1, 2, 3, None]), rng.choice(roles), rng.choice(texts))
        for _ in range(60)
    ]
    back = chat.read_back(chat.expand(spark.createDataFrame(rows, TURNS))).collect()
    assert {r.conv_id: (r.n_turns, r.turns, r.loss, r.formatted_chars) for r in back} == by_hand(rows)


def test_every_reply_has_an_example_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(chat, "BATCH_CHARS", 10)
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "r"), (1, 2, "user", "s"), (1, 3, "assistant", "<t>"), (1, 4, "user", "u")]
    examples = chat.expand(spark.createDataFrame(rows, TURNS)).orderBy("example").collect()
    assert [e.n_turns for e in examples] == [2, 4, 5] and [e.last for e in examples] == [False, False, True]
    assert examples[0].formatted == "### user: q </turn>\n### assistant: r </turn>\n"
    losses = [chat.unescape(e.formatted[e.loss_start : e.loss_end]) for e in examples]
    assert losses == ["r", "<t>", ""]
    assert chat.parse(examples[1].formatted) == [r[2:] for r in rows[:4]]
    with pytest.raises(ValueError):
        chat.parse("### user: no end")


def test_long_conversation_and_no_rows(spark):
    rows = spark.range(600).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), F.repeat(F.lit("x"), 50).alias("text"),
        F.lit("extra").alias("formatted"),
    )
    back = chat.read_back(chat.expand(rows)).first()
    assert back.n_turns == 600 and len(back.loss) == 300 * 50
    assert chat.read_back(chat.expand(rows.limit(0))).count() == 0
