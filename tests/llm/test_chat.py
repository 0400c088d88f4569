import hashlib
import random

from pyspark.sql import functions as F

from claimweave.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, turns int, blocks string"
PARTS = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<sep>", "\\", "<", "[", "/", "x", " ", "\n", "é", "𝄞", "$1", "<\\", "[\\"]


def test_round_trip(spark):
    rng = random.Random(2)
    rows = [(i, t, rng.choice(["user", "assistant", "assistant", "system", "tool<sep>", None]), rng.choice([None, "", *("".join(rng.choices(PARTS, k=rng.randrange(8))) for _ in range(6))]), 0, "c") for i in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(None, None, "user", "a", 0, "c"), (None, 3, "user", "b", 0, "c"), (99, 1, "user", "same", 0, "c"), (99, 1, "user", "same", 0, "c"), (99, 1, "assistant", "tie", 0, "c")]
    formatted = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).cache()
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    strings = {r.conv_id: r.formatted for r in formatted.collect()}
    by = {}
    for c, t, role, text, *_ in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        lines = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == len(strings[c])
        assert got[c].n_blocks == 1 + sum(a[1] != b[1] for a, b in zip(turns, turns[1:]))


def test_no_control_string_survives(spark):
    text = "".join(PARTS) * 2
    out = spark.range(1).select(chat.escape(F.lit(text)).alias("x"), chat.unescape(chat.escape(F.lit(text))).alias("y")).first()
    assert not any(m in out.x for m in ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<sep>", "<<ROLE>>"]) and out.y == text


def test_empty_table(spark):
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0
