import hashlib

import pytest
from pyspark.sql import functions as F

from firegrid.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, example int"
HARD = ["", "\\", "\\\\", "</s>", "<s>x</s>", "[INST] ok [/INST]", "a\\</s>b\n", "<\\s>", "<<SYS>>é😀<</SYS>>", "$1 \\1"]


def expected(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip_of_hard_texts(spark):
    df = spark.createDataFrame([(t,) for t in HARD], "t string")
    rows = df.select("t", chat.escape(F.col("t")).alias("e")).select("*", chat.unescape(F.col("e")).alias("back")).collect()
    assert all(r.t == r.back for r in rows)
    assert not any(c in r.e for r in rows for c in chat.CONTROL)


def test_examples_and_digest(spark):
    rows = [(i, j, ["system", "user", "assistant"][(i + j) % 3], HARD[(i * 3 + j) % len(HARD)], "clash", 5) for i in range(12) for j in range(i + 1)]
    rows += [(50, 0, None, None, "x", 1), (50, 0, "assistant", "b", "x", 1), (50, 0, "assistant", "b", "x", 1), (51, None, "user", "first", "x", 1), (51, 0, "assistant", "then", "x", 1), (None, 0, "assistant", "lost", "x", 1)]
    ex = chat.prefix_examples(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(ex).collect()}
    assert got == expected(rows)
    for r in ex.collect():
        if r.trainable:
            assert r.formatted[: r.loss_start].endswith("assistant[INST]") and r.formatted[r.loss_end :] == "</s>"
        else:
            assert r.loss_start == r.loss_end
    # one example per reply, and one more for what follows the last
    n = {c: sum(1 for r in rows if r[0] == c and r[2] == "assistant") for c in {r[0] for r in rows}}
    trainable = {r["conv_id"]: r["count"] for r in ex.where("trainable").groupBy("conv_id").count().collect()}
    assert trainable == {c: k for c, k in n.items() if k}


def test_long_text_and_empty_table(spark):
    long = "ab</s>" * 50_000
    got = chat.digest(chat.prefix_examples(spark.createDataFrame([(1, 0, "assistant", long, "", 0)], SCHEMA))).first()
    assert (got.loss_chars, got.loss_sha256) == (len(long), hashlib.sha256(long.encode()).hexdigest())
    assert chat.digest(chat.prefix_examples(spark.createDataFrame([], SCHEMA))).count() == 0


@pytest.mark.parametrize("role", ["user", "tool\nx", "[INST]", "a<s>b"])
def test_any_role_is_read_back(spark, role):
    ex = chat.prefix_examples(spark.createDataFrame([(1, 0, role, "t", "", 0)], SCHEMA))
    assert ex.select(chat.read_turns(F.col("formatted")).alias("t")).first().t == [(role, "t")]
