import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.llm import chat
from tickloom.llm.queries import op1_chat_formatting

HARD = "\\### Assistant: </turn> ok"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), sha(loss))
    return out


def read(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)]
    assert read(op1_chat_formatting(spark, sf)) == expected(rows)


@pytest.mark.parametrize("texts", [
    [HARD, "\\", "\\\\", "a\n</turn>\n", "\n</turn>", "</turn>", "#", "####", "### user :\n", "\n", "", "é😀\\n", "$1 \\1", " :\nx", "\n\n", "x" * 300_000],
])
def test_round_trip(spark, texts):
    rows = [(1, 0, t, t) for t in texts] + [(i, 1, "assistant", t) for i, t in enumerate(texts, 2)]
    made = chat.format_trees(chat.conversations_of(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")))
    got = made.select(F.col("tree"), chat.parsed(F.col("formatted")).alias("t"), chat.masked(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted").collect()
    for r in got:
        if r["tree"] == 1:
            assert sorted((x["role"], x["text"]) for x in r["t"]) == sorted((t, t) for t in texts)
            assert r["loss"] == ""
        else:
            assert [(x["role"], x["text"]) for x in r["t"]] == [("assistant", texts[r["tree"] - 2])]
            assert r["loss"] == texts[r["tree"] - 2]


def test_trees(spark):
    # 1 -> 2 -> 4 -> 6, 2 -> 5, 1 -> 3; 20 a root alone; 30 and 31 a ring; 40 answers what isn't there
    says = [(1, None, 0.0), (2, 1, 1.0), (3, 1, 2.5), (4, 2, 0.5), (5, 2, 3.0), (6, 4, 0.6), (20, None, None), (30, 31, 9.0), (31, 30, 9.0), (40, 99, 2.0)]
    rows = [("t", m, p, s, "user", f"m{m}") for m, p, s in says] + [(None, 1, None, 0.0, None, None), ("t", 6, 4, 0.6, "user", "m6")]
    messages = spark.createDataFrame(rows, "tree string, message bigint, parent bigint, score double, role string, text string")
    got = chat.branches(messages.dropDuplicates(["tree", "message"]), None).collect()
    paths = defaultdict(dict)
    for r in got:
        paths[r["tree"], r["rank"], r["leaf"], r["score"]][r["pos"]] = r["message"]
    assert {k: [v[i] for i in range(len(v))] for k, v in paths.items()} == {
        ("t", 1, 5, 4.0): [1, 2, 5], ("t", 2, 3, 2.5): [1, 3], ("t", 3, 6, 2.1): [1, 2, 4, 6], ("t", 4, 40, 2.0): [40], ("t", 5, 20, 0.0): [20], (None, 1, 1, 0.0): [1],
    }
    best = chat.format_trees(messages).where("tree = 't'").collect()
    assert [(r["leaf"], r["n_turns"]) for r in best] == [(5, 3)]
    assert "m1" in best[0]["formatted"] and "m4" not in best[0]["formatted"]


def test_deep_chain(spark):
    n = 700
    rows = spark.range(n).select(F.lit(1).alias("tree"), F.col("id").alias("message"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(1.0).alias("score"))
    got = {r["pos"]: r["message"] for r in chat.branches(rows).collect()}
    assert got == {i: i for i in range(n)}


def test_defined_cases(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, formatted string, tree string"
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 0, None, "x"), (None, None, "assistant", "y"), (None, 1, "assistant", None), (2, 5, "", "")]
    df = spark.createDataFrame([(*r, "f", "t") for r in rows], schema)
    made = chat.read_back(chat.format_trees(chat.conversations_of(df)))
    assert read(made) == expected(rows)
    assert chat.format_trees(chat.conversations_of(df.where("false"))).count() == 0
