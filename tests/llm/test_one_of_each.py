"""Near-dedup keeps one of each, and the texts that stay don't move for it."""

import random

import pytest

from tickloom.llm import simhash

SCHEMA = "doc_id bigint, text string, root string, _kept string"


def shuffled_bytes(spark):
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def rows_of(n, words):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=8))
    texts = [" ".join(word() for _ in range(words)) for _ in range(n)]
    # every eighth once more under a later id, one without an id, and null texts
    again = [(1000 + i, texts[i]) for i in range(0, n, 8)]
    return [*enumerate(texts), *again, (None, texts[1]), (2000, None), (2001, None), (None, None)]


@pytest.mark.parametrize("filter_words", [None, 1])
def test_one_of_each(spark, monkeypatch, filter_words):
    if filter_words:  # all of its bits are set: every text may have to go
        monkeypatch.setattr(simhash, "FILTER_WORDS", filter_words)
    rows = rows_of(64, 40)
    least = {}
    for i, t in rows:
        least[t] = min(least.get(t, (True, 0)), (i is None, i or 0))
    docs = spark.createDataFrame([(i, t, "r", "k") for i, t in rows], SCHEMA)
    got = simhash.one_of_each(docs).collect()
    assert sorted((r["text"] or "", r["doc_id"]) for r in got) == sorted((t or "", i) for t, (_, i) in least.items())
    assert all(r["root"] == "r" and r["_kept"] == "k" for r in got)


def test_texts_that_stay_do_not_move(spark, tmp_path):
    rows = rows_of(256, 1500)
    spark.createDataFrame([(i, t, "r", "k") for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    before, setting = shuffled_bytes(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len(simhash.one_of_each(docs).collect()) == 257
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", setting)
    texts = sum(len(t or "") for _, t in rows)
    assert shuffled_bytes(spark) - before < texts / 2
