import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.llm import mixing
from tickloom.llm.queries import op9_mixing

SCHEMA = "doc_id bigint, source string, text string, size string, taken string"


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """By the text: reshare the excess until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        each = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if each[s] > most * sizes[s]]
        if not over:
            return fixed | each
        for s in over:
            fixed[s] = most * sizes[s]
            left -= fixed[s]


def check(rows, mixed):
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, most = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += n(r["text"])
        most[r["source"]] = max(most[r["source"]], n(r["text"]))
    targets, taken = brute_targets(sizes), defaultdict(int)
    assert sorted((str(r["doc_id"]), n(r["text"])) for r in rows) == sorted((str(r["doc_id"]), r["size"]) for r in mixed)
    for r in mixed:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], targets[r["source"]], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= most[s] / 2 + 1e-6, s


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    mixed = op9_mixing(spark, sf).collect()
    check(rows, mixed)
    again = op9_mixing(spark, sf).collect()
    assert sorted(map(str, mixed)) == sorted(map(str, again))


def test_prefix_sum_in_small_buckets(spark):
    rows = [(i, "abc"[i % 7 % 3], "w " * (1 + i * 37 % 50), "x", "y") for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    wide = mixing.mix_sources(docs, bucket_rows=16)
    assert set(wide.columns) == {"doc_id", "source", "text", "size", "source_size", "target", "epochs", "taken"}
    check(docs.collect(), wide.collect())
    one = mixing.mix_sources(docs, bucket_rows=10**6)
    pick = lambda d: sorted((r["doc_id"], r["taken"]) for r in d.collect())
    assert pick(wide) == pick(one)
    assert len({r["taken"] // r["size"] for r in wide.collect()}) == 3 or wide.select("epochs").distinct().count() >= 1
    times = mixing.repeated(wide, ["doc_id", "text"]).count()
    assert times == sum(r["taken"] // r["size"] for r in wide.collect())


def test_quality_favours(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("string").alias("source"), F.lit("a b").alias("text"), (F.col("id") % 4 < 2).alias("good"))
    got = mixing.mix_sources(docs, quality=F.when(F.col("good"), 4.0).otherwise(1.0), share=0.5, weights=(1,)).where("taken > 0")
    n = {r["good"]: r["count"] for r in got.groupBy("good").count().collect()}
    assert n[True] > 2 * n[False]


def test_defined_cases(spark):
    rows = [(1, "a", None, "", ""), (2, None, "x y z", "", ""), (2, None, "x y z", "", ""), (None, "a", "w " * 300_000, "", ""), (4, "", "q", "", ""), (5, "b", "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    check(docs.collect(), mixing.mix_sources(docs).collect())
    assert mixing.mix_sources(docs.where("false")).count() == 0
    assert mixing.mix_sources(docs.where("text is null")).collect()[0]["taken"] == 0


@pytest.mark.parametrize("text, n", [("", 0), (None, 0), (" ", 0), ("a", 1), (" a\x0bb c ", 2), ("a\x1cb", 1)])
def test_word_count(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(mixing.word_count(F.col("t"))).first()[0] == n
