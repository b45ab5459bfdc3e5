"""Mixing with heavy-tailed qualities, rows alike and columns of any name, against brute force."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.llm import mixing

from .test_mixing import brute_targets, check


def totals(mixed):
    taken, target, most = defaultdict(int), {}, defaultdict(int)
    for r in mixed.collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]], most[r["source"]] = r["target"], max(most[r["source"]], r["size"])
        assert r["taken"] <= 2 * r["size"]
    return taken, target, most


@pytest.mark.parametrize("quality", ["exp(2 * randn(1))", "if(id % 2 = 0, 0.0, 1.0)", "if(id % 3 = 0, 1e12, 1e-30)", "cast(null as double)"])
def test_qualities_of_any_spread(spark, monkeypatch, quality):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"),
        (F.col("id") * 7919 % 61).alias("words"), F.expr(quality).alias("rated"),
    )
    ordered = []
    rounds = mixing.cut
    monkeypatch.setattr(mixing, "cut", lambda df: ordered.append(df) or rounds(df))
    made = mixing.mix_sources(docs, quality=F.col("rated"), size=F.col("words"), bucket_rows=64, carry=False)
    ends = [d for d in ordered if d.columns[-3:] == ["hi", "below", "n"]]
    assert (ends[-1].agg(F.max(F.when(F.col("lo") < F.col("hi"), F.col("n")))).first()[0] or 0) <= 64
    taken, target, most = totals(made)
    for s, t in target.items():
        assert abs(taken[s] - t) <= most[s] / 2 + 1e-6
    # the sample is that of the smallest keys
    plain = mixing.mix_sources(docs, quality=F.col("rated"), size=F.col("words"), bucket_rows=10**9, carry=False)
    pick = lambda d: sorted((r["doc_id"], r["taken"]) for r in d.collect())
    assert pick(made) == pick(plain)


@pytest.mark.parametrize("carry", [True, False])
def test_rows_alike(spark, carry):
    """Most rows of a source have no id, or the same one."""
    rows = [(None if i % 4 else i, "a" if i % 3 else "b", "w " * 10, 10, i) for i in range(3000)] + [(7, "c", "x y", 2, i) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, n int, other int").repartition(5)
    made = mixing.mix_sources(docs, weights=(1, 3), share=0.7, most=1, bucket_rows=16, carry=carry)
    taken, target, most = totals(made)
    assert len(target) == 3 and made.count() == 3900
    for s, t in target.items():
        assert abs(taken[s] - t) <= most[s] / 2 + 1e-6


def test_columns_of_any_name(spark):
    clash = {"_key": "k", "_src": "s", "_null": "n", "_quality": "q", "_copy": "c", "_mix_key": "m", "_part": "p", "lo": "l", "bar": "b", "n": "x", "left": "y", "SIZE": "z"}
    rows = [(i, "ab"[i % 2], "w " * (i % 5), *clash.values()) for i in range(60)]
    docs = spark.createDataFrame(rows, ["doc_id", "source", "text", *clash])
    made = mixing.mix_sources(docs)
    kept = [c for c in clash if c != "SIZE"]
    assert made.columns == ["doc_id", "source", "text", *kept, "size", "source_size", "target", "epochs", "taken"]
    assert {tuple(r[c] for c in kept) for r in made.collect()} == {tuple(clash[c] for c in kept)}
    check(docs.collect(), made.collect())
    assert mixing.repeated(made, made.columns).select("_copy").distinct().collect()[0][0] == "c"


def test_many_sources(spark):
    sizes = {f"s{i:03d}" if i else None: (i * i * 31) % 997 * 10 ** (i % 4) for i in range(300)}
    frame = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size bigint, n_docs bigint")
    for share in (0.1, 1.5, 1.99, 2.0, 3.0):
        want = brute_targets(sizes, share=share)
        for r in mixing.source_targets(frame, share=share).collect():
            assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
