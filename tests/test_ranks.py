"""Sums and quantiles in order, block halves and verdicts, against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import leakage, ordered, overfitting, quotes


def test_sums_before_and_quantiles_of_a_hot_key(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else None if i % 2 else "cold", float(v)) for i, v in enumerate(np.round(rng.normal(size=3000), 2))]
    frame = spark.createDataFrame(rows, "k string, v double")
    distinct = frame.groupBy("k", "v").agg(F.count("*").alias("n"))
    for r in ordered.sums_before(distinct, ["k"], "v", {"below": F.col("n")}).collect():
        assert r["below"] == sum(1 for k, v in rows if k == r["k"] and v < r["v"])
    wanted = {"q10": (0.1, True), "med": (0.5, True), "p75": (0.75, False)}
    for r in ordered.quantiles(frame, ["k"], "v", wanted).collect():
        mine = sorted(v for k, v in rows if k == r["k"])
        assert r["n"] == len(mine) and r["q10"] == pytest.approx(np.quantile(mine, 0.1)) and r["med"] == pytest.approx(np.quantile(mine, 0.5))
        assert r["p75"] == mine[int(np.floor((len(mine) - 1) * 0.75 + 0.5))]
    assert ordered.quantiles(frame.where("false"), ["k"], "v", wanted).count() == 0


@pytest.mark.parametrize("blocks", [2, 6])
def test_block_halves(spark, blocks):
    rng = np.random.default_rng(blocks)
    matrix = rng.normal(size=(5, blocks))
    frame = spark.createDataFrame([(t, b, float(matrix[t, b])) for t in range(5) for b in range(blocks)], "trial int, block int, metric double")
    low = []
    for inside in itertools.combinations(range(blocks), blocks // 2):
        outside = [b for b in range(blocks) if b not in inside]
        best = matrix[:, list(inside)].mean(axis=1).argmax()
        out = matrix[:, outside].mean(axis=1)
        low.append((out < out[best]).sum() + 1 <= 0.5 * 6)
    got = overfitting.pbo(frame, blocks).first()
    assert got["n_splits"] == len(low) and got["pbo"] == pytest.approx(np.mean(low))
    assert overfitting.pbo(frame, 3).first()["pbo"] is None and overfitting.pbo(frame.where("trial = 0"), blocks).first()["pbo"] is None


def test_many_blocks_are_sampled(spark):
    assert len(overfitting.halves(16)) == 12_870 and len(overfitting.halves(18, 500)) == 500
    frame = spark.createDataFrame([(t, b, float((t * 7 + b * 3) % 11)) for t in range(3) for b in range(18)], "trial int, block int, metric double")
    assert overfitting.pbo(frame, 18, most=300).first()["n_splits"] == 300


def test_permutations_keep_each_symbols_labels(spark):
    rows = [("ab"[i % 5 == 0], i, i % 3 - 1) for i in range(500)]
    frame = spark.createDataFrame(rows, "sym string, i int, label int").withColumn("decision_ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("i") * 60)).drop("i")
    for made in (overfitting.permutations(frame, 3), overfitting.permutations(frame, 3, block=7)):
        found = {}
        for r in made.orderBy("decision_ts").collect():
            found.setdefault(r["sym"], []).append(r["label"])
        assert sorted(found) == ["a#0", "a#1", "a#2", "b#0", "b#1", "b#2"]
        for name, labels in found.items():
            assert sorted(labels) == sorted(x for s, _, x in rows if s == name[0])
        assert found["a#0"] != found["a#1"] != [x for s, _, x in rows if s == "a"]
    assert leakage.shuffle_times(frame.withColumns({"entry_ts": F.col("decision_ts"), "exit_ts": F.col("decision_ts")}), 3).count() == 500


@pytest.mark.parametrize("probabilities, verdict", [([0.97, 0.98], "edge"), ([0.2, 0.24], "no_edge"), ([0.7, 0.71], "ambiguous"), ([0.2, 0.9], "unstable"), ([0.9, 0.96], "unstable"), ([None], None)])
def test_deflation_verdicts(spark, probabilities, verdict):
    frame = spark.createDataFrame([("s", p) for p in probabilities], "sym string, probability double")
    assert quotes.deflation_verdict(frame, ["sym"]).first()["verdict"] == verdict


@pytest.mark.parametrize("full, calendar, market, verdict", [(0.54, 0.52, 0.53, "base_rate"), (0.54, 0.51, 0.53, "conditional_edge"), (0.54, 0.51, 0.52, "ambiguous"), (None, 0.5, 0.5, None)])
def test_ablation_verdicts(spark, full, calendar, market, verdict):
    frame = spark.createDataFrame([(full, calendar, market)], "f double, c double, m double")
    r = quotes.ablations(frame, full="f", calendar="c", market="m").first()
    assert r["verdict"] == verdict
    if full:
        assert r["calendar_share"] == pytest.approx((calendar - 0.5) / (full - 0.5)) and r["market_share"] == pytest.approx((market - 0.5) / (full - 0.5))


def test_average_ranks(spark):
    frame = spark.createDataFrame([("a", v) for v in (3.0, 1.0, 3.0, 2.0, 3.0)], "k string, v double")
    assert sorted((r["v"], r["rank"]) for r in overfitting.average_rank(frame, ["k"], "v").collect()) == [(1.0, 1.0), (2.0, 2.0), (3.0, 4.0), (3.0, 4.0), (3.0, 4.0)]
