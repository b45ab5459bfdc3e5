"""Hand-computed cases, perturbations and brute force for the bar operators."""

import itertools
import math
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import columns, identity
from tickloom.operators import bars as B
from tickloom.operators import features as X
from tickloom.operators import leakage, metrics, ordered, overfitting, quotes, splits
from tickloom.operators import labels as L
from tickloom.operators.calendar import calendar, early_closes, holidays, tag_sessions
from tickloom.operators.study import BoostedTrees, CorrelationSign, Study, TrialSpec

BAR = "sym string, ts timestamp, open double, high double, low double, close double, volume double, is_traded boolean, session string"


def at(text):
    return datetime.fromisoformat(text)


def bars_of(spark, closes, start="2024-01-03T15:00", step=1, traded=None, highs=None, lows=None, opens=None, sym="s"):
    t0 = at(start)
    rows = []
    for i, c in enumerate(closes):
        there = traded is None or traded[i]
        rows.append((sym, t0 + timedelta(minutes=i * step), *(float(x) if there else None for x in ((opens or closes)[i], (highs or closes)[i], (lows or closes)[i], c)), 1.0 if there else None, there, "RTH"))
    return spark.createDataFrame(rows, BAR)


def test_holidays():
    assert holidays(2024) == {date(2024, m, d) for m, d in ((1, 1), (1, 15), (2, 19), (3, 29), (5, 27), (6, 19), (7, 4), (9, 2), (11, 28), (12, 25))}
    assert date(2021, 12, 31) not in holidays(2021) and date(2022, 12, 26) in holidays(2022) and date(2021, 12, 24) in holidays(2021)
    assert early_closes(2024) == {date(2024, 7, 3), date(2024, 11, 29), date(2024, 12, 24)}


def test_session_tags(spark):
    stamps = ["2024-01-03T14:00", "2024-01-03T15:00", "2024-01-03T21:30", "2024-01-03T02:00", "2024-01-06T15:00", "2024-07-03T17:30"]
    rows = spark.createDataFrame([(at(s),) for s in stamps], "ts timestamp")
    got = {r["ts"]: r["session"] for r in tag_sessions(rows, calendar(spark, date(2024, 1, 1), date(2024, 12, 31))).collect()}
    assert [got[at(s)] for s in stamps] == ["PRE", "RTH", "POST", "OVERNIGHT", "OVERNIGHT", "POST"]


def test_grid_is_complete_and_never_filled(spark):
    bars = spark.createDataFrame([("s", at("2024-01-03T15:00"), 1.0), ("s", at("2024-01-03T15:09"), 2.0)], "sym string, ts timestamp, close double")
    grid = B.session_grid(bars, calendar(spark, date(2024, 1, 2), date(2024, 1, 4)), ("RTH",))
    rows = B.attach(grid, bars).orderBy("ts").collect()
    assert len(rows) == 10 and [r["is_traded"] for r in rows] == [True] + [False] * 8 + [True]
    assert all(r["close"] is None for r in rows[1:-1])


@pytest.mark.parametrize("gaps", [4, 5, 9])
def test_halts(spark, gaps, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK", 3)
    frame = bars_of(spark, [1.0] * (gaps + 2), traded=[True] + [False] * gaps + [True])
    rows = B.flag_quality(frame).orderBy("ts").collect()
    assert [r["is_gap"] for r in rows] == [False] + [True] * gaps + [False]
    assert [r["is_halt"] for r in rows] == [False] + [gaps >= 5] * gaps + [False]


def test_price_anomalies(spark):
    frame = bars_of(spark, [1.0, 1.0, 2.0, 2.0, 0.0, 1.0], highs=[1, 0.4, 2, 2, 1, 1], lows=[1, 0.5, 2, 2, 0, 1]).withColumn("volume", F.when(F.minute("ts") == 0, 0.0).otherwise(5.0))
    rows = B.flag_quality(frame).orderBy("ts").collect()
    assert [r["is_price_anomaly"] for r in rows] == [False, True, True, False, True, True]
    assert [r["is_zero_volume"] for r in rows] == [True] + [False] * 5


def snapshots(spark, rows):
    values = ", ".join(f"{c} double" for c in ("open", "high", "low", "close", "volume"))
    return spark.createDataFrame([("s", "TRADES", at(t), 1.0, 1.0, 1.0, c, 1.0, 1, 1.0, i, at(f)) for t, c, i, f in rows], f"sym string, series string, ts timestamp, {values}, bar_count bigint, wap double, snapshot_id string, fetch_ts timestamp")


def test_conflicts_and_latest_fetch(spark):
    rows = snapshots(spark, [("2024-01-03T15:00", 1.5, "a", "2024-01-10T16:00"), ("2024-01-03T15:00", 1.9, "b", "2024-01-10T17:00"), ("2024-01-10T15:00", 1.0, "a", "2024-01-10T16:00"), ("2024-01-10T15:00", None, "b", "2024-01-10T17:00")])
    assert [r["close"] for r in B.find_conflicts(rows).orderBy("ts").collect()] == [2, 2]
    with pytest.raises(B.SnapshotConflict, match="1 settled"):
        B.assert_no_conflicts(rows, at("2024-01-08T17:00"))
    B.assert_no_conflicts(rows.where("day(ts) = 10"), at("2024-01-08T17:00"))
    assert {r["close"] for r in B.latest_fetch_wins(rows).collect()} == {1.9, None}


def test_lag_and_first_bar(spark):
    got = [r["ret_1b"] for r in X.build_features(bars_of(spark, [10, 20, 40, 80]), [X.LaggedReturns((1,))]).orderBy("ts").collect()]
    assert got[:2] == [None, None] and math.isclose(got[2], math.log(2)) and math.isclose(got[3], math.log(2))


def test_previous_bar_is_the_previous_traded_one(spark):
    frame = bars_of(spark, [10, 99, 20, 40], traded=[True, False, True, True])
    got = [r["ret_1b"] for r in X.build_features(frame, [X.LaggedReturns((1,))]).orderBy("ts").collect()]
    assert got[:2] == [None, None] and math.isclose(got[2], math.log(2))


def test_the_future_changes_nothing(spark):
    rng = np.random.default_rng(0)
    closes = list(100 * np.exp(np.cumsum(rng.normal(0, 0.01, 90))))
    one = X.build_features(bars_of(spark, closes, step=30)).drop("is_traded").orderBy("ts").collect()
    other = X.build_features(bars_of(spark, closes[:-1] + [1e9], step=30)).drop("is_traded").orderBy("ts").collect()
    assert one == other


def test_sigma_of_a_constant_return(spark):
    r = 0.01
    closes = [100 * math.exp(r * i) for i in range(20)]
    both = bars_of(spark, closes, "2024-01-03T15:00").unionByName(bars_of(spark, closes, "2024-01-04T15:00"))
    rows = X.with_sigma(both, bucket_minutes=30).orderBy("ts").collect()
    assert all(x["sigma"] is None for x in rows[:20]) and all(math.isclose(x["sigma"], r, rel_tol=1e-9) for x in rows[20:])


def test_ewma_against_its_definition(spark):
    values = [1.0, 4.0, 2.0, 8.0]
    keep = 1 - 2 / 21
    want = sum(v * keep ** (3 - i) for i, v in enumerate(values)) / sum(keep ** (3 - i) for i in range(4))
    assert math.isclose(spark.range(1).select(columns.ewma(F.array(*map(F.lit, values)), 20)).first()[0], want)


def test_asof_context_on_the_union_timeline(spark):
    base = at("2024-01-03T15:00")
    target = spark.createDataFrame([("t", base + timedelta(minutes=m), 1.0, True, "RTH") for m in (0, 1, 4)], "sym string, ts timestamp, close double, is_traded boolean, session string")
    context = spark.createDataFrame([("c", base + timedelta(minutes=m), 100.0 + m, True) for m in range(5)], "sym string, ts timestamp, close double, is_traded boolean")
    got = X.build_features(target, [X.ContextReturn("c")], context={"c": context}).orderBy("ts").collect()
    assert [r["ctx_close"] for r in got] == [None, 100.0, 101.0]


def test_asof_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = at("2024-01-03T00:00")
    left = [(str(s), base + timedelta(minutes=int(m))) for s in range(2) for m in sorted(rng.choice(9000, 60, replace=False))]
    right = [(str(s), base + timedelta(minutes=int(m)), None if m % 5 == 0 else float(m)) for s in range(2) for m in sorted(rng.choice(9000, 25, replace=False))]
    got = ordered.asof_backward(spark.createDataFrame(left, "sym string, ts timestamp"), spark.createDataFrame(right, "sym string, ts timestamp, v double"), "c", by=["sym"]).collect()
    for r in got:
        want = max((x for x in right if x[0] == r["sym"] and x[1] <= r["ts"]), key=lambda x: x[1], default=None)
        assert (r["c"] and (r["c"]["ts"], r["c"]["v"])) == (want and want[1:])


def walk(bars, k, h):
    """First touch, one bar after the other."""
    out = []
    for i in range(len(bars) - 1):
        sigma, entry = bars[i]["sigma"], bars[i + 1]["open"]
        if not sigma or sigma <= 0 or entry <= 0:
            continue
        up, down = entry * (1 + k * sigma), entry * (1 - k * sigma)
        for j in range(i + 1, min(i + 2 + h, len(bars))):
            tp, sl = bars[j]["high"] >= up, bars[j]["low"] <= down
            if tp or sl:
                out.append((bars[i]["ts"], bars[j]["ts"], -1 if sl else 1, "both" if tp and sl else "tp" if tp else "sl", round((down if sl else up) / entry - 1, 12)))
                break
        else:
            out.append((bars[i]["ts"], bars[j]["ts"], 0, "vertical", round(bars[j]["close"] / entry - 1, 12)))
    return out


@pytest.mark.parametrize("chunk", [4, 8192])
def test_triple_barrier_against_a_walk(spark, chunk):
    rng = np.random.default_rng(8)
    closes = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 150)))
    wide = rng.random(150) * 2
    frame = bars_of(spark, list(closes), highs=list(closes + wide), lows=list(closes - wide), step=60).withColumn("sigma", F.when(F.hour("ts") != 3, 0.01))
    got = L.TripleBarrier(2.0, 6, chunk).generate(frame).orderBy("decision_ts").collect()
    want = walk(frame.orderBy("ts").collect(), 2.0, 6)
    assert [(r["decision_ts"], r["exit_ts"], r["label"], r["touched"], round(r["gross_return"], 12)) for r in got] == want
    assert {w[3] for w in want} == {"tp", "sl", "both", "vertical"}


def test_labels_of_too_few_bars_and_bad_methods(spark):
    assert L.TripleBarrier().generate(bars_of(spark, [1.0]).withColumn("sigma", F.lit(0.1))).count() == 0
    with pytest.raises(ValueError):
        L.label_generator("fixed_horizon_direction")


def lifespans(spark, rows):
    base = at("2024-01-03T00:00")
    t = lambda m: base + timedelta(minutes=m)
    return spark.createDataFrame([("s", t(d), t(a), t(b)) for d, a, b in rows], "sym string, decision_ts timestamp, entry_ts timestamp, exit_ts timestamp")


def test_purge_boundary(spark):
    rows = splits.indexed(lifespans(spark, [(1, 9, 9), (2, 9, 10), (3, 10, 11), (4, 10, 20), (5, 15, 20)]))
    got = splits.cpcv(rows, 5, 2, h_bars=0, embargo_pct=0.0).where("role = 'train'")
    # groups of one row each; the split of the last two
    assert [r["i"] for r in got.where("split = 9").collect()] == [0]


def brute_cpcv(entry, exit_, n_groups, k, embargo):
    n = len(entry)
    bounds = [g * n // n_groups for g in range(n_groups + 1)]
    out = set()
    for split, groups in enumerate(itertools.combinations(range(n_groups), k)):
        test = {i for g in groups for i in range(bounds[g], bounds[g + 1])}
        train = set(range(n)) - test
        runs = []
        for g in groups:
            if runs and runs[-1][1] == bounds[g]:
                runs[-1][1] = bounds[g + 1]
            else:
                runs.append([bounds[g], bounds[g + 1]])
        for a, b in runs:
            low, high = min(entry[a:b]), max(exit_[a:b])
            train -= {i for i in range(n) if entry[i] <= high and exit_[i] >= low} | set(range(b, b + embargo))
        out |= {(split, i, "test") for i in test} | {(split, i, "train") for i in train}
    return out


@pytest.mark.parametrize("n, groups, k, h", [(40, 4, 2, 1), (53, 6, 2, 3), (31, 5, 1, 0)])
def test_cpcv_against_brute_force(spark, n, groups, k, h):
    rng = np.random.default_rng(n)
    entry = [i + 1 for i in range(n)]
    exit_ = [e + int(x) for e, x in zip(entry, rng.integers(0, 5, n))]
    rows = splits.indexed(lifespans(spark, zip(range(n), entry, exit_)))
    got = {(r["split"], r["i"], r["role"]) for r in splits.cpcv(rows, groups, k, h_bars=h).collect()}
    assert got == brute_cpcv(entry, exit_, groups, k, max(h, math.ceil(0.01 * n)))
    assert len({g[0] for g in got}) == math.comb(groups, k)


def brute_weights(decision, entry, exit_):
    n = len(decision)
    spans = []
    for a, b in zip(entry, exit_):
        s = min(max(int(np.searchsorted(decision, a, "left")), 0), n - 1)
        e = min(max(int(np.searchsorted(decision, b, "right")) - 1, 0), n - 1)
        spans.append((s, max(s, e)))
    c = [max(1, sum(s <= i <= e for s, e in spans)) for i in range(n)]
    return [sum(1 / c[i] for i in range(s, e + 1)) / (e - s + 1) for s, e in spans]


def test_weights_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ordered.prefix_sums, "__defaults__", (7,))
    rng = np.random.default_rng(2)
    decision = sorted(rng.choice(3000, 120, replace=False).tolist())
    entry = [d + int(x) for d, x in zip(decision, rng.integers(0, 40, 120))]
    exit_ = [e + int(x) for e, x in zip(entry, rng.integers(0, 200, 120))]
    got = splits.uniqueness_weights(splits.indexed(lifespans(spark, zip(decision, entry, exit_)))).orderBy("i").collect()
    assert np.allclose([r["weight"] for r in got], brute_weights(decision, entry, exit_))


def test_inner_fold(spark):
    rows = splits.indexed(lifespans(spark, [(i, i + 1, i + 3) for i in range(20)])).withColumn("split", F.lit(0))
    got = {r["i"]: r["fold"] for r in splits.inner_fold(rows, 0.125).collect()}  # round(2.5) is 2
    assert sorted(i for i, f in got.items() if f == "validation") == [18, 19] and sorted(i for i, f in got.items() if f is None) == [16, 17]


def scored(spark, positive, score, weight=None, bucket=None):
    rows = [("s", p == "T", float(x), float(w), b) for p, x, w, b in zip(positive, score, weight or [1] * len(score), bucket or [0] * len(score))]
    return spark.createDataFrame(rows, "sym string, positive boolean, score double, weight double, bucket int")


def value(df):
    return df.drop("sym").first()[0]


def test_auc_cases(spark):
    assert value(metrics.auc(scored(spark, "TTFF", [0.9, 0.8, 0.1, 0.2]), ["sym"])) == 1.0
    assert value(metrics.auc(scored(spark, "TTT", [1, 2, 3]), ["sym"])) is None
    rows = scored(spark, "TTFF", [0.9, 0.1, 0.2, 0.8], [1, 5, 5, 1])
    assert value(metrics.auc(rows, ["sym"])) == 0.5 and value(metrics.weighted_auc(rows, ["sym"])) != 0.5
    rows = scored(spark, "TTFTFF", [1, 1, 1, 0, 0, 0], bucket=[1, 1, 1, 0, 0, 0])
    assert value(metrics.auc(rows, ["sym"])) > 0.6 and value(metrics.conditional_auc(rows, ["sym"], "bucket")) == 0.5


def test_metrics_against_brute_force(spark):
    rng = np.random.default_rng(5)
    p, x, w, b = rng.random(150) < 0.4, rng.integers(0, 12, 150) / 3, rng.random(150) + 0.1, rng.integers(0, 4, 150)
    rows = scored(spark, ["T" if v else "F" for v in p], x, list(w), [int(v) for v in b])

    def parts(m):
        i, j = np.nonzero(p & m)[0], np.nonzero(~p & m)[0]
        won = ((x[i][:, None] > x[j][None, :]) + 0.5 * (x[i][:, None] == x[j][None, :])) * w[i][:, None] * w[j][None, :]
        return won.sum(), w[i].sum() * w[j].sum()

    num, den = parts(np.ones(150, bool))
    assert math.isclose(value(metrics.weighted_auc(rows, ["sym"])), num / den)
    each = [parts(b == k) for k in range(4)]
    assert math.isclose(value(metrics.conditional_auc(rows, ["sym"], "bucket")), sum(e[0] for e in each) / sum(e[1] for e in each))
    lo, hi = np.quantile(x, 0.1), np.quantile(x, 0.9)
    top, bottom = x >= hi, x <= lo
    assert math.isclose(value(metrics.tail_accuracy(rows, ["sym"], 0.1)), ((w[top] * p[top]).sum() + (w[bottom] * ~p[bottom]).sum()) / (w[top].sum() + w[bottom].sum()))
    assert math.isclose(value(metrics.balanced_accuracy(rows, ["sym"], 1.0)), ((x[p] > 1).mean() + (x[~p] <= 1).mean()) / 2)


def test_complement_turns_auc_over(spark):
    rng = np.random.default_rng(9)
    p, x = rng.random(80) < 0.5, rng.random(80)
    a = value(metrics.auc(scored(spark, ["T" if v else "F" for v in p], x), ["sym"]))
    b = value(metrics.auc(scored(spark, ["F" if v else "T" for v in p], x), ["sym"]))
    assert math.isclose(a + b, 1.0)


def study_frame(spark, n=240, rho=0.0, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.choice([-1, 1], n)
    rows = []
    for i in range(n):
        t = at("2024-01-03T00:00") + timedelta(minutes=10 * i)
        rows.append(("s", t, t + timedelta(minutes=1), t + timedelta(minutes=6), int(y[i]), float(rng.normal()), float(rho * y[i] + rng.normal() * (1 - rho))))
    return spark.createDataFrame(rows, "sym string, decision_ts timestamp, entry_ts timestamp, exit_ts timestamp, label bigint, noise double, signal double")


def test_canaries(spark):
    study = Study(4, 2)
    leak = study.run(study_frame(spark, rho=1.0), CorrelationSign(), ["noise", "signal"], 1).first()
    assert leak["auc"] > 0.99 and leak["n_paths"] == 6
    weak = study.run(study_frame(spark, rho=0.3), CorrelationSign(), ["noise", "signal"], 1).first()
    none = study.run(study_frame(spark), CorrelationSign(), ["noise", "signal"], 1).first()
    assert leak["auc"] > weak["auc"] > none["auc"] - 0.05 and abs(none["auc"] - 0.5) < 0.15
    with pytest.raises(leakage.LeakageError):
        study.run(study_frame(spark), CorrelationSign(), ["gross_return"], 1)


def test_boosted_trees_learn(spark):
    got = Study(2, 1, inner_frac=0.2).run(study_frame(spark, rho=0.5), BoostedTrees(rounds=5, depth=2), ["noise", "signal"], 1).first()
    assert got["auc"] > 0.6 and got["balanced_accuracy"] > 0.55


def test_shuffles(spark):
    rows = study_frame(spark, 103)
    before = [r["label"] for r in rows.orderBy("decision_ts").collect()]
    after = [r["label"] for r in leakage.shuffle_labels(rows, 1).orderBy("decision_ts").collect()]
    assert sorted(after) == sorted(before) and after != before
    blocks = [r["label"] for r in leakage.shuffle_label_blocks(rows, 1, 10).orderBy("decision_ts").collect()]
    assert blocks[100:] == before[100:] and blocks != before
    assert sorted(tuple(blocks[i : i + 10]) for i in range(0, 100, 10)) == sorted(tuple(before[i : i + 10]) for i in range(0, 100, 10))
    times = leakage.shuffle_times(rows, 1)
    assert times.count() == 103 and times.where("entry_ts - decision_ts <> interval 1 minute").count() == 0
    assert sorted(r["noise"] for r in times.collect()) == sorted(r["noise"] for r in rows.collect())


def brute_pbo(m):
    n, s = m.shape
    below = []
    for half in itertools.combinations(range(s), s // 2):
        inside = np.isin(np.arange(s), half)
        out = m[:, ~inside].mean(axis=1)
        best = int(np.argmax(m[:, inside].mean(axis=1)))
        rank = (out < out[best]).sum() + ((out == out[best]).sum() + 1) / 2
        below.append(rank / (n + 1) <= 0.5)
    return float(np.mean(below))


def test_pbo(spark):
    rng = np.random.default_rng(6)
    for shape in ((5, 4), (3, 6)):
        m = rng.integers(0, 6, shape).astype(float)
        long = spark.createDataFrame([(t, b, float(m[t, b])) for t in range(shape[0]) for b in range(shape[1])], "trial int, block int, metric double")
        assert math.isclose(overfitting.pbo(long, shape[1]).first()["pbo"], brute_pbo(m))
    one = spark.createDataFrame([(0, b, 1.0) for b in range(4)], "trial int, block int, metric double")
    assert overfitting.pbo(one, 4).first()["pbo"] is None and overfitting.pbo(one.union(one.withColumn("trial", F.lit(1))), 3).first()["pbo"] is None
    assert len(overfitting.halves(24, 50)) == 50


def test_deflation(spark):
    null = spark.createDataFrame([(float(v),) for v in np.linspace(0.40, 0.60, 1001)], "auc double")
    p = lambda o, k, n=null: overfitting.deflated_probability(n, F.lit(o), k).first()[0]
    assert p(0.60, 50) > 0.9 and p(0.50, 20) < 0.05 and p(0.5, 3, null.where("false")) is None
    nulls = overfitting.permutation_null(Study(3, 1), study_frame(spark, 90), CorrelationSign(), ["noise"], 1, 2)
    assert nulls.count() == 2


def test_identity(spark):
    parts = dict(bar="b", feature="f", label="l", cost="c", git="g")
    assert identity.dataset_id(raw=["a", "b", "c"], **parts) == identity.dataset_id(raw=["c", "a", "b"], **parts)
    for k in parts:
        assert identity.dataset_id(raw=["a"], **parts) != identity.dataset_id(raw=["a"], **(parts | {k: "other"}))
    raw = F.array(F.lit("c"), F.lit("a"))
    got = spark.range(1).select(identity.dataset_id_column(raw, *map(F.lit, "bflcg"))).first()[0]
    assert got == identity.dataset_id(raw=["a", "c"], **parts)
    spec = TrialSpec("d", "m", {"depth": 3}, "f1", "l1")
    assert spec.hash(["x", "y"]) == spec.hash(["y", "x"]) != spec.hash(["x"])


def test_spreads(spark):
    frame = spark.createDataFrame([("s", at("2024-01-03T15:00"), "RTH", 100.0, 100.2, True), ("s", at("2024-01-03T15:01"), "RTH", 100.2, 100.0, True), ("s", at("2024-01-03T15:02"), "RTH", None, None, False)], "sym string, ts timestamp, session string, open double, close double, is_traded boolean")
    rows = quotes.with_spread(frame).orderBy("ts").collect()
    assert math.isclose(rows[0]["spread_bps"], 0.2 / 100.1 * 1e4) and rows[2]["spread"] is None
    assert quotes.spread_by_session(frame).collect()[0]["n"] == 1
    assert quotes.spread_by_session(frame, at("2024-01-03T15:01")).count() == 0
    assert quotes.session_counts(frame).collect()[0]["n"] == 2
    assert "Spreads by session since 2024-01-01" in quotes.render_evidence("s", frame, frame, at("2024-01-01T00:00"))
    assert math.isclose(spark.range(1).select(quotes.breakeven_accuracy(F.lit(6.15), F.lit(20.0))).first()[0], 0.5 * (1 + 6.15 / 20))


def test_nearest_quantiles(spark):
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 6])], "i int, v double").agg(F.sort_array(F.collect_list("v")).alias("a"))
    assert [rows.select(columns.nearest_quantile(F.col("a"), q)).first()[0] for q in (0, 0.25, 0.5, 1)] == [1, 2, 4, 6]


def test_touch_codes_are_strict(spark):
    with pytest.raises(Exception, match="unknown touch code"):
        spark.range(1).select(columns.touched_name(F.lit(7))).collect()


def test_partitions_change_nothing(spark, sf):
    from tickloom.plans.queries import QUERIES

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = []
        for n in ("1", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append(sorted(map(str, QUERIES["research_dataset"](spark, sf).collect())))
        assert out[0] == out[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
