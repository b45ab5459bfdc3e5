"""An interpolated bound between equal scores is that score, so that rows at it are in the tail."""

import numpy as np

from tickloom.operators import metrics
from tickloom.operators.ordered import quantiles


def test_bounds_between_equal_values_are_exact(spark):
    values = np.round(np.random.default_rng(7).normal(0, 0.01, 200), 9).tolist()
    rows = spark.createDataFrame([(g, v) for g, v in enumerate(values) for _ in range(2 + g % 17)], "g long, v double")
    got = quantiles(rows, ["g"], "v", {"low": (0.1, True), "high": (0.9, True)}).collect()
    assert len(got) == 200 and all(r["low"] == r["high"] == values[r["g"]] for r in got)


def test_tails_hold_rows_at_their_bounds(spark):
    values = np.round(np.random.default_rng(8).normal(0, 0.01, 100), 9).tolist()
    rows = [(f"s{g}", v, i % 3 == 0, 1.0 + i) for g, v in enumerate(values) for i in range(2 + g % 17)]
    got = {r["sym"]: r["tail_accuracy"] for r in metrics.tail_accuracy(spark.createDataFrame(rows, "sym string, score double, positive boolean, weight double"), ["sym"], 0.1).collect()}
    # every row is in both tails, and right in one of them
    assert len(got) == 100 and all(abs(x - 0.5) < 1e-12 for x in got.values())
