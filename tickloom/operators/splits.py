"""Purged, embargoed combinatorial cross-validation and sample-uniqueness weights, as relations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.ordered import prefix_sums, with_position
from tickloom.session import cut


def indexed(labels: DataFrame, order: str = "decision_ts") -> DataFrame:
    """Adds i, a label's place among its symbol's."""
    return with_position(labels, ["sym"], order, "i")


def with_groups(rows: DataFrame, n_groups: int) -> DataFrame:
    """Adds n and g: group g begins at floor(g * n / n_groups). (ntile would part them otherwise.)"""
    sizes = rows.groupBy("sym").agg((F.max("i") + 1).alias("n"))
    g = F.expr(f"((i + 1) * {n_groups} - 1) div n").cast("int")
    return rows.join(sizes, "sym").withColumn("g", g)


def split_table(spark, n_groups: int, k: int) -> DataFrame:
    """split, g, run: the test groups of each combination, adjacent ones in one run. C(n_groups, k) * k rows."""
    rows = []
    for split, groups in enumerate(combinations(range(n_groups), k)):
        run = -1
        for before, g in zip((None, *groups), groups):
            run += before is None or g != before + 1
            rows.append((split, g, run))
    return spark.createDataFrame(rows, "split int, g int, run int")


def cpcv(rows: DataFrame, n_groups: int, k: int, *, h_bars: int, embargo_pct: float = 0.01) -> DataFrame:
    """Each row of indexed labels once for every split in which it plays a role: adds split and role, train or test.

    A row is no training row if its [entry, exit] touches the span of a test run, or if it is one of the embargo's rows
    after a run; the embargo is h_bars or embargo_pct of the rows, if that is more.
    """
    spark = rows.sparkSession
    grouped = cut(with_groups(rows, n_groups))
    groups = grouped.groupBy("sym", "g").agg(F.min("entry_ts").alias("a"), F.max("exit_ts").alias("b"), F.max("i").alias("last"), F.first("n").alias("n"))
    # by symbol and split; as many rows as there are symbols times splits
    tests = groups.join(F.broadcast(split_table(spark, n_groups, k)), "g")
    runs = tests.groupBy("sym", "split", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.max("last").alias("last"), F.first("n").alias("n"))
    embargo = F.greatest(F.lit(h_bars), F.ceil(F.lit(embargo_pct) * F.col("n")))
    spans = runs.groupBy("sym", "split").agg(F.collect_list(F.struct("a", "b", "last", (F.col("last") + embargo).alias("until"))).alias("_runs"))
    held = tests.groupBy("sym", "split").agg(F.collect_set("g").alias("_tests"))
    plan = cut(spans.join(held, ["sym", "split"]))
    crossed = grouped.join(plan, "sym")
    purged = F.exists("_runs", lambda r: ((F.col("entry_ts") <= r["b"]) & (F.col("exit_ts") >= r["a"])) | ((F.col("i") > r["last"]) & (F.col("i") <= r["until"])))
    role = F.when(F.array_contains("_tests", F.col("g")), "test").when(~purged, "train")
    return crossed.withColumn("role", role).where("role is not null").drop("_runs", "_tests", "n", "g")


def inner_fold(train: DataFrame, frac: float) -> DataFrame:
    """Adds fold to training rows (sym, split, i, entry_ts, exit_ts): validation for the last round(frac * n) of them, at
    least one; inner for those before that don't touch the validation's span; null for those that do."""
    per = ["sym", "split"]
    train = cut(train)
    sizes = train.groupBy(*per).agg(F.count("*").alias("_m"))
    upto = prefix_sums(train, per, "i", {"_upto": F.lit(1)})
    last = F.greatest(F.lit(1), F.bround(F.lit(frac) * F.col("_m")))
    marked = upto.join(sizes, per).withColumn("_val", F.col("_m") - F.col("_upto") < last).drop("_m", "_upto")
    spans = marked.where("_val").groupBy(*per).agg(F.min("entry_ts").alias("_a"), F.max("exit_ts").alias("_b"))
    apart = (F.col("entry_ts") > F.col("_b")) | (F.col("exit_ts") < F.col("_a"))
    return marked.join(spans, per).withColumn("fold", F.when(F.col("_val"), "validation").when(apart, "inner")).drop("_val", "_a", "_b")


def uniqueness_weights(rows: DataFrame) -> DataFrame:
    """Adds weight to indexed labels: the mean, over the decision bars in [entry, exit], of one over the number of labels
    that cover the bar. Windows are clipped to the decision bars and cover one at least."""
    rows = cut(rows)
    ends = rows.select("sym", "i", F.col("entry_ts").alias("at"), F.lit(0).alias("kind")).unionByName(
        rows.select("sym", "i", F.col("exit_ts").alias("at"), F.lit(2).alias("kind"))
    )
    marks = rows.select("sym", "i", F.col("decision_ts").alias("at"), F.lit(1).alias("kind"))
    # entries sort before equal decision times, exits after: the decisions so far are searchsorted's answers
    located = _decisions_before(ends.unionByName(marks).withColumn("_t", F.expr("timestamp_micros(unix_micros(at) * 4 + kind)"))).where("kind <> 1")
    places = located.groupBy("sym", "i").agg(F.max(F.when(F.col("kind") == 0, F.col("below"))).alias("s"), F.max(F.when(F.col("kind") == 2, F.col("below"))).alias("e"))
    n = rows.groupBy("sym").agg(F.count("*").alias("_n"))
    clip = lambda c: F.greatest(F.lit(0), F.least(c, F.col("_n") - 1))
    windows = places.join(n, "sym").select("sym", "i", clip(F.col("s")).alias("s"), clip(F.col("e") - 1).alias("e"))
    windows = cut(windows.withColumn("e", F.greatest("e", "s")))
    steps = windows.select("sym", F.col("s").alias("i"), F.lit(1).alias("d")).unionByName(windows.select("sym", (F.col("e") + 1).alias("i"), F.lit(-1).alias("d")))
    change = steps.groupBy("sym", "i").agg(F.sum("d").alias("d"))
    bars = rows.select("sym", "i").join(change, ["sym", "i"], "left").withColumn("d", F.coalesce("d", F.lit(0)))
    covered = prefix_sums(bars, ["sym"], "i", {"c": F.col("d")})
    summed = prefix_sums(covered, ["sym"], "i", {"p": 1.0 / F.greatest(F.col("c"), F.lit(1))})
    summed = cut(summed.select("sym", "i", "p"))
    upto = windows.join(summed.select("sym", F.col("i").alias("e"), F.col("p").alias("_pe")), ["sym", "e"])
    before = summed.select("sym", (F.col("i") + 1).alias("s"), F.col("p").alias("_ps"))
    weighed = upto.join(before, ["sym", "s"], "left")
    weight = (F.col("_pe") - F.coalesce("_ps", F.lit(0.0))) / (F.col("e") - F.col("s") + 1)
    return rows.join(weighed.select("sym", "i", weight.alias("weight")), ["sym", "i"])


def _decisions_before(events: DataFrame) -> DataFrame:
    """Adds below: the marks (kind 1) at or before each event in order of _t; ties are of one kind. By a window within a date,
    and the dates' counts."""
    dated = cut(events.withColumn("_d", F.to_date("at")))
    is_mark = (F.col("kind") == 1).cast("bigint")
    counts = dated.groupBy("sym", "_d").agg(F.sum(is_mark).alias("_k"))
    earlier = F.sum("_k").over(Window.partitionBy("sym").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("sym", "_d", F.coalesce(earlier, F.lit(0)).alias("_off"))
    within = F.sum(is_mark).over(Window.partitionBy("sym", "_d").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0))
    return dated.withColumn("_w", within).join(offsets, ["sym", "_d"]).withColumn("below", F.col("_off") + F.col("_w")).drop("_w", "_off", "_d")
