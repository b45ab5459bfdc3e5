"""Guards against leakage, and the shuffles that show it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.splits import indexed
from tickloom.session import cut

OUTCOMES = frozenset({"label", "touched", "gross_return", "entry_ts", "entry_price", "exit_ts", "exit_price", "sigma", "weight"})
TIMES = ("decision_ts", "entry_ts", "exit_ts")
#: Digits of a hash that part a symbol's rows into blocks: 4096 of them.
HASH_DIGITS = 3


class LeakageError(ValueError):
    """A feature is an outcome."""


def assert_features_are_not_outcomes(features: Iterable[str], outcomes: Iterable[str] = OUTCOMES) -> None:
    both = sorted(set(features) & set(outcomes))
    if both:
        raise LeakageError(f"outcomes among the features: {', '.join(both)}")


def _permutation(rows: DataFrame, seed: int, per: str = "i") -> DataFrame:
    """sym, per, place: each value of per at a place drawn by hash.

    Hashes are uniform, so that blocks by their first digits are small, whatever share of the rows a symbol has.
    """
    drawn = rows.select("sym", per).distinct().withColumn("_h", F.md5(F.concat_ws("|", "sym", F.col(per).cast("string"), F.lit(str(seed)))))
    drawn = drawn.withColumn("_part", F.substring("_h", 1, HASH_DIGITS))
    before = F.sum("_n").over(Window.partitionBy("sym").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = drawn.groupBy("sym", "_part").agg(F.count("*").alias("_n")).select("sym", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("sym", "_part").orderBy("_h", per))
    return drawn.withColumn("_r", within).join(offsets, ["sym", "_part"]).select("sym", per, (F.col("_before") + F.col("_r") - 1).alias("place"))


def shuffle_labels(dataset: DataFrame, seed: int, column: str = "label") -> DataFrame:
    """The column dealt anew among a symbol's rows."""
    rows = cut(indexed(dataset))
    dealt = rows.join(_permutation(rows, seed), ["sym", "i"]).select("sym", F.col("place").alias("i"), F.col(column).alias("_new"))
    return rows.join(dealt, ["sym", "i"]).withColumn(column, F.col("_new")).select(*dataset.columns)


def shuffle_label_blocks(dataset: DataFrame, seed: int, block: int, column: str = "label") -> DataFrame:
    """Whole blocks of the column in another order; a last block that isn't full stays."""
    rows = cut(indexed(dataset))
    n = rows.groupBy("sym").agg((F.floor(F.count("*") / block)).cast("bigint").alias("_full"))
    blocked = rows.join(n, "sym").withColumn("_b", F.floor(F.col("i") / block))
    order = _permutation(blocked.where("_b < _full"), seed, "_b")
    moved = blocked.join(order, ["sym", "_b"], "left").withColumn("_to", F.coalesce(F.col("place") * block + F.col("i") % block, F.col("i")))
    values = moved.select("sym", F.col("_to").alias("i"), F.col(column).alias("_new"))
    return rows.join(values, ["sym", "i"]).withColumn(column, F.col("_new")).select(*dataset.columns)


def shuffle_times(dataset: DataFrame, seed: int) -> DataFrame:
    """Decision, entry and exit times, together, dealt anew among a symbol's rows."""
    rows = cut(indexed(dataset))
    times = rows.join(_permutation(rows, seed), ["sym", "i"]).select("sym", F.col("place").alias("i"), *[F.col(c).alias(f"_{c}") for c in TIMES])
    return rows.join(times, ["sym", "i"]).withColumns({c: F.col(f"_{c}") for c in TIMES}).select(*dataset.columns)
