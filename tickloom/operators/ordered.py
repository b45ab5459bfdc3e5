"""Order-dependent building blocks that need no task to hold a whole series. They read their rows more than once, so they
compute these once and keep them in the shared checkpoint folder.

A series is one key's rows in order. Positions come from counts by block, prefix sums and last values from block totals
that are carried on, and bounded frames from chunks that repeat a few rows of their neighbours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import cut

#: Rows of a chunk.
CHUNK = 8192


def with_position(rows: DataFrame, keys: Sequence[str], order: str, name: str = "pos") -> DataFrame:
    """Adds the 0-based place of a row in its series: within its UTC date by a window, dates by their counts.

    order: a timestamp column without ties within a series.
    """
    dated = cut(rows).withColumn("_d", F.to_date(order))
    counts = dated.groupBy(*keys, "_d").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*keys, "_d", F.coalesce(before, F.lit(0)).alias("_before"))
    in_day = F.row_number().over(Window.partitionBy(*keys, "_d").orderBy(order))
    placed = dated.withColumn("_in_day", in_day).join(offsets, [*keys, "_d"])
    return placed.withColumn(name, (F.col("_before") + F.col("_in_day") - 1).cast("bigint")).drop("_d", "_in_day", "_before")


def chunks(rows: DataFrame, before: int, after: int, pos: str = "pos", size: int = CHUNK) -> DataFrame:
    """Adds _chunk and _own: each row in its own chunk, and again in the neighbours' that need it as context.

    Windows by (keys, _chunk) with frames of `before` and `after` rows are then exact on the rows where _own holds.
    """
    own = F.floor(F.col(pos) / size)
    first, last = F.floor((F.col(pos) - after) / size), F.floor((F.col(pos) + before) / size)
    spread = rows.withColumn("_chunk", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return spread.withColumn("_own", F.col("_chunk") == own)


def prefix_sums(rows: DataFrame, keys: Sequence[str], pos: str, values: dict[str, Column], size: int = CHUNK) -> DataFrame:
    """Adds running sums, the row itself included, in order of pos."""
    blocked = cut(rows.withColumns({f"_v_{k}": v for k, v in values.items()})).withColumn("_block", F.floor(F.col(pos) / size))
    totals = blocked.groupBy(*keys, "_block").agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in values])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_block", *[F.coalesce(F.sum(f"_s_{k}").over(earlier), F.lit(0)).alias(f"_c_{k}") for k in values])
    within = Window.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    summed = blocked.withColumns({f"_w_{k}": F.coalesce(F.sum(f"_v_{k}").over(within), F.lit(0)) for k in values}).join(carried, [*keys, "_block"])
    return summed.withColumns({k: F.col(f"_w_{k}") + F.col(f"_c_{k}") for k in values}).drop(
        "_block", *[f"_{p}_{k}" for k in values for p in "vwc"]
    )


def sums_before(rows: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column]) -> DataFrame:
    """Adds sums over the rows of the same keys that sort before a row by `order`, which has no ties within the keys.

    Ranges of (keys, order) are the blocks, whatever share of the rows a key has; their totals are carried on.
    """
    valued = rows.withColumns({f"_v_{k}": v for k, v in values.items()})
    ranged = cut(valued.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "_part").agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in values])
    carried = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_of"), *[F.sum(f"_s_{k}").over(earlier).alias(f"_c_{k}") for k in values])
    within = Window.partitionBy("_part", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_part") == F.col("_of")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = ranged.withColumns({f"_w_{k}": F.sum(f"_v_{k}").over(within) for k in values}).join(carried, same)
    summed = {k: F.coalesce(F.col(f"_w_{k}"), F.lit(0)) + F.coalesce(F.col(f"_c_{k}"), F.lit(0)) for k in values}
    return joined.withColumns(summed).select(*rows.columns, *values)


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, tuple[float, bool]]) -> DataFrame:
    """keys, n and a column for each of wanted: name -> (quantile, whether it is interpolated rather than the nearest rank).

    Equal values are counted first; ranks come from the counts of smaller ones.
    """
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("_k"))
    n = counted.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.sum("_k").alias("n"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    placed = sums_before(counted, keys, value, {"_before": F.col("_k")}).join(n, same)
    at_rank = lambda r: F.max(F.when((F.col("_before") <= r) & (r < F.col("_before") + F.col("_k")), F.col(value)))
    found = {}
    for name, (q, interpolated) in wanted.items():
        place = (F.col("n") - 1) * F.lit(q)
        if interpolated:
            low = F.floor(place)
            part = F.first(place - low)
            # between equal values it is that value to the last digit, so that those equal to a bound are at it
            found[name] = at_rank(low) + (at_rank(F.ceil(place)) - at_rank(low)) * part
        else:
            found[name] = at_rank(F.floor(place + 0.5))
    return placed.groupBy(*keys).agg(F.first("n").alias("n"), *[c.alias(name) for name, c in found.items()])


def asof_backward(target: DataFrame, context: DataFrame, name: str, on: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """Adds a struct column: the latest context row (its own time included) at or before each target row; null if none.

    No tolerance and no daily reset. The struct is taken whole, so a null within the latest row stays null. Last values
    are found within a date, and dates without an earlier row get the last one of the dates before.
    """
    columns = [c for c in context.columns if c not in by]
    packed = F.struct(*[F.col(c) for c in columns])
    kind = packed_type(context, columns)
    target, context = cut(target), cut(context)
    left = target.select("*", F.lit(None).cast(kind).alias(name), F.lit(1).alias("_is_target"))
    right = context.select(*by, F.col(on), packed.alias(name), F.lit(0).alias("_is_target"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_d", F.to_date(on))
    in_day = Window.partitionBy(*by, "_d").orderBy(on, "_is_target").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn(name, F.last(name, ignorenulls=True).over(in_day))
    last = right.withColumn("_d", F.to_date(on)).groupBy(*by, "_d").agg(F.max_by(name, F.col(on)).alias("_last"))
    days = both.select(*by, "_d").distinct().join(last, [*by, "_d"], "left")
    earlier = Window.partitionBy(*by).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*by, "_d", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    out = filled.where("_is_target = 1").join(days, [*by, "_d"], "left")
    return out.withColumn(name, F.coalesce(name, "_carried")).select(*target.columns, name)


def packed_type(rows: DataFrame, columns: Sequence[str]) -> str:
    return "struct<" + ",".join(f"`{c}`:{rows.schema[c].dataType.simpleString()}" for c in columns) + ">"
