"""Triple-barrier labels and the research dataset."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import touched_name
from tickloom.operators.ordered import chunks, with_position
from tickloom.schemas import LABELS


class LabelGenerator(Protocol):
    def generate(self, bars: DataFrame) -> DataFrame:
        """Labels of traded bars with sigma."""


@dataclass(frozen=True)
class TripleBarrier:
    """Decide at a bar, enter at the next one's open; exit at the first touch of open * (1 +- k sigma) within h_bars more
    bars, else at the last one's close.

    A bar that touches both counts as the stop. Windows that the data's end cuts short are timeouts. The walk is a frame of
    h_bars + 2 rows over chunks of a symbol's bars.
    """

    k: float = 2.0
    h_bars: int = 30
    chunk: int = 8192

    def generate(self, bars: DataFrame) -> DataFrame:
        rows = bars.where("is_traded") if "is_traded" in bars.columns else bars
        placed = with_position(rows.select("sym", "ts", "open", "high", "low", "close", "sigma"), ["sym"], "ts")
        spread = chunks(placed, 0, self.h_bars + 1, size=self.chunk)
        # a chunk's rows see those after them: the context lies in the chunk of the rows before
        ahead = Window.partitionBy("sym", "_chunk").orderBy("pos").rowsBetween(1, self.h_bars + 1)
        walked = spread.withColumn("_next", F.collect_list(F.struct("ts", "open", "high", "low", "close")).over(ahead)).where("_own")
        entry, sigma = F.col("_next")[0]["open"], F.col("sigma")
        usable = (F.size("_next") > 0) & sigma.isNotNull() & ~F.isnan(sigma) & (sigma > 0) & (sigma < float("inf"))
        opened = walked.where(usable).withColumn("_entry", entry).where("_entry > 0")
        opened = opened.withColumns({"_up": F.col("_entry") * (1.0 + self.k * sigma), "_down": F.col("_entry") * (1.0 - self.k * sigma)})
        touches = F.filter("_next", lambda b: (b["high"] >= F.col("_up")) | (b["low"] <= F.col("_down")))
        seen = opened.withColumn("_hit", F.get(touches, F.lit(0))).withColumn("_last", F.element_at("_next", -1))
        tp, sl = F.col("_hit.high") >= F.col("_up"), F.col("_hit.low") <= F.col("_down")
        code = F.when(F.col("_hit").isNull(), 0).when(tp & sl, 2).when(tp, 1).otherwise(-1)
        price = F.when(F.col("_hit").isNull(), F.col("_last.close")).when(sl, F.col("_down")).otherwise(F.col("_up"))
        out = seen.withColumn("_code", code).select(
            "sym", F.col("ts").alias("decision_ts"), F.col("_next")[0]["ts"].alias("entry_ts"), F.coalesce("_hit.ts", "_last.ts").alias("exit_ts"),
            F.when(F.col("_code") == 2, -1).otherwise(F.col("_code")).cast("bigint").alias("label"), touched_name(F.col("_code")).alias("touched"),
            (price / F.col("_entry") - 1.0).alias("gross_return"), "sigma",
        )
        return out.select(*[f.name for f in LABELS.fields])


METHODS = {"triple_barrier": TripleBarrier}


def label_generator(method: str, **parameters) -> LabelGenerator:
    if method not in METHODS:
        raise ValueError(f"the label method {method!r} isn't one of {', '.join(METHODS)}")
    return METHODS[method](**parameters)


def assemble_dataset(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels with the features of their decision bar; joined on the entry's time they would leak."""
    known = features.withColumnRenamed("ts", "decision_ts").drop("sigma")
    return labels.join(known, ["sym", "decision_ts"], "left")


def label_distribution(labels: DataFrame) -> DataFrame:
    return labels.groupBy("sym", "label").agg(F.count("*").alias("n"), F.avg("gross_return").alias("mean_gross_return"))


def barrier_stats(labels: DataFrame) -> DataFrame:
    """By symbol: labels, timeouts' share; of resolved ones the mean barrier in basis points and the share of exits on
    another UTC date."""
    return labels.groupBy("sym").agg(
        F.count("*").alias("n"), F.avg((F.col("touched") == "vertical").cast("double")).alias("timeout_rate"),
        (F.avg(F.when(F.col("touched") != "vertical", F.abs("gross_return"))) * 1e4).alias("barrier_bps"),
        F.avg(F.when(F.col("touched") != "vertical", (F.to_date("entry_ts") != F.to_date("exit_ts")).cast("double"))).alias("cross_day_rate"),
    )
