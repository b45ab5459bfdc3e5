"""Spreads of quote bars (open = bid, close = ask), session counts, trading costs and the decision rules over them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.ordered import quantiles
from tickloom.schemas import SESSIONS


def with_spread(quotes: DataFrame) -> DataFrame:
    bid, ask = F.col("open"), F.col("close")
    middle, spread = (bid + ask) / 2.0, ask - bid
    return quotes.withColumns({"spread": F.when(F.col("is_traded"), spread), "spread_bps": F.when(F.col("is_traded") & (middle > 0), F.try_divide(spread, middle) * 1e4)})


def session_order(session: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SESSIONS]), session)


def spread_by_session(quotes: DataFrame, since: datetime | None = None) -> DataFrame:
    """sym, session, n and mean, median, p25, p75, p95 in basis points; crossed and odd quotes are left out.

    Quartiles are nearest elements of a symbol's and session's sorted spreads.
    """
    rows = with_spread(quotes).where(F.col("spread_bps") >= 0)
    if "is_price_anomaly" in quotes.columns:
        rows = rows.where(~F.col("is_price_anomaly"))
    if since is not None:
        rows = rows.where(F.col("ts") >= F.lit(since))
    wanted = {"median_bps": (0.5, True)} | {f"p{round(100 * q)}_bps": (q, False) for q in (0.25, 0.75, 0.95)}
    means = rows.groupBy("sym", "session").agg(F.avg("spread_bps").alias("mean_bps"))
    stats = quantiles(rows, ["sym", "session"], "spread_bps", wanted).join(means, ["sym", "session"])
    stats = stats.select("sym", "session", "n", "mean_bps", *wanted)
    return stats.orderBy("sym", session_order(F.col("session")))


def session_counts(bars: DataFrame) -> DataFrame:
    """sym, session, n traded bars and the earliest; sessions without any are left out."""
    found = bars.where("is_traded").groupBy("sym", "session").agg(F.count("*").alias("n"), F.min("ts").alias("earliest"))
    return found.orderBy("sym", session_order(F.col("session")))


def earliest_traded(bars: DataFrame) -> DataFrame:
    return bars.groupBy("sym").agg(F.min(F.when(F.col("is_traded"), F.col("ts"))).alias("earliest"))


def round_trip_bps(spread_bps: Column, *, impact_bps: float = 1.0, commission_bps: float = 0.14, fees_bps: float = 0.2) -> Column:
    """Half a spread, impact, commission and fees, each way."""
    return 2 * (0.5 * spread_bps + impact_bps + commission_bps + fees_bps)


def breakeven_accuracy(cost_bps: Column, barrier_bps: Column, multiple: float = 1.0) -> Column:
    return 0.5 * (1 + multiple * F.try_divide(cost_bps, barrier_bps))


def quotes_of(bars: DataFrame, half: float = 0.0005) -> DataFrame:
    """Quote bars about the closes of trade bars, for data without quotes; the spread widens with the bar's range."""
    wide = F.col("close") * half + (F.col("high") - F.col("low")) / 100
    return bars.withColumns({"open": F.col("close") - wide, "close": F.col("close") + wide})


def decisions(metrics: DataFrame, *, observed: str, null_mean: str, null_std: str, breakeven2: str, tail: str, breakeven1: str) -> DataFrame:
    """Adds the pre-declared verdicts: beats_null (by three deviations), tail_pays, floor_holds (0.55 to 0.57)."""
    c = F.col
    return metrics.withColumns({
        "beats_null": c(observed) >= c(null_mean) + 3 * c(null_std), "tail_pays": c(tail) >= c(breakeven1), "floor_holds": c(breakeven2).between(0.55, 0.57),
    })


#: Mean deflated probabilities above which there is an edge and below which none, and the spread over seeds from which they are
#: unstable. Shares of the full set's excess from which the calendar's features carry it, and the market's retain it.
EDGE, NO_EDGE, UNSTABLE, CALENDAR_CARRIES, MARKET_RETAINS = 0.9, 0.5, 0.05, 0.5, 0.75


def deflation_verdict(by_seed: DataFrame, by: list[str], probability: str = "probability") -> DataFrame:
    """by, mean, spread and verdict of deflated probabilities by seed: unstable, no_edge, edge, or ambiguous. Null without any."""
    mean, spread = F.avg(probability), F.max(probability) - F.min(probability)
    verdict = F.when(spread >= UNSTABLE, "unstable").when(mean < NO_EDGE, "no_edge").when(mean > EDGE, "edge").when(mean.isNotNull(), "ambiguous")
    return by_seed.groupBy(*by).agg(mean.alias("mean"), spread.alias("spread"), verdict.alias("verdict"))


def ablations(metrics: DataFrame, *, full: str, calendar: str, market: str, null: float = 0.5) -> DataFrame:
    """Adds the shares of the full set's excess over the null that the ablated sets have (null where it is zero), and the
    verdict: base_rate, conditional_edge or ambiguous."""
    excess = {name: F.col(c) - null for name, c in (("full", full), ("calendar", calendar), ("market", market))}
    verdict = F.when(excess["calendar"] >= CALENDAR_CARRIES * excess["full"], "base_rate").when(
        F.col(market) >= null + MARKET_RETAINS * excess["full"], "conditional_edge"
    ).when(excess["full"].isNotNull() & excess["calendar"].isNotNull() & excess["market"].isNotNull(), "ambiguous")
    shares = {f"{n}_share": F.try_divide(excess[n], excess["full"]) for n in ("calendar", "market")}
    return metrics.withColumns(shares | {"verdict": verdict})


def render_evidence(title: str, bars: DataFrame, quotes: DataFrame, since: datetime | None = None) -> str:
    """A readable report; its tables have a row a symbol and session."""
    def lines(df: DataFrame) -> list[str]:
        rows = [[str(v) for v in r] for r in df.collect()]
        widths = [max(map(len, x)) for x in zip(df.columns, *rows)]
        return ["  " + "  ".join(v.ljust(w) for v, w in zip(r, widths)) for r in (df.columns, *rows)]

    parts = [f"Evidence: {title}", "", "Traded bars by session (TRADES)", *lines(session_counts(bars)), "", "Traded bars by session (BID_ASK)", *lines(session_counts(quotes)), "", "Spreads by session, all history", *lines(spread_by_session(quotes))]
    if since is not None:
        parts += ["", f"Spreads by session since {since:%Y-%m-%d}", *lines(spread_by_session(quotes, since))]
    return "\n".join(parts)
