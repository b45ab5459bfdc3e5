"""python -m tickloom COMMAND --config DIR --symbol S: ingest, status, validate, features, labels, dataset, report."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timedelta, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tickloom.functions.identity import git_sha
from tickloom.operators import bars as B
from tickloom.operators import features as X
from tickloom.operators.calendar import calendar_for
from tickloom.operators.labels import assemble_dataset, label_generator
from tickloom.operators.quotes import render_evidence
from tickloom.session import build_session
from tickloom.sources.config import Config, load
from tickloom.sources.history import Ingestor, Pacer, PagedSource, Recorded, utc
from tickloom.sources.lake import Lake
from tickloom.sources.logs import configure, get_logger


def recorded(config: Config, path: str) -> PagedSource:
    """Recorded bars in Parquet files, asked for as a broker's history is."""
    return PagedSource(Recorded(path), Pacer(config.source.units, config.source.seconds))


def assemble(lake: Lake, config: Config, sym: str, series: str, sessions: tuple[str, ...]):
    rows = lake.snapshots(sym, series)
    return B.assemble_validated(rows, calendar_for(rows), sessions, config.bars.step), rows


def generators(config: Config) -> list:
    f = config.features
    return [X.LaggedReturns(f.horizons), X.BarrierVolatility(), X.RangeVolatility(f.range_window), X.RelativeVolume(f.volume_window), X.TimeOfDay(config.sessions.timezone)]


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    config = load(args.config)
    lake, sym, log = Lake(spark, config.storage.root), args.symbol, get_logger(args.command, sym=args.symbol)
    volatility = {"bucket_minutes": config.volatility.bucket_minutes, "span_days": config.volatility.span_days, "tz": config.sessions.timezone}
    if args.command in ("ingest", "status"):
        end = utc(datetime.fromisoformat(args.end), "UTC") if args.end else datetime.now(timezone.utc)
        ingest = Ingestor(spark, lake, recorded(config, args.bars) if args.bars else None, config.source.request_timezone, config.bars.step)
        if args.command == "ingest":
            n = ingest.update(sym, args.series, end) if ingest.frontier(sym, args.series) else ingest.backfill(sym, args.series, utc(datetime.fromisoformat(args.start), "UTC"), end)
            log.info("ingested", context={"bars": n})
        return 0 if ingest.complete(sym, args.series, end) else 1
    if args.command == "report":
        trades, _ = assemble(lake, config, sym, "TRADES", config.sessions.ingest)
        quotes, rows = assemble(lake, config, sym, "BID_ASK", config.sessions.ingest)
        newest = rows.agg(F.max("ts")).first()[0]
        print(render_evidence(sym, trades, quotes, newest - timedelta(days=365 * args.recent_years)))
        return 0
    if args.command == "validate":
        frame, rows = assemble(lake, config, sym, "TRADES", config.sessions.tradable)
        ids = sorted(r[0] for r in rows.select("snapshot_id").distinct().collect())
        manifest = lake.build("validated_bars", frame, sym, raw=ids, bar=config.bars.version)
    elif args.command == "features":
        frame = X.build_features(lake.read("validated_bars", sym), generators(config), **volatility)
        manifest = lake.build("features", frame, sym, feature=config.features.version)
    elif args.command == "labels":
        labels = label_generator(config.labels.method, k=config.labels.k, h_bars=config.labels.h_bars)
        manifest = lake.build("labels", labels.generate(X.with_sigma(lake.read("validated_bars", sym), **volatility)), sym, label=config.labels.version)
    else:
        facts = [lake.read_manifest(layer, sym) for layer in ("validated_bars", "features", "labels")]
        sha = git_sha(".")
        if not all(facts):
            log.error("validate, features and labels come first")
            return 2
        if sha.endswith("-dirty") and not args.allow_dirty:
            log.error("the working tree has changes that aren't committed")
            return 2
        bars, features, labels = facts
        rows = assemble_dataset(lake.read("features", sym), lake.read("labels", sym))
        manifest = lake.build("datasets", rows, sym, raw=bars["raw"], bar=bars["bar"], feature=features["feature"], label=labels["label"], cost=config.costs.version, git=sha)
    if manifest is None:
        log.error("no rows")
        return 1
    log.info("built", context=manifest)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tickloom", description=__doc__)
    parser.add_argument("command", choices=("ingest", "status", "validate", "features", "labels", "dataset", "report"))
    parser.add_argument("--config", required=True)
    parser.add_argument("--symbol", required=True)
    parser.add_argument("--series", default="TRADES")
    parser.add_argument("--bars", help="recorded bars to ingest")
    parser.add_argument("--start")
    parser.add_argument("--end")
    parser.add_argument("--recent-years", type=int, default=3)
    parser.add_argument("--allow-dirty", action="store_true")
    args = parser.parse_args(argv)
    configure()
    return run(args, spark or build_session())


if __name__ == "__main__":
    sys.exit(main())
