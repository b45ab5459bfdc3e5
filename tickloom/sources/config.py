"""Configuration: one file a section, every key declared, nothing that affects results by default."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path
from typing import get_type_hints

from tickloom.operators.labels import METHODS
from tickloom.schemas import SERIES, SESSIONS


class ConfigError(ValueError):
    """A file that can't be read, or a key that is missing, unknown or wrong."""


@dataclass(frozen=True)
class Symbols:
    tradable: tuple[str, ...]
    context: tuple[str, ...]

    def __post_init__(self):
        if len(set(self.tradable + self.context)) < len(self.tradable + self.context):
            raise ConfigError("a symbol is named twice")


@dataclass(frozen=True)
class Sessions:
    ingest: tuple[str, ...]
    tradable: tuple[str, ...]
    timezone: str

    def __post_init__(self):
        if unknown := set(self.ingest + self.tradable) - set(SESSIONS):
            raise ConfigError(f"no such session: {', '.join(sorted(unknown))}")
        if not set(self.tradable) <= set(self.ingest):
            raise ConfigError("tradable sessions must be ingested")


@dataclass(frozen=True)
class Bars:
    step: str
    series: tuple[str, ...]
    version: str

    def __post_init__(self):
        if unknown := set(self.series) - set(SERIES):
            raise ConfigError(f"no such series: {', '.join(sorted(unknown))}")


@dataclass(frozen=True)
class Features:
    horizons: tuple[int, ...]
    range_window: int
    volume_window: int
    version: str


@dataclass(frozen=True)
class Volatility:
    bucket_minutes: int
    span_days: int


@dataclass(frozen=True)
class Labels:
    method: str
    k: float
    h_bars: int
    version: str

    def __post_init__(self):
        if self.method not in METHODS:
            raise ConfigError(f"the label method {self.method!r} isn't one of {', '.join(METHODS)}")
        if self.k <= 0 or self.h_bars < 1:
            raise ConfigError("k and h_bars must be positive")


@dataclass(frozen=True)
class Costs:
    impact_bps: float
    commission_bps: float
    fees_bps: float
    version: str


@dataclass(frozen=True)
class Source:
    units: int
    seconds: float
    request_timezone: str


@dataclass(frozen=True)
class Storage:
    root: str


@dataclass(frozen=True)
class Config:
    symbols: Symbols
    sessions: Sessions
    bars: Bars
    features: Features
    volatility: Volatility
    labels: Labels
    costs: Costs
    source: Source
    storage: Storage


def section(kind: type, values: dict, where: str = ""):
    names = {f.name for f in fields(kind)}
    if missing := sorted(names - set(values)):
        raise ConfigError(f"{where}: missing {', '.join(missing)}")
    if unknown := sorted(set(values) - names):
        raise ConfigError(f"{where}: unknown {', '.join(unknown)}")
    hints, made = get_type_hints(kind), {}
    for name, value in values.items():
        want = hints[name]
        origin = getattr(want, "__origin__", want)
        if origin is tuple and isinstance(value, list):
            value = tuple(value)
        if origin is float and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if not isinstance(value, origin) or isinstance(value, bool):
            raise ConfigError(f"{where}: {name} must be {origin.__name__}, not {value!r}")
        made[name] = value
    try:
        return kind(**made)
    except ConfigError as e:
        raise ConfigError(f"{where}: {e}") from e


def parse(path: Path) -> dict:
    """JSON, or YAML where its library is installed."""
    try:
        if path.suffix == ".json":
            return json.loads(path.read_text())
        import yaml

        return yaml.safe_load(path.read_text())
    except (OSError, ValueError, ImportError) as e:
        raise ConfigError(f"{path}: {e}") from e


def load(folder: str | Path) -> Config:
    hints, made = get_type_hints(Config), {}
    for name, kind in hints.items():
        found = [p for p in (Path(folder, f"{name}{x}") for x in (".json", ".yaml", ".yml")) if p.exists()]
        if not found:
            raise ConfigError(f"{folder}: no file for the section {name}")
        values = parse(found[0])
        if not isinstance(values, dict):
            raise ConfigError(f"{found[0]}: not a mapping")
        made[name] = section(kind, values, str(found[0]))
    return Config(**made)
