"""Log records as JSON, one a line."""

from __future__ import annotations

import json
import logging
import sys
from datetime import datetime, timezone


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        out = {"timestamp": datetime.fromtimestamp(record.created, timezone.utc).isoformat(), "level": record.levelname.lower(), "logger": record.name, "event": record.getMessage()}
        out |= getattr(record, "context", {})
        if record.exc_info:
            out["exception"] = self.formatException(record.exc_info)
        return json.dumps(out, default=str)


def configure(level: str = "INFO", stream=None) -> None:
    handler = logging.StreamHandler(stream or sys.stderr)
    handler.setFormatter(JsonFormatter())
    root = logging.getLogger("tickloom")
    root.handlers, root.propagate = [handler], False
    root.setLevel(level)


class ContextLogger(logging.LoggerAdapter):
    def process(self, msg, kwargs):
        return msg, kwargs | {"extra": {"context": {**self.extra, **kwargs.pop("context", {})}}}


def get_logger(name: str, **context) -> ContextLogger:
    return ContextLogger(logging.getLogger(f"tickloom.{name}"), context)
