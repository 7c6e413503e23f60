"""Structured logs: one JSON object per line, and a logger that says nothing."""

from __future__ import annotations

import json
import logging
import sys
from datetime import datetime, timezone

LEVELS = {"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "warning": logging.WARNING, "error": logging.ERROR}


class JsonFormatter(logging.Formatter):
    """Time, level and message; an ``obj`` given as extra goes under its ``key``."""

    def format(self, record: logging.LogRecord) -> str:
        out = {"time": datetime.fromtimestamp(record.created, timezone.utc).isoformat(), "level": record.levelname.lower(), "msg": record.getMessage()}
        if getattr(record, "obj", None) is not None:
            out[getattr(record, "key", None) or "obj"] = record.obj
        if record.exc_info:
            out["error"] = self.formatException(record.exc_info)
        return json.dumps(out, default=str, ensure_ascii=False)


def level_of(name: str | None) -> int:
    """Level by name; info for any other name."""
    return LEVELS.get((name or "").strip().lower(), logging.INFO)


def init(level: str | None = "info", stream=None) -> logging.Logger:
    """The library's logger, writing JSON lines to standard output."""
    log = logging.getLogger("quillrake")
    handler = logging.StreamHandler(stream or sys.stdout)
    handler.setFormatter(JsonFormatter())
    log.handlers[:], log.propagate = [handler], False
    log.setLevel(level_of(level))
    return log


def silent() -> logging.Logger:
    log = logging.getLogger("quillrake.silent")
    log.handlers[:], log.propagate = [logging.NullHandler()], False
    return log
