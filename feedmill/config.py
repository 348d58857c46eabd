"""Settings from environment texts, and structured logs."""

from __future__ import annotations

import json
import logging
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone


def flag(text: str | None, default: bool) -> bool:
    """1, true, yes and on are true, any other text false; nothing gives the default."""
    if text is None or not text.strip():
        return default
    return text.strip().lower() in ("1", "true", "yes", "on")


def whole(text: str | None, default: int, least: int = 1) -> int:
    """A number from ``least`` on, cut to whole ones; the default for anything else."""
    try:
        n = float(text or "")
    except ValueError:
        return default
    return int(n) if n == n and least <= n < 2**63 else default


def provider(env: Mapping[str, str]) -> tuple[str, bool]:
    """(kind of model service, usable): the one that is named, else 'openai' for a base address, 'anthropic' for its key, or 'none'.

    An address needs names of models for both tasks, and a key unless it is local; the other kind needs its key.
    """
    has = lambda key: (env.get(f"FEEDMILL_MODEL_{key}") or "").strip()
    kind = has("PROVIDER") or ("openai" if has("BASE_URL") else "anthropic" if has("DIRECT_KEY") else "none")
    if kind == "openai":
        local = re.search(r"localhost|127\.0\.0\.1", has("BASE_URL"))
        models = [has(f"NAME_{task}") or has("NAME") for task in ("CLASSIFY", "SUMMARIZE")]
        return kind, bool(has("BASE_URL") and all(models) and (has("KEY") or local))
    return kind, kind == "anthropic" and bool(has("DIRECT_KEY"))


@dataclass(frozen=True)
class Settings:
    max_items_per_source: int = 15
    timeout_seconds: float = 15.0
    respect_robots: bool = True
    user_agent: str = "feedmill"
    model_budget: int = 0
    model_attempts: int = 4
    model_pause_seconds: float = 0.0
    provider: str = "none"
    model_usable: bool = False
    retention: Mapping[str, int] = field(default_factory=lambda: {"junk": 14, "low": 60, "medium": 180, "high": 365})
    safety_cap: int = 5000

    @classmethod
    def from_environment(cls, env: Mapping[str, str] | None = None) -> Settings:
        e, d = os.environ if env is None else env, cls()
        days = {k: whole(e.get(f"FEEDMILL_RETAIN_{k.upper()}_DAYS"), v) for k, v in d.retention.items()}
        kind, usable = provider(e)
        pause = whole(e.get("FEEDMILL_MODEL_PAUSE_MS"), 0, 0) / 1000
        return cls(
            whole(e.get("FEEDMILL_MAX_ITEMS"), d.max_items_per_source), whole(e.get("FEEDMILL_TIMEOUT_MS"), int(d.timeout_seconds * 1000)) / 1000, flag(e.get("FEEDMILL_ROBOTS"), d.respect_robots),
            e.get("FEEDMILL_USER_AGENT") or d.user_agent, whole(e.get("FEEDMILL_MODEL_BUDGET"), d.model_budget, 0), whole(e.get("FEEDMILL_MODEL_ATTEMPTS"), d.model_attempts),
            pause, kind, usable, days, whole(e.get("FEEDMILL_SAFETY_CAP"), d.safety_cap),
        )


class JsonLines(logging.Formatter):
    """One JSON object a line: time, level, message, and what ``extra={"fields": {...}}`` adds."""

    def format(self, record: logging.LogRecord) -> str:
        at = datetime.fromtimestamp(record.created, timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        return json.dumps({"time": at, "level": record.levelname.lower(), "msg": record.getMessage(), **getattr(record, "fields", {})}, ensure_ascii=False, default=str)


def logger(name: str = "feedmill", level: str = "INFO") -> logging.Logger:
    log = logging.getLogger(name)
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(JsonLines())
        log.addHandler(handler)
    log.setLevel(level)
    return log
