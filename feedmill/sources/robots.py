"""Crawling permissions from robots.txt."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F


def parse(text: str | None) -> list[tuple[list[str], list[tuple[bool, str]]]]:
    """Groups of (agents, rules); a rule is (allowed, path). Rules before any agent hold for all; an empty prohibition is no rule."""
    groups: list[tuple[list[str], list[tuple[bool, str]]]] = []
    open_for_agents = False
    for line in (text or "").split("\n"):
        field, colon, value = line.split("#", 1)[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if not colon:
            continue
        if field == "user-agent":
            if not open_for_agents:
                groups.append(([], []))
                open_for_agents = True
            groups[-1][0].append(value.lower())
        elif field in ("allow", "disallow"):
            if not groups:
                groups.append((["*"], []))
            open_for_agents = False
            if value or field == "allow":
                groups[-1][1].append((field == "allow", value))
    return groups


def _reach(path: str, rule: str) -> int:
    """How much of a rule's path fits, stars not counted; -1 if it doesn't. Parts are looked for from left to right, each once."""
    if not rule:
        return -1
    anchored, pattern = rule.endswith("$"), rule.removesuffix("$")
    at = 0
    for i, part in enumerate(pattern.split("*")):
        if not part:
            continue
        found = path.find(part, at)
        if found < 0 or (i == 0 and found):
            return -1
        at = found + len(part)
    return -1 if anchored and at != len(path) else len(pattern.replace("*", ""))


def allowed(text: str | None, path: str | None, agent: str) -> bool:
    """The most specific group for the agent decides, in it the longest rule, of equal ones the first; no rule allows."""
    agent = agent.lower()
    best, rules = -1, None
    for agents, own in parse(text):
        for a in agents:
            fit = 0 if a == "*" else len(a) if a in agent else -1
            if fit > best:
                best, rules = fit, own
    length, verdict = -1, True
    for allow, rule in rules or []:
        n = _reach(path or "/", rule)
        if n > length:
            length, verdict = n, allow
    return verdict


def is_allowed(agent: str):
    """A column function (robots text, path with parameters) -> boolean; a null text allows everything."""

    def decide(text: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([allowed(t, p, agent) for t, p in zip(text, path)], dtype=bool)

    return lambda text, path: F.pandas_udf(decide, "boolean")(text, path)
