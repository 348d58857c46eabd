"""Ordered keyword rules: category, impact, tags, and titles that are only a version."""

from __future__ import annotations

import heapq
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, functions as F

from .text import WHITE, contentless_body, trim

# The category rules, the first that matches wins; \b is an ASCII boundary.
CATEGORY_RULES = [
    ("deprecation", r"\b(?:deprecat|sunset|retir|end[- ]of[- ]life|\beol\b|shut(?:ting)? ?down|discontinu|\bremoved?\b)"),
    ("security", r"\b(?:security|vulnerab|\bcve\b|exploit|breach|patch(?:ed|es)?|advisory|malicious|attack)"),
    ("pricing", r"\b(?:pricing|\bpric(?:e|es|ed|ey)\b|\bcosts?\b|billing|free tier|discount|cheaper|per[- ]token)"),
    ("model", r"\b(?:model|gpt[- ]?\d|claude|gemini|llama|mistral|frontier|flagship|opus|sonnet|haiku|reasoning model|multimodal)"),
    ("sdk", r"\b(?:sdk|library|package|npm|\bpip\b|client library|version \d|release notes|changelog)"),
    ("api", r"\b(?:api|endpoint|rate ?limit|param(?:eter)?s?|tokens?\/min|webhook)"),
    ("coding", r"\b(?:copilot|cursor|code completion|autocomplete|\bide\b|coding agent|pull request|developer tool)"),
    ("research", r"\b(?:research|paper|benchmark|eval(?:uation|s)?|study|findings|state[- ]of[- ]the[- ]art|arxiv)"),
    ("deprecation", r"\bbreaking change"),
    ("product", r"\b(?:launch|now available|general availability|\bga\b|introducing|announc|rollout|releas)"),
    ("company", r"\b(?:funding|raise[ds]?|series [a-e]|partnership|acqui|hiring|appoint|valuation)"),
    ("tool", r"\b(?:tool|feature|integration|plugin|extension|\bapps?\b|capabilit)"),
]
# The impact rules.
IMPACT_RULES = [
    ("critical", r"\b(?:critical|zero[- ]day|actively exploited|severe|emergency|data breach|outage)"),
    ("high", r"\b(?:deprecat|breaking change|flagship|frontier|general availability|\bga\b|\bmajor\b|new model|price (?:increase|change|drop)|sunset|retir)"),
    ("medium", r"\b(?:new feature|update|improv|expand|support for|now available|sdk|api)"),
]
# Tags that are looked for first, in this order.
KNOWN_TAGS = [
    "gpt-4", "gpt-5", "gpt", "o1", "o3", "claude", "opus", "sonnet", "haiku", "gemini", "llama", "mistral", "deepseek",
    "grok", "copilot", "cursor", "replit", "api", "sdk", "pricing", "security", "model", "agent", "agents", "mcp",
    "embeddings", "vision", "reasoning", "fine-tuning", "finetuning", "rag", "function-calling", "tool-use", "multimodal",
    "voice", "audio", "image", "video", "deprecation", "beta", "ga",
]
# Words that make no tag.
STOPWORDS = [
    "the", "a", "an", "and", "or", "to", "of", "in", "on", "for", "with", "is", "are", "now", "new", "our", "we", "you",
    "your", "this", "that", "from", "by", "at", "as", "it", "its", "has", "have", "will", "can", "all", "more", "how",
    "what", "why",
]
# Words and package endings that add nothing to a version.
RELEASE_WORDS = [
    "release", "releases", "cli", "sdk", "ui", "core", "version", "build", "pre", "rc", "alpha", "beta", "preview",
    "nightly", "dev", "stable", "patch", "hotfix", "final",
]
PACKAGE_ENDINGS = [
    "sdk", "cli", "js", "ts", "py", "api", "ui", "core", "server", "client", "node", "express", "hono", "fastify",
]


def _boundaries(pattern: str) -> str:
    """Each boundary as what it means where it stands: nothing of a word before a word's first letter, or after its last one."""
    before, after = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
    pattern = re.sub(r"(^|[|:(])\\b", lambda m: m[1] + before, pattern)
    return "(?i)" + pattern.replace(r"\b", after)


def _first_match(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    out = None
    for name, pattern in rules:
        hit = text.rlike(_boundaries(pattern))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def category(text: Column) -> Column:
    return _first_match(text, CATEGORY_RULES, "product")


def impact(text: Column) -> Column:
    return _first_match(text, IMPACT_RULES, "low")


TAG_WORD = re.compile(r"[a-z][a-z0-9+.-]{2,}")


def tags_of(text: str | None, most: int = 6) -> list[str] | None:
    """At most ``most`` tags of a lower-case text: known ones that it contains, in their order, then its most frequent words, earlier
    ones first; null for null."""
    if text is None:
        return None
    known = [t for t in KNOWN_TAGS if t in text]
    words = Counter(w for w in TAG_WORD.findall(text) if w not in STOPWORDS)  # in the order of their first places
    rest = heapq.nsmallest(most + len(known), ((-n, i, w) for i, (w, n) in enumerate(words.items())))
    return list(dict.fromkeys([*known, *(w for _, _, w in rest)]))[:most]


def _tag_series(texts: pd.Series) -> pd.Series:
    return texts.map(tags_of)


def tags(text: Column) -> Column:
    """``tags_of`` as a column, in Arrow batches: counting words needs a table of its own for each text."""
    return F.pandas_udf(_tag_series, "array<string>")(F.lower(text))


def is_version_title(title: Column) -> Column:
    """One to four words, of which one is a version, build or date and the others say no more than that; false for null."""
    words = F.filter(F.split(trim(title), f"{WHITE}+"), lambda w: w != "")
    bare = F.filter(F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, r"^[(\[{]+", ""), r"[:•·,)\]}]+$", "")), lambda w: w != "")
    version = lambda w: w.rlike(r"^[@A-Za-z0-9_./+-]*[0-9][@A-Za-z0-9_./+-]*$")
    noise = lambda w: F.lower(w).isin(RELEASE_WORDS) | F.lower(w).rlike("-(?:" + "|".join(PACKAGE_ENDINGS) + ")$")
    return F.coalesce(F.size(words).between(1, 4) & F.forall(bare, lambda w: version(w) | noise(w)) & F.exists(bare, version), F.lit(False))


def is_contentless(title: Column, body: Column) -> Column:
    return is_version_title(title) & contentless_body(body)
