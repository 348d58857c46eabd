"""Visible text, words, shingles and min-wise sketches of whole texts, batch-wise in numpy."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable

import numpy as np
import xxhash

TAG = re.compile(r"<!--.*?(?:-->|\Z)|</?[A-Za-z][^<>]*(?:>|\Z)", re.S)
WORD = re.compile(r"[^\W_]+")
_CACHE_LIMIT = 1_000_000
_cache: dict[str, int] = {}


def visible_text(text: str | None) -> str:
    """``text`` without tags and comments, entities resolved; a tag cut off at the end counts as markup. Null gives ''."""
    if not text:
        return ""
    if "<" in text:
        text = TAG.sub(" ", text)
    return html.unescape(text) if "&" in text else text


def words_of(text: str | None) -> list[str]:
    """The lower-cased runs of letters and digits of the visible text."""
    return WORD.findall(visible_text(text).lower())


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes, the same in every process; the cache is emptied at a fixed size."""
    get, out = _cache.get, []
    for w in words:
        h = get(w)
        if h is None:
            if len(_cache) >= _CACHE_LIMIT:
                _cache.clear()
            h = _cache[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word sequences; empty for fewer than ``n`` words."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    k = len(hashes) - n + 1
    x = hashes[:k].copy()
    for i in range(1, n):
        x = mix(x) + hashes[i : i + k]
    return np.unique(mix(x))


def order_hash(hashes: np.ndarray) -> int:
    """One 64-bit hash of a word sequence; equal for exact copies."""
    return xxhash.xxh64_intdigest(hashes.tobytes())


class MinHash:
    """``size`` min-wise values of a shingle set: two sets agree in each with the probability of their overlap."""

    def __init__(self, size: int, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(1, 2**63, size, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.b = rng.integers(0, 2**63, size, dtype=np.uint64)

    def __call__(self, shingle_hashes: np.ndarray) -> np.ndarray:
        """The smallest 32-bit value under each function, as uint32; the set must not be empty."""
        best = None
        for at in range(0, len(shingle_hashes), 4096):  # whole text, in blocks of bounded memory
            part = (shingle_hashes[at : at + 4096, None] * self.a + self.b) >> np.uint64(32)
            low = part.min(axis=0)
            best = low if best is None else np.minimum(best, low)
        return best.astype(np.uint32)


def bit_sketch(mins: np.ndarray) -> np.ndarray:
    """Two signed 64-bit integers per row (rows, 2): the first and the second of two mixed bits of each of 64 min-wise values."""
    mixed = mix(mins[:, :64].astype(np.uint64))
    bits = np.stack([mixed & np.uint64(1), (mixed >> np.uint64(1)) & np.uint64(1)], axis=1).astype(np.uint8)
    return np.packbits(bits, axis=2).view(np.int64).reshape(len(mins), 2)


def least_agreement(threshold: float, sigmas: float = 3.5) -> int:
    """In how many of the 64 two-bit values two sets with an overlap of ``threshold`` agree, less ``sigmas`` deviations."""
    agree = threshold + (1 - threshold) / 4
    return math.floor(64 * agree - sigmas * math.sqrt(64 * agree * (1 - agree)))


def combine(parts: Iterable[np.ndarray], salt: int) -> np.ndarray:
    """Hash columns of integers into one signed 64-bit key column."""
    key = None
    for p in parts:
        p = p.astype(np.uint64)
        key = mix(p + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)) if key is None else mix(key * np.uint64(0xD1342543DE82EF95) + p)
    return key.view(np.int64)
