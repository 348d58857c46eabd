"""Encoding of a corpus with a public byte-level BPE tokenizer by overlapping chunks.

Each text is cut into overlapping chunks, which are pre-tokenised on their own (by threads where there are many).  Where two
neighbours have a pre-token boundary in common in their overlap they go on alike, for the pattern reads from left to right
without memory, so the text is stitched there.  A boundary after white space isn't used, as the pattern looks ahead there.  If
two neighbours have no common boundary (a run of one class longer than the overlap), they are pre-tokenised as one chunk.  The
pieces, the pre-tokens, are then encoded, each once in a process as long as it is kept.  Decoding puts raw bytes together.

A corpus is encoded in one pass over its rows, without a shuffle; a text of one chunk has nothing to stitch.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

#: The rank file; it must be readable at this path on every executor (ship it with the job where it isn't).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern that splits text before the merges of the public rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPLIT = regex.compile(PATTERN)

CHUNK, OVERLAP = 768, 96
#: Chunks of one text from which on threads share the work; pre-tokens whose ids are kept; ids that are held before they are sent.
MANY, KEPT, HELD = 2048, 200_000, 2_000_000


@functools.lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    """The tokenizer of a rank file; built once in a process."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Pieces(dict):
    """The ids of pre-tokens; emptied when it holds ``KEPT``."""

    def __init__(self, path: str) -> None:
        self.encode = encoding(path).encode_ordinary

    def __missing__(self, piece: str) -> list[int]:
        if len(self) >= KEPT:
            self.clear()
        ids = self[piece] = self.encode(piece)
        return ids


@functools.lru_cache(maxsize=4)
def pieces(path: str = VOCABULARY) -> Pieces:
    return Pieces(path)


def decode(ids: list[int], path: str = VOCABULARY) -> str:
    """The text of ``ids``: the raw bytes of all ids put together, then read as UTF-8."""
    return b"".join(encoding(path).decode_tokens_bytes(ids)).decode("utf-8")


def _seam(left: list[str], a: int, right: list[str], b: int, text: str) -> tuple[int, int] | None:
    """How many pre-tokens of ``left`` (from place a) and of ``right`` (from place b) lie before their first common sure boundary."""
    end = a + sum(map(len, left))
    ends, at, k = {}, end, len(left)
    while k and at > b:  # from the right, as far as the overlap goes; the last one is not sure
        if k < len(left):
            ends[at] = k
        k -= 1
        at -= len(left[k])
    at = b
    for k, token in enumerate(right, 1):
        at += len(token)
        if at >= end:
            return None
        if at in ends and not text[at - 1].isspace():
            return ends[at], k
    return None


def pre_tokens(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[str]]:
    """The pre-tokens of a text, chunk by chunk, stitched; together they are those of the whole text."""
    if chunk <= 2 * overlap:
        raise ValueError("chunk must exceed twice overlap")
    step = chunk - overlap
    starts = range(0, max(1, len(text) - overlap), step)
    split = lambda at: SPLIT.findall(text[at : at + chunk])
    if len(starts) < MANY:
        parts = map(split, starts)
    else:
        concurrent = lambda at: SPLIT.findall(text[at : at + chunk], concurrent=True)
        parts = chain.from_iterable(_shared(concurrent, starts[k : k + MANY]) for k in range(0, len(starts), MANY))
    parts = iter(parts)
    held, begin, wanted = next(parts), 0, 0
    for at, new in zip(starts[1:], parts):
        if at + chunk < wanted and at + step < starts[-1] + 1:  # within a run that is being joined
            continue
        seam = None if wanted else _seam(held, begin, new, at, text)
        if seam is None:
            whole = at + chunk - begin
            if wanted or at == starts[-1]:
                held, wanted = SPLIT.findall(text[begin : at + chunk]), 0
            else:  # joined in steps that double, so that a run of any length is read a bounded number of times
                wanted = begin + 2 * whole
            continue
        yield held[: seam[0]]
        held = new[seam[1] :]
        begin = at + sum(map(len, new[: seam[1]]))
    yield held


def _shared(f, values) -> list:
    with ThreadPoolExecutor(4) as pool:
        return list(pool.map(f, values))


def ids_of(text: str | None, path: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ids of a whole text; none for null and empty texts."""
    if not text:
        return []
    known = pieces(path)
    return list(chain.from_iterable(known[p] for part in pre_tokens(text, chunk, overlap) for p in part))


def encode(df: DataFrame, id_col: str, text_col: str, path: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id_col, ids array<int>): one row for each row of ``df``, without special tokens.

    Null and empty texts give an empty list; blank texts their white space.  Strings that look like special tokens are
    ordinary text.  Rows keep null and repeated ids; other columns aren't read.  ``chunk`` must exceed twice ``overlap``.
    """
    if chunk <= 2 * overlap:
        raise ValueError("chunk must exceed twice overlap")
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, done, ids = b.column(1).to_pylist(), 0, []

            def sent() -> pa.RecordBatch:
                offsets = np.fromiter(accumulate(map(len, ids), initial=0), np.int32)  # noqa: B023
                flat = np.fromiter(chain.from_iterable(ids), np.int32, offsets[-1])  # noqa: B023
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                return pa.RecordBatch.from_arrays([b.column(0).slice(done, len(ids)), lists], names=["id", "ids"])  # noqa: B023

            held = 0
            for t in texts:
                ids.append(ids_of(t, path, chunk, overlap))
                held += len(ids[-1])
                if held > HELD or len(ids) >= 1024:  # bounds the ids held at once
                    yield sent()
                    done, held, ids = done + len(ids), 0, []
            if ids:
                yield sent()

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def token_counts(df: DataFrame, columns: list[str], text_col: str, path: str = VOCABULARY) -> DataFrame:
    """``columns`` and n_tokens of the text; 0 for null and empty texts."""
    rows = df.select(*columns, F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(path)
        for b in batches:
            n = [sum(len(known[p]) for part in pre_tokens(t) for p in part) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*columns, "n_tokens"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(run, f"{kinds}, n_tokens bigint")
