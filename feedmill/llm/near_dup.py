"""Near-duplicate records by covering locality-sensitive hashing.

Each distinct text is sketched as ``7 * groups`` min-wise values.  A group of seven values is read through seven structured
masks: mask v (1..7) keeps value i (1..7) where the bits of ``i & v`` have odd parity, so each mask keeps four values and
drops the three of a line of the Fano plane.  Any two values that differ lie on one line, hence two sketches that differ
in at most two of the seven places of a group collide in one of its seven tables, with certainty; by the pigeonhole
principle every pair within radius ``3 * groups - 1`` of the whole sketch collides in some table.  An exact comparison of
the shingle sets follows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..scratch import written
from . import textops as T

#: A run of equal keys longer than this is split into blocks of this many rows, compared pair of blocks by pair of blocks.
BLOCK = 2048


def covering_masks() -> list[list[int]]:
    """For each v in 1..7 the places 0..6 that the mask keeps."""
    return [[i - 1 for i in range(1, 8) if bin(i & v).count("1") % 2] for v in range(1, 8)]


def groups_for(threshold: float, miss: float = 0.005) -> int:
    """The number of groups of seven values with which a pair exactly at ``threshold`` is missed with probability ``miss``."""
    differ = [math.comb(7, k) * (1 - threshold) ** k * threshold ** (7 - k) for k in range(8)]
    hit = differ[0] + differ[1] + differ[2] + differ[3] / 5  # 7 of the 35 sets of three places are lines
    return max(1, math.ceil(math.log(miss) / math.log(1 - hit)))


def _sketch(df: DataFrame, words: int, min_words: int, groups: int) -> DataFrame:
    """id, copy (hash of the word sequence), b0, b1 (bit sketch), keys, mins (eight bits of each value); rows with fewer words or no shingle are left out."""
    hasher, masks = T.MinHash(max(64, 7 * groups)), covering_masks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies, mins = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = T.words_of(text)
                if len(w) < max(min_words, words):
                    continue
                h = T.word_hashes(w)
                ids.append(i)
                copies.append(T.order_hash(h))
                mins.append(hasher(T.shingles(h, words)))
            if not ids:
                continue
            m = np.array(mins)
            keys = np.empty((len(ids), 7 * groups), np.int64)
            for g in range(groups):
                for v, keep in enumerate(masks):
                    keys[:, 7 * g + v] = T.combine([m[:, 7 * g + i] for i in keep], 7 * g + v + 1)
            bits = T.bit_sketch(m)
            low = [x.tobytes() for x in (T.mix(m.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)]
            offsets = np.arange(0, keys.size + 1, 7 * groups, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(np.array(copies, np.uint64).view(np.int64)), pa.array(bits[:, 0]), pa.array(bits[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())), pa.array(low, pa.binary())],
                names=["id", "copy", "b0", "b1", "keys", "mins"],
            )

    return df.mapInArrow(run, "id bigint, copy bigint, b0 bigint, b1 bigint, keys array<bigint>, mins binary")


def _shingle_table(df: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [T.shingles(T.word_hashes(T.words_of(t)), words).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return df.mapInArrow(run, "id bigint, shingles array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """The pairs (id_a, id_b) of ``pairs`` whose exact overlap reaches ``threshold``; texts: id, text."""
    ids = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    sets = written(_shingle_table(texts.join(ids, "id", "left_semi"), words), "shingles")
    a, b = sets.toDF("id_a", "sa"), sets.toDF("id_b", "sb")
    both = F.size(F.array_intersect("sa", "sb"))
    overlap = both / (F.size("sa") + F.size("sb") - both)
    return pairs.join(a, "id_a").join(b, "id_b").where(F.size("sa") > 0).select("id_a", "id_b", overlap.alias("overlap")).where(F.col("overlap") >= threshold)


def likely(pairs: DataFrame, sketches: DataFrame, threshold: float, sigmas: float = 3.5) -> DataFrame:
    """The pairs (id_a, id_b) whose min-wise values, eight bits of each, agree about as often as an overlap of ``threshold`` lets expect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("ma", "mb"))
                n = x.shape[1]
                keep = (x == y).sum(axis=1) >= n * threshold - sigmas * math.sqrt(n * threshold * (1 - threshold))
                yield b.select(["id_a", "id_b"]).filter(pa.array(keep))

    a, b = sketches.select("id", "mins").toDF("id_a", "ma"), sketches.select("id", "mins").toDF("id_b", "mb")
    return pairs.join(a, "id_a").join(b, "id_b").select("id_a", "id_b", "ma", "mb").mapInArrow(run, "id_a bigint, id_b bigint")


def _within(ids: np.ndarray, bits: np.ndarray, pairs: np.ndarray, least: int) -> np.ndarray:
    """Of index pairs (n, 2) those whose sketches agree in at least ``least`` of 64 values, as id pairs, smaller first."""
    x = bits[pairs[:, 0]] ^ bits[pairs[:, 1]]
    p = pairs[64 - np.bitwise_count(x[:, 0] | x[:, 1]).astype(np.int64) >= least]
    a, b = ids[p[:, 0]], ids[p[:, 1]]
    return np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)


def _cells(ids: np.ndarray, bits: np.ndarray, left: np.ndarray, right: np.ndarray, least: int) -> Iterator[np.ndarray]:
    """Id pairs, smaller first, of the places ``left`` with the places ``right`` whose sketches agree, in tiles of bounded size."""
    for k in range(0, len(left), 256):
        i, j = (x.ravel() for x in np.meshgrid(left[k : k + 256], right, indexing="ij"))
        pairs = np.stack([i, j], axis=1)[ids[i] != ids[j]]
        if len(pairs):
            yield _within(ids, bits, pairs, least)


def _batch(pairs: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    empty = np.r_[np.zeros(len(pairs), bool), np.ones(len(hot), bool)]
    a, b = np.r_[pairs[:, 0], hot], np.r_[pairs[:, 1], np.zeros(len(hot), np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=empty)], names=["id_a", "id_b"])


def _collisions(batches: Iterator[pa.RecordBatch], least: int, block: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of rows (key, id, b0, b1) that lie in the order of their keys; a key with more than ``block`` rows goes out whole, as (key, null).

    The rows are streamed: no more than a batch and one group, of ``block`` rows at most, are held; a group beyond that is skipped.
    """
    columns = ("key", "id", "b0", "b1")
    held = [np.empty(0, np.int64)] * 4
    passing = None  # the hot key whose rows are going by
    none = np.empty(0, np.int64)

    def solved(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, ids = rows[0], rows[1]
        if not len(key):
            return
        bits = np.stack(rows[2:], axis=1).view(np.uint64)
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        length = np.diff(np.r_[start, len(key)])
        found = []
        for n in np.unique(length[(length > 1) & (length <= block)]):
            at = start[length == n]
            i, j = np.triu_indices(n, 1)
            for k in range(0, len(at), step := max(1, 1_000_000 // len(i))):
                s = at[k : k + step, None]
                found.append(_within(ids, bits, np.stack([(s + i).ravel(), (s + j).ravel()], axis=1), least))
        got = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        yield _batch(got, key[start[length > block]])

    for b in batches:
        rows = [b.column(c).to_numpy() for c in columns]
        if passing is not None:
            keep = rows[0] != passing
            rows = [x[keep] for x in rows]
        rows = [np.concatenate([h, x]) for h, x in zip(held, rows)]
        if not len(rows[0]):
            continue
        passing = None
        last = int(np.searchsorted(rows[0], rows[0][-1], "left"))  # its group may go on in the next batch
        yield from solved([x[:last] for x in rows])
        held = [x[last:] for x in rows]
        if len(held[0]) > block:
            passing = held[0][0]
            yield _batch(np.empty((0, 2), np.int64), held[0][:1])
            held = [none] * 4
    yield from solved(held)


def _blocks(keys: DataFrame, hot: DataFrame, least: int, width: int) -> DataFrame:
    """Candidate pairs of the hot keys: rows go to blocks by a hash, and each pair of blocks is a task's group of its own."""
    rows = keys.join(hot, "key", "left_semi")
    size = rows.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / width)).alias("n"))
    rows = rows.join(size, "key").withColumn("block", F.pmod(F.xxhash64("id"), "n"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
    rows = rows.select("key", "id", "b0", "b1", "block", other)
    rows = rows.select("key", "id", "b0", "b1", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cell = [], None

        def solved() -> Iterator[pa.RecordBatch]:
            ids, b0, b1, block = (np.concatenate(x) for x in zip(*held))
            bits = np.stack([b0, b1], axis=1).view(np.uint64)
            left, right = np.flatnonzero(block == cell[1]), np.flatnonzero(block == cell[2])
            for found in _cells(ids, bits, left, right, least):
                yield _batch(found, np.empty(0, np.int64))

        for b in batches:
            of = np.stack([b.column(c).to_numpy() for c in ("key", "lo", "hi")], axis=1)
            values = [b.column(c).to_numpy() for c in ("id", "b0", "b1", "block")]
            ends = np.r_[np.flatnonzero((of[1:] != of[:-1]).any(axis=1)) + 1, len(of)] if len(of) else []
            at = 0
            for end in ends:
                if cell is not None and tuple(of[at]) != cell:
                    yield from solved()
                    held = []
                cell = tuple(of[at])
                held.append([v[at:end] for v in values])
                at = end
        if held:
            yield from solved()

    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "id_a bigint, id_b bigint")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, words: int = 5, threshold: float = 0.8, min_words: int = 0, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Pairs of similar distinct texts, and the members of each class of exact copies.

    Returns (pairs, copies): ``pairs`` (id_a, id_b, overlap), id_a < id_b, between the rows with the smallest id of their
    class of exact copies (the same word sequence); ``copies`` (rep, id), one row for each further member of a class.
    Rows with a null id, null or empty text, fewer than ``min_words`` words or no sequence of ``words`` words are in
    neither.  Repeated ids count as copies of one another and aren't paired.  Other columns of ``df`` are not read.
    """
    texts = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    groups = groups_for(threshold)
    least = T.least_agreement(threshold)
    sketch = written(_sketch(texts, words, min_words, groups), "sketch")
    classes = sketch.groupBy("copy").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    copies = written(sketch.select("copy", "id").join(classes, "copy").where("id <> rep").select("rep", "id").distinct(), "copies")
    reps = sketch.join(copies.select("id"), "id", "left_anti")
    keys = reps.select(F.explode("keys").alias("key"), "id", "b0", "b1")
    # a million keys for each task, however many there are
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sketch.count() * 7 * groups // 1_000_000))
    raw = written(keys.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lambda it: _collisions(it, least, block), "id_a bigint, id_b bigint"), "candidates")
    hot = raw.where("id_b is null").select(F.col("id_a").alias("key")).distinct()
    found = raw.where("id_b is not null")
    if not raw.where("id_b is null").isEmpty():
        found = found.union(_blocks(keys, hot, least, block))
    close = written(likely(found.where("id_a < id_b").distinct(), sketch, threshold).distinct(), "likely")
    pairs = verified(close, texts, words, threshold)
    return pairs.groupBy("id_a", "id_b").agg(F.max("overlap").alias("overlap")), copies  # one row, even where ids repeat


def near_duplicate_groups(pairs: DataFrame, copies: DataFrame, rounds: int = 30) -> DataFrame:
    """id, group_id: connected records get the smallest id among them.

    Alternating large-star and small-star steps; each round is written to the shared folder.  Copies join the group of
    their representative.  Raises if the components haven't settled after ``rounds`` rounds.
    """
    edges = written(pairs.select(F.greatest("id_a", "id_b").alias("u"), F.least("id_a", "id_b").alias("v")).distinct(), "edges")
    if not edges.isEmpty():
        for _ in range(rounds):
            both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
            new = written(small, "edges")
            same = new.count() == edges.count() and new.exceptAll(edges).isEmpty()
            edges = new
            if same:
                break
        else:
            raise RuntimeError("components haven't settled")
    groups = edges.select(F.col("u").alias("id"), F.col("v").alias("group_id"))
    heads = edges.select(F.col("v").alias("id"), F.col("v").alias("group_id")).distinct()
    groups = groups.union(heads)
    lone = copies.select("rep").distinct().join(groups, F.col("rep") == F.col("id"), "left_anti").select(F.col("rep").alias("id"), F.col("rep").alias("group_id"))
    groups = groups.union(lone)
    return groups.union(copies.join(groups.toDF("rep", "group_id"), "rep").select("id", "group_id")).distinct()


def with_copies(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """(id_a, id_b): ``pairs``, each representative with each of its copies, and each copy with the texts similar to it.

    Rows grow with the number of copies, not with its square: two copies of one class are linked through the representative.
    """
    links = pairs.select("id_a", "id_b")
    ends = links.union(links.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
    more = copies.join(ends, F.col("rep") == F.col("id_a")).select("id", "id_b").union(copies.select("id", "rep"))
    more = more.toDF("x", "y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return links.union(more).distinct()
