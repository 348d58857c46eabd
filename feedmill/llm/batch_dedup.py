"""Deduplicating new batches against all history by multi-key sorted-neighbourhood runs.

Each distinct text has ``tables`` sort keys.  A key is made of three min-wise values of the text's shingles, the first in its
highest bits, so that records next to each other in the order of the keys share the leading values; the content hash gives one
key more.  Accepted records are kept as runs under a path: the records (key, id, sketch) of a run are sorted and cut into pages,
and the key space is cut into ranges that are the same for all runs.  A batch is sketched, sorted and written as a run of its
own; then its pages are merged with those pages of each run whose ranges and limits meet theirs.  The window around a new record
is the stretch of older records with its whole key; they lie in the order of their ids there, and are compared through a sketch
of 64 two-bit values.  Nothing of a run is shuffled, sorted or rewritten for a batch, ranges without a new key aren't read, and
the texts of the history aren't needed but for the candidates.  Runs are compacted by tiers of size: as soon as ``fan`` runs of
one tier stand, they are merged, so that a record is rewritten a logarithmic number of times and a small batch moves no large run.

A window gives its first candidates only, as the smallest id is asked for.  Where they all fail the exact comparison, or one of
another window with a smaller id might be missing, the window is read again in full, so nothing is lost; a family of
near-copies that holds a large part of all rows then costs a few comparisons for each new record, not one for each pair.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from .. import scratch
from ..scratch import written
from . import textops as T
from .near_dup import likely, verified

SKETCH = "id bigint, tag int, copy bigint, b0 bigint, b1 bigint, keys array<bigint>, mins binary, hash string"
PAGE = "part int, lo bigint, hi bigint, first bigint, keys binary, ids binary, bits binary"
#: Records of a page; a page is the unit of a merge and the most that one step of it holds of a run.
PAGE_ROWS = 8192
#: Candidates that a window gives at first.
FIRST = 16


def hash_key(content_hash):
    """A content hash in one spelling (lower case, no white space, no algorithm prefix); null for null or empty."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(content_hash, r"\s+", "")), r"^[a-z0-9-]+:", "")
    return F.when(plain != "", plain)


def sort_keys(mins: np.ndarray, tables: int) -> np.ndarray:
    """(rows, tables) of signed 64-bit keys: 26 bits of a first min-wise value, then 19 of a second and 19 of a third."""
    out = np.empty((len(mins), tables), np.int64)
    for t in range(tables):
        a, b, c = (T.combine([mins[:, 3 * t + i]], 3 * t + i + 1).view(np.uint64) for i in range(3))
        key = (a >> np.uint64(38) << np.uint64(38)) | (b >> np.uint64(45) << np.uint64(19)) | (c >> np.uint64(45))
        out[:, t] = key.view(np.int64)
    return out


def _sketch(df: DataFrame, words: int, tables: int) -> DataFrame:
    hasher = T.MinHash(max(64, tables * 3), seed=2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            copies, mins, has = [], [], np.zeros(n, bool)
            for k, text in enumerate(batch.column(1).to_pylist()):
                w = T.words_of(text)
                if len(w) < words:
                    continue
                has[k] = True
                h = T.word_hashes(w)
                copies.append(T.order_hash(h))
                mins.append(hasher(T.shingles(h, words)))
            copy, bits, counts = np.zeros(n, np.int64), np.zeros((n, 2), np.int64), np.where(has, tables, 0)
            keys, low = np.empty(0, np.int64), np.full(n, None, object)
            if mins:
                m = np.array(mins)
                copy[has] = np.array(copies, np.uint64).view(np.int64)
                bits[has] = T.bit_sketch(m)
                low[has] = [x.tobytes() for x in (T.mix(m.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)]
                keys = sort_keys(m, tables).ravel()
            offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
            columns = [
                batch.column(0), batch.column(3), pa.array(copy, mask=~has), pa.array(bits[:, 0]), pa.array(bits[:, 1]),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys)), pa.array(low, pa.binary()), batch.column(2),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "tag", "copy", "b0", "b1", "keys", "mins", "hash"])

    return df.mapInArrow(run, SKETCH)


def _planes(x: np.ndarray) -> bytes:
    """64-bit integers by byte planes, which compress where neighbours are alike."""
    return np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(len(x), 8).T).tobytes()


def _unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _page(part: int, keys: np.ndarray, ids: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
    """A page of records sorted by (key, id); keys are stored as differences."""
    row = [part, int(keys[0]), int(keys[-1]), int(ids[0]), _planes(np.diff(keys, prepend=np.int64(0))), _planes(ids), bits.tobytes()]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=["part", "lo", "hi", "first", "keys", "ids", "bits"])


def _records(keys: bytes, ids: bytes, bits: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return np.cumsum(_unplaned(keys)), _unplaned(ids), np.frombuffer(bits, np.int64).reshape(-1, 2)


def _packed(rows: DataFrame) -> DataFrame:
    """Pages of rows (part, key, id, b0, b1) that lie sorted in their partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        part, count = None, 0

        def pages(last: bool) -> Iterator[pa.RecordBatch]:
            keys, ids, bits = (np.concatenate(x) for x in zip(*held))
            end = len(keys) if last else len(keys) - len(keys) % PAGE_ROWS
            for k in range(0, end, PAGE_ROWS):
                s = slice(k, min(k + PAGE_ROWS, end))
                yield _page(part, keys[s], ids[s], bits[s])
            held[:] = [(keys[end:], ids[end:], bits[end:])] if end < len(keys) else []

        for b in batches:
            of, keys, ids = (b.column(c).to_numpy() for c in ("part", "key", "id"))
            bits = np.stack([b.column("b0").to_numpy(), b.column("b1").to_numpy()], axis=1)
            for s in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1) if len(of) else []:
                if part is not None and of[s[0]] != part:
                    yield from pages(True) if held else ()
                    count = 0
                part = int(of[s[0]])
                held.append((keys[s], ids[s], bits[s]))
                count += len(s)
                if count >= 4 * PAGE_ROWS:
                    yield from pages(False)
                    count = sum(len(k) for k, _, _ in held)
        if held:
            yield from pages(True)

    return rows.mapInArrow(run, PAGE)


def _merged(pages: DataFrame) -> DataFrame:
    """Pages of several runs, sorted by (part, lo, first) in their partitions, as pages of one run; the pages are streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, None

        def cut(k: int, last: bool) -> Iterator[pa.RecordBatch]:
            """The first k records as pages, whole ones unless it is the end; the rest is held."""
            nonlocal held
            keys, ids, bits = held
            k = k if last else k - k % PAGE_ROWS
            for at in range(0, k, PAGE_ROWS):
                s = slice(at, min(at + PAGE_ROWS, k))
                yield _page(part, keys[s], ids[s], bits[s])
            held = (keys[k:], ids[k:], bits[k:])

        for b in batches:
            for p, lo, first, *packed in zip(*(b.column(c).to_pylist() for c in ("part", "lo", "first", "keys", "ids", "bits"))):
                new = _records(*packed)
                if held is not None and p != part:
                    yield from cut(len(held[0]), True)
                    held = None
                part = p
                if held is None:
                    held = new
                    continue
                a, z = np.searchsorted(held[0], lo, "left"), np.searchsorted(held[0], lo, "right")
                yield from cut(int(a + np.searchsorted(held[1][a:z], first)), False)
                keys, ids, bits = (np.concatenate(x) for x in zip(held, new))
                order = np.lexsort((ids, keys))
                held = (keys[order], ids[order], bits[order])
        if held is not None:
            yield from cut(len(held[0]), True)

    return pages.mapInArrow(run, PAGE)


def _window(new: tuple[np.ndarray, ...], old: tuple[np.ndarray, ...], least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(new_id, old_id, more) of the older records with the keys of the new ones whose sketches agree in ``least`` places or more.

    Each new record gives its first ``most`` in the order of their ids; ``more`` stands at the last of them if others follow.
    """
    (nk, ni, nb), (ok, oi, ob) = new, old
    lo, hi = np.searchsorted(ok, nk, "left"), np.searchsorted(ok, nk, "right")
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    length = hi - lo

    def agreeing(n: np.ndarray, o: np.ndarray) -> np.ndarray:
        x = (nb[n] ^ ob[o]).view(np.uint64)
        return (oi[o] < ni[n]) & (64 - np.bitwise_count(x[:, 0] | x[:, 1]).astype(np.int64) >= least)

    short = np.flatnonzero((length > 0) & (length <= 256))
    steps = np.r_[0, np.flatnonzero(np.diff(np.cumsum(length[short]) // 1_000_000)) + 1, len(short)]
    for a, z in zip(steps, steps[1:]):
        n = np.repeat(short[a:z], length[short[a:z]])
        if len(n):
            begin = np.repeat(np.r_[0, np.cumsum(length[short[a:z]])[:-1]], length[short[a:z]])
            o = lo[n] + np.arange(len(n)) - begin
            keep = agreeing(n, o)
            n, o = n[keep], o[keep]
            rank = np.arange(len(n)) - np.searchsorted(n, n, "left")
            more = (rank == most - 1) & (np.searchsorted(n, n, "right") - np.searchsorted(n, n, "left") > most)
            found.append((ni[n[rank < most]], oi[o[rank < most]], more[rank < most]))
    for k in np.flatnonzero(length > 256):  # read in the order of the ids until enough are found
        got: list[np.ndarray] = []
        for at in range(lo[k], hi[k], 4096):
            o = np.arange(at, min(at + 4096, hi[k]))
            got.append(o[agreeing(np.full(len(o), k), o)])
            if sum(map(len, got)) > most or oi[o[-1]] >= ni[k]:
                break
        o = np.concatenate(got)
        more = np.zeros(min(len(o), most), bool)
        more[-1:] = len(o) > most
        found.append((np.full(len(more), ni[k]), oi[o[:most]], more))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))


def _neighbours(new: DataFrame, old: DataFrame, ranges: int, least: int, most: int) -> DataFrame:
    """(new_id, old_id, kind, more) of the pages of a batch merged with those of a run, both bucketed by part."""
    n = new.select("part", *(F.col(c).alias(f"n_{c}") for c in ("lo", "hi", "keys", "ids", "bits"))).hint("shuffle_hash")
    pairs = n.join(old, "part").where((F.col("n_lo") <= F.col("hi")) & (F.col("lo") <= F.col("n_hi")))
    columns = ("part", "n_keys", "n_ids", "n_bits", "keys", "ids", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, *packed in zip(*(b.column(c) for c in columns)):
                packed = [x.as_py() for x in packed]
                kind = int(part.as_py() >= ranges)  # a hash has no sketch, and its first record is the earliest
                got = _window(_records(*packed[:3]), _records(*packed[3:]), 0 if kind else least, 1 if kind else most)
                if len(got[0]):
                    flag = np.zeros(len(got[2]), bool) if kind else got[2]
                    columns_ = [pa.array(got[0]), pa.array(got[1]), pa.array(np.full(len(flag), kind, np.int32)), pa.array(flag)]
                    yield pa.RecordBatch.from_arrays(columns_, names=["new_id", "old_id", "kind", "more"])

    return pairs.select(*columns).mapInArrow(run, "new_id bigint, old_id bigint, kind int, more boolean")


class HistoryIndex:
    """Runs of accepted records under ``path``.  ``take`` takes records in; ``check`` compares a batch with the runs and takes it in.

    Input tables have id, text and hash (content hash); ids rise with arrival.  Null ids are left out; null or empty texts, and
    texts of fewer than ``words`` words, are compared by hash only; null hashes by text only.  Other columns aren't read.
    ``open`` gives the index back in another session.  ``reads`` has a line for each batch: runs and bytes that were read for it.
    """

    def __init__(
        self, spark: SparkSession, path: str, words: int = 5, threshold: float = 0.8, miss: float = 0.015, ranges: int = 64, fan: int = 4, buckets: int | None = None
    ) -> None:
        if ranges < 2 or ranges & (ranges - 1):
            raise ValueError("the number of ranges must be a power of two")
        self.spark, self.path, self.words, self.threshold, self.ranges, self.fan = spark, path.rstrip("/"), words, threshold, ranges, fan
        self.tables = max(1, math.ceil(math.log(miss) / math.log(1 - threshold**3)))
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.least = T.least_agreement(threshold, 2.75)
        self.runs: list[dict] = []
        self.reads: list[dict] = []

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> HistoryIndex:
        """The index that was kept under ``path``."""
        text = scratch.get_text(spark, f"{path.rstrip('/')}/index.json")
        if text is None:
            raise FileNotFoundError(path)
        kept = json.loads(text)
        index = cls(spark, path, kept["words"], kept["threshold"], ranges=kept["ranges"], fan=kept["fan"], buckets=kept["buckets"])
        index.tables, index.least, index.runs = kept["tables"], kept["least"], kept["runs"]
        return index

    def _save(self, gone: list[dict] = ()) -> None:
        kept = {k: getattr(self, k) for k in ("words", "threshold", "ranges", "fan", "buckets", "tables", "least", "runs")}
        scratch.put_text(self.spark, f"{self.path}/index.json", json.dumps(kept))
        for r in gone:  # no manifest names them any more
            self.spark.sql(f"drop table if exists {r['name']}")
            scratch.remove(self.spark, f"{self.path}/{r['name']}")

    def _pages(self, run: dict) -> DataFrame:
        if not self.spark.catalog.tableExists(run["name"]):  # another session
            self.spark.sql(
                f"create table {run['name']} ({PAGE}) using parquet options (path '{self.path}/{run['name']}') clustered by (part) into {self.buckets} buckets"
            )
        return self.spark.table(run["name"])

    def _write_run(self, pages: DataFrame) -> dict:
        """The run's name, bytes, parts that hold records (bits of 32, noted while they are written), and its tier by its size."""
        run = {"name": f"run_{uuid.uuid4().hex}"}
        path = f"{self.path}/{run['name']}"
        seen = Observation()
        bit = F.expr("shiftleft(1L, part % 32)")
        masks = [F.bit_or(F.when(F.floor(F.col("part") / 32) == w, bit).otherwise(0)).alias(str(w)) for w in range(max(1, self.ranges // 16))]
        out = pages.observe(seen, *masks).write.bucketBy(self.buckets, "part").sortBy("part", "lo", "first")
        out.option("path", path).option("compression", "zstd").saveAsTable(run["name"])
        parts = [32 * int(w) + k for w, mask in seen.get.items() for k in range(32) if (mask or 0) >> k & 1]
        size = scratch.size_of(self.spark, path)
        return run | {"bytes": size, "parts": parts, "tier": max(0, math.ceil(math.log(max(1, size) / 2**20, self.fan)))}

    def sketch(self, df: DataFrame) -> DataFrame:
        """id, tag (as given, else 0), copy (hash of the word sequence, null without one), bit sketch, keys, hash."""
        tag = F.col("tag").cast("int") if "tag" in df.columns else F.lit(0)
        hash_ = hash_key(F.col("hash")).alias("hash")
        texts = df.where("id is not null").select(F.col("id").cast("bigint").alias("id"), "text", hash_, tag.alias("tag"))
        return _sketch(texts, self.words, self.tables)

    def _sorted(self, sketch: DataFrame) -> DataFrame:
        """The pages of a batch: the keys of each distinct text and hash, those of the row with the smallest id.

        Which row that is comes from pre-aggregated minima, so many copies of one text or hash make no large group.
        """
        again = sketch.where("copy is not null").groupBy("copy").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
        later = sketch.select("id", "copy").join(again, "copy").where("id <> rep").select("id")
        texts = sketch.where("copy is not null").join(later, "id", "left_anti")
        none = F.lit(0).cast("bigint")
        by_text = texts.select(F.explode("keys").alias("key"), F.lit(0).alias("kind"), "id", "b0", "b1")
        by_hash = sketch.where("hash is not null").groupBy(F.xxhash64("hash").alias("key")).agg(F.min("id").alias("id"))
        rows = by_text.union(by_hash.select("key", F.lit(1), "id", none, none))
        part = F.shiftright("key", 65 - self.ranges.bit_length()) + self.ranges // 2 + F.col("kind") * self.ranges
        rows = rows.select(part.cast("int").alias("part"), "key", "id", "b0", "b1")
        return _packed(rows.repartition(self.buckets, "part").sortWithinPartitions("part", "key", "id"))

    def take(self, sketch: DataFrame) -> None:
        """Takes accepted records in as one run, without a comparison."""
        self.runs.append(self._write_run(self._sorted(sketch)))
        self._save()
        self.compact()

    def check(self, sketch: DataFrame) -> DataFrame:
        """Candidates (new_id, old_id, kind, more), old_id < new_id, of a batch against all runs and its own earlier rows.

        new_id is the first row of the batch with its text (kind 0) or hash (kind 1).  The batch becomes a run.
        """
        before = [*self.runs]
        run = self._write_run(self._sorted(sketch))
        self.runs.append(run)
        batch = self._pages(run)
        parts = run["parts"]  # at most two for each range
        found = None
        for r in self.runs:
            old = self._pages(r)
            old = old.where(F.col("part").isin(parts)) if len(parts) < 2 * self.ranges else old
            hit = _neighbours(batch, old, self.ranges, self.least, FIRST)
            found = hit if found is None else found.union(hit)
        share = len(parts) / (2 * self.ranges)
        self.reads.append({"runs": len(before), "bytes": round(sum(r["bytes"] for r in before) * share), "batch_bytes": run["bytes"]})
        found = written(found.distinct(), "window")
        self._save()
        self.compact()
        return found

    def compact(self) -> None:
        """While ``fan`` runs of one tier (sizes within a factor of ``fan``) stand, they are merged into one."""
        while True:
            tiers: dict[int, list[dict]] = {}
            for r in self.runs:
                tiers.setdefault(r["tier"], []).append(r)
            full = next((t for t in sorted(tiers) if len(tiers[t]) >= self.fan), None)
            if full is None:
                return
            pages = self._pages(tiers[full][0])
            for r in tiers[full][1:]:
                pages = pages.union(self._pages(r))
            pages = pages.repartition(self.buckets, "part").sortWithinPartitions("part", "lo", "first")
            whole = self._write_run(_merged(pages))
            self.runs = [r for r in self.runs if r["tier"] != full] + [whole]
            self._save(tiers[full])

    def resolve(self, found: DataFrame, mins: DataFrame, texts: DataFrame, new: DataFrame) -> DataFrame:
        """(id_b, near): for each new record with a candidate that holds the smallest id that does.

        mins: id, mins of all records in question; texts: id, text, of which those of the candidates are read; new: the sketches
        of the batches.  Windows whose first candidates don't decide are read again without a limit.
        """

        def exact(pairs: DataFrame) -> DataFrame:
            pairs = pairs.select(F.col("old_id").alias("id_a"), F.col("new_id").alias("id_b")).distinct()
            pairs = written(likely(pairs, mins, self.threshold, 3.0), "likely")
            return verified(pairs, texts, self.words, self.threshold).groupBy("id_b").agg(F.min("id_a").alias("near"))

        near = exact(found.where("kind = 0"))
        cut = found.where("kind = 0 and more").groupBy(F.col("new_id").alias("id_b")).agg(F.min("old_id").alias("after"))
        if cut.isEmpty():
            return near
        near = written(near, "near")
        open_ = written(cut.join(near, "id_b", "left").where("near is null or near > after").select("id_b", "near"), "open")
        if open_.isEmpty():
            return near
        rows = new.join(open_.select(F.col("id_b").alias("id")), "id", "left_semi")
        name = self._write_run(self._sorted(rows.withColumn("hash", F.lit(None).cast("string"))))
        again = None
        for r in self.runs:
            hit = _neighbours(self._pages(name), self._pages(r), self.ranges, self.least, 1 << 62)
            again = hit if again is None else again.union(hit)
        again = again.join(open_.toDF("new_id", "near"), "new_id").where("near is null or old_id < near")
        rest = exact(again.select("new_id", "old_id").distinct())
        self._save([name])
        return near.union(rest).groupBy("id_b").agg(F.min("near").alias("near"))

    def drop(self) -> None:
        """Removes all runs and the index itself."""
        gone, self.runs = self.runs, []
        self._save(gone)
        scratch.remove(self.spark, self.path)


def repeats(history: DataFrame, batches: DataFrame, words: int = 5, threshold: float = 0.8, fan: int = 4) -> DataFrame:
    """(id_a, id_b): each row id_b of ``batches`` that repeats an earlier row, with the smallest such id_a.

    Both have id, text, hash; batches also batch (its number; rows without one form a batch that comes first).  A row repeats
    one with a smaller id, in either table, if their hashes are equal or their overlap of ``words``-word sequences is at least
    ``threshold``.  Two texts of fewer than ``words`` words have no overlap.  An empty batch table gives no rows.
    """
    spark = batches.sparkSession
    history, batches = history.select("id", "text", "hash"), batches.select("id", "text", "hash", "batch")
    index = HistoryIndex(spark, scratch.new_path(spark, "history-index"), words, threshold, fan=fan)
    arrivals = batches.withColumn("tag", F.coalesce(F.col("batch").cast("int"), F.lit(-(2**31))))
    new = written(index.sketch(arrivals), "arrivals", ["tag"])  # a folder for each batch, so that a batch reads its own
    past = written(index.sketch(history), "history")
    index.take(past)
    numbers = sorted(r[0] for r in new.select("tag").distinct().collect())  # one row for each batch
    found = spark.createDataFrame([], "new_id bigint, old_id bigint, kind int, more boolean")
    for n in numbers:
        found = found.union(index.check(new.where(F.col("tag") == n)))
    texts = history.select("id", "text").union(batches.select("id", "text"))
    texts = texts.where("id is not null").select(F.col("id").cast("bigint").alias("id"), "text")
    near = written(index.resolve(found, past.select("id", "mins").union(new.select("id", "mins")), texts, new), "near")
    index.drop()
    same = found.where("kind = 1").groupBy("new_id").agg(F.min("old_id").alias("same"))

    def earliest(column: str, hits: DataFrame, hit: str) -> DataFrame:
        """id, id_a by ``column``: of the first row of the batch with this value, what it repeats, else that row itself."""
        rows = new.where(F.col(column).isNotNull()).select("id", "tag", column)
        first = rows.groupBy("tag", column).agg(F.min("id").alias("first")).join(hits.toDF("first", hit), "first", "left")
        first = first.select("tag", column, F.coalesce(hit, "first").alias("id_a"))
        return rows.join(first, ["tag", column]).select("id", "id_a")

    both = earliest("copy", near, "near").union(earliest("hash", same, "same")).where("id_a < id")
    return both.groupBy(F.col("id").alias("id_b")).agg(F.min("id_a").alias("id_a")).select("id_a", "id_b")
