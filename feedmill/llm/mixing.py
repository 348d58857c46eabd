"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The documents of a source, in a seeded random order, are cut into blocks of about equal token counts.  Seats of the mixture go, one
block after the other, to the source with the highest quotient target / (tokens so far + half its next block), which for blocks
of one size is Sainte-Lague's target / (2 seats + 1).  The sequence of seats, cut into shards, gives each source an integer quota
in each shard; which block takes a seat is decided by a seeded order of the source's blocks, a new one in each repeat.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window, functions as F

from ..scratch import written
from .encode import VOCABULARY, token_counts


def apportion(sources: list[dict], total: float) -> list[tuple[str, int]]:
    """Seats (source, number of the seat within the source) until ``total`` tokens are reached or all sources are exhausted.

    sources: name, target, blocks (tokens of each, in the order of taking), repeats.  Targets that are null, not above 0, or
    whose source has no tokens, get no seat.  Equal quotients go to the name that sorts first.
    """
    heap, by_name = [], {s["name"]: s for s in sources}

    def push(name: str, seat: int, got: float) -> None:
        s = by_name[name]
        if seat < len(s["blocks"]) * s["repeats"]:
            heapq.heappush(heap, (-s["target"] / (got + s["blocks"][seat % len(s["blocks"])] / 2), name, seat, got))

    for s in sources:
        if s["target"] and s["target"] > 0 and sum(s["blocks"]) > 0:
            push(s["name"], 0, 0.0)
    seats, have = [], 0.0
    while heap and have < total:
        _, name, seat, got = heapq.heappop(heap)
        blocks = by_name[name]["blocks"]
        tokens = blocks[seat % len(blocks)]
        seats.append((name, seat))
        have += tokens
        push(name, seat + 1, got + tokens)
    return seats


def level(sources: list[tuple[float, float]], total: float) -> float:
    """Tokens per unit of target at which sources (target, tokens at most), filled alike, hold ``total`` together; inf if they can't."""
    left, targets = total, sum(t for t, _ in sources)
    for target, most in sorted(sources, key=lambda s: s[1] / s[0]):
        if most / target * targets >= left:
            return left / targets
        left, targets = left - most, targets - target
    return math.inf


def mix(
    documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, blocks: int = 4096, shards: int = 16, seed: int = 7, bucket_rows: int = 20_000, path: str = VOCABULARY
) -> tuple[DataFrame, DataFrame]:
    """Returns (mixture, shares).

    documents: doc_id, source, text; targets: source, target_share, max_repeats (a small control table, one row per source).
    mixture: doc_id, source, n_tokens, shard, repeat_no (0-based): one row for each time a document is taken.
    shares: source, target_share, actual_share, tokens, available_tokens, documents, blocks, seats, max_repeats, capped.

    total_tokens: the size of the mixture; by default the largest at which every targeted source that has any text reaches its
    share within its repeats.  With a larger total, sources that reach max_repeats are marked capped and the others fill the
    rest.  ``blocks`` is about the number of seats of the mixture (fewer where documents are larger than total / blocks), so the
    driver holds a table of about that size, however large the corpus is and however scarce a source.  Documents of null or
    empty text, of a null source or of one without target are not taken.  Ids may repeat; equal ids are ordered by their token counts.
    """
    spark = documents.sparkSession
    rows = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    wanted = documents.join(rows.select("source"), "source", "left_semi").where(F.length("text") > 0)
    counted = written(token_counts(wanted, ["doc_id", "source"], "text", path).withColumn("at", F.xxhash64(F.lit(seed), "doc_id")), "tokens")
    n = counted.count()
    parts = max(1, -(-n // bucket_rows))
    counted = counted.withColumn("bucket", F.floor(F.shiftrightunsigned("at", 33) * parts / 2**31).cast("int"))
    sums = counted.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"))
    sizes = counted.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("d"), F.max("n_tokens").alias("m"))
    have = {r["source"]: (r["t"], r["d"], r["m"]) for r in sizes.collect()}
    plan = [{"name": r["source"], "target": r["target_share"], "repeats": max(0, r["max_repeats"] or 0), "tokens": have.get(r["source"], (0, 0, 0))[0]} for r in rows.collect()]
    usable = [s for s in plan if s["target"] and s["target"] > 0 and s["repeats"] and s["tokens"] > 0]
    asked = sum(s["target"] for s in usable)
    total = total_tokens or min((s["tokens"] * s["repeats"] * asked / s["target"] for s in usable), default=0)
    total = min(total, sum(s["tokens"] * s["repeats"] for s in usable))
    size = max(total / blocks, 1)  # of the mixture, not of all text: a scarce source makes the blocks of the large ones small too
    n_blocks = {s: max(1, min(d, round(t / size))) for s, (t, d, _) in have.items()}
    cuts = spark.createDataFrame([(s, t, n_blocks[s]) for s, (t, _, _) in have.items()], "source string, all_tokens bigint, n_blocks int")
    inside = Window.partitionBy("source", "bucket").orderBy("at", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.join(sums, ["source", "bucket"]).withColumn("start", F.col("offset") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    block = F.least(F.floor(F.col("start") / F.col("all_tokens") * F.col("n_blocks")), F.col("n_blocks") - 1).cast("int")
    placed = written(placed.join(F.broadcast(cuts), "source").select("doc_id", "source", "n_tokens", block.alias("block")), "placed")
    # A source takes a block only while it is below the level of all, give or take half a block of each; blocks after that aren't collected.
    slack = sum(have[s["name"]][0] / n_blocks[s["name"]] + have[s["name"]][2] for s in usable) / 2
    top = level([(s["target"], s["tokens"] * s["repeats"]) for s in usable], total + slack)
    limits = [(s["name"], float(min(total, s["target"] * top)), -(-n_blocks[s["name"]] // 64)) for s in usable]
    limits = spark.createDataFrame(limits, "source string, limit double, slices int")
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "source", "block"), 1)
    held = placed.join(F.broadcast(limits), "source").withColumn("o", order).withColumn("slice", F.floor(F.shiftright("o", 32) * F.col("slices") / 2**31).cast("int"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = held.groupBy("source", "slice", "limit").agg(F.sum("n_tokens").alias("in_slice")).withColumn("before", F.coalesce(F.sum("in_slice").over(earlier), F.lit(0)))
    held = held.join(slices.where(F.col("before") < F.col("limit")).select("source", "slice"), ["source", "slice"])
    held = held.groupBy("source", "block", "o").agg(F.sum("n_tokens").alias("t")).orderBy("source", "o", "block").collect()  # about `blocks` rows, and a slice of 64 for each source
    by_source: dict[str, list] = {}
    for r in held:
        by_source.setdefault(r["source"], []).append((r["block"], float(r["t"])))
    for s in usable:
        s["blocks"] = [t for _, t in by_source[s["name"]]]
    seats = apportion(usable, total)
    per_shard = max(1, -(-len(seats) // shards))
    chosen = [(s, by_source[s][k % len(by_source[s])][0], k // len(by_source[s]), i // per_shard) for i, (s, k) in enumerate(seats)]
    # bounded: a row for each seat of the plan, which the driver holds anyway, and above one for each targeted source
    taken = spark.createDataFrame(chosen, "source string, block int, repeat_no int, shard int")
    mixture = placed.join(F.broadcast(taken), ["source", "block"]).select("doc_id", "source", "n_tokens", "shard", "repeat_no")
    got = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("t")).join(F.broadcast(taken), ["source", "block"]).groupBy("source").agg(F.sum("t").alias("tokens"), F.count("*").alias("seats"))
    shares = rows.join(got, "source", "left").join(cuts, "source", "left").join(counted.groupBy("source").agg(F.count("*").alias("documents")), "source", "left")
    zero = F.lit(0).cast("bigint")
    everything = Window.partitionBy(F.lit(0))  # over the control table
    shares = shares.select("source", "target_share", F.coalesce("tokens", zero).alias("tokens"), F.coalesce("all_tokens", zero).alias("available_tokens"), F.coalesce("documents", zero).alias("documents"), F.coalesce("n_blocks", F.lit(0)).alias("blocks"), F.coalesce("seats", zero).alias("seats"), "max_repeats")
    whole = F.sum("tokens").over(everything)
    shares = shares.withColumn("actual_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(F.lit(0.0))).withColumn(
        "capped", (F.col("available_tokens") > 0) & (F.col("tokens") >= F.col("available_tokens") * F.coalesce("max_repeats", F.lit(0)))
    )
    return mixture, shares.select("source", "target_share", "actual_share", "tokens", "available_tokens", "documents", "blocks", "seats", "max_repeats", "capped")
