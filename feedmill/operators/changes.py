"""Changes of stored tables as functions from tables to tables; ``feedmill.operators.store`` keeps the versions."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import written

COUNTS = ["sources_checked", "items_found", "items_inserted", "items_skipped", "errors"]
SOURCE_DEFAULTS = {"priority": 100, "crawl_interval_minutes": 60, "active": True}
SOURCE_FIELDS = ["company", "product", "source_type", "official_domain", "priority", "crawl_interval_minutes", "active", "extra"]


def next_ids(new: DataFrame, stored: DataFrame, order: list[str]) -> DataFrame:
    """``new`` with a dense id above the largest stored one, numbered in ``order``.

    The rows are numbered within parts of the order and shifted by the sizes of the parts before, so no task holds them all.
    """
    top = stored.agg(F.max("id")).first()[0] or 0  # one number
    parts = new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    parts = written(parts.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    shift = sizes.withColumn("_shift", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each part
    out = parts.join(shift.select("_part", "_first", "_shift"), "_part")
    number = F.lit(top) + F.col("_shift") + F.col("_row") - F.col("_first") + 1
    return out.withColumn("id", number.cast("int")).drop("_part", "_row", "_first", "_shift")


def upsert_sources(stored: DataFrame, new: DataFrame, now: datetime, keep_active: bool = False) -> DataFrame:
    """Sources after inserting or replacing by source_url; of several new rows for one address the last (by ``seq``, if given) counts.

    All fields are replaced, missing ones by their defaults; with ``keep_active`` a stored row keeps its own flag.  New rows
    get ids in the order of their addresses.
    """
    order = [F.desc("seq")] if "seq" in new.columns else [F.desc(F.struct(*[c for c in SOURCE_FIELDS if c in new.columns and c != "extra"]))]
    one = new.where(F.col("source_url").isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy("source_url").orderBy(*order))).where("_r = 1")
    n = one.select("source_url", F.lit(True).alias("hit"), *[(F.coalesce(c, F.lit(SOURCE_DEFAULTS[c])) if c in SOURCE_DEFAULTS else F.col(c)).cast(stored.schema[c].dataType).alias(f"n_{c}") if c in new.columns else F.lit(SOURCE_DEFAULTS.get(c)).cast(stored.schema[c].dataType).alias(f"n_{c}") for c in SOURCE_FIELDS])
    joined = stored.join(n, "source_url", "left")
    hit = F.coalesce("hit", F.lit(False))
    take = lambda c: (F.col(c) if c == "active" and keep_active else F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c))).alias(c)
    kept = joined.select(*[take(c) if c in SOURCE_FIELDS else F.when(hit, F.lit(now)).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in stored.columns])
    fresh = n.join(stored.select("source_url"), "source_url", "left_anti")
    fresh = next_ids(fresh, stored, ["source_url"])
    blank = {"failure_count": F.lit(0), "created_at": F.lit(now), "updated_at": F.lit(now)}
    values = [(F.col(f"n_{c}") if c in SOURCE_FIELDS else F.col(c) if c in ("id", "source_url") else blank.get(c, F.lit(None))).cast(stored.schema[c].dataType).alias(c) for c in stored.columns]
    return kept.unionByName(fresh.select(*values))


def mark_checked(sources: DataFrame, outcomes: DataFrame, now: datetime) -> DataFrame:
    """Sources after a run; outcomes: source_id, success. Success resets the failures, failure adds one."""
    o = outcomes.groupBy("source_id").agg(F.min("success").alias("ok"))
    j = sources.join(o, sources.id == o.source_id, "left").drop("source_id")
    ran = F.col("ok").isNotNull()
    return j.select(*[
        F.when(ran, F.lit(now)).otherwise(F.col(c)).alias(c) if c in ("last_checked_at", "updated_at")
        else F.when(F.col("ok"), F.lit(now)).otherwise(F.col(c)).alias(c) if c == "last_success_at"
        else F.when(F.col("ok"), F.lit(0)).when(ran, F.col(c) + 1).otherwise(F.col(c)).cast("int").alias(c) if c == "failure_count"
        else F.col(c)
        for c in sources.columns
    ])


def set_active(sources: DataFrame, chosen: Column, now: datetime, active: bool = True) -> DataFrame:
    hit = F.coalesce(chosen, F.lit(False))
    return sources.withColumns({"updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at")), "active": F.when(hit, F.lit(active)).otherwise(F.col("active"))})


def insert_new(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` whose content_hash isn't stored and comes first (by source_rank, entry_pos) among the new ones."""
    return first_seen(new).join(stored.select("content_hash"), "content_hash", "left_anti")


def first_seen(new: DataFrame, order: tuple[str, ...] = ("source_rank", "entry_pos")) -> DataFrame:
    """One row per content_hash, the earliest in arrival order; rows without a hash are left out.

    The earliest row is kept while the rows are aggregated, before the shuffle as after it, so repeats of one hash make no large
    group and what the rows are computed from is computed once.
    """
    names = new.columns
    first = F.min_by(F.struct(*names), F.struct(*order)).alias("_row")
    # counted, as a filter on the hash itself would be pushed below it and compute it again
    rows = new.groupBy(F.col("content_hash").alias("_hash")).agg(first, F.count("content_hash").alias("_n")).where("_n > 0")
    return rows.select("_row.*")


def apply_enrichment(items: DataFrame, updates: DataFrame, now: datetime) -> DataFrame:
    """Items with the columns of ``updates`` (by id) in place of their own."""
    columns = ["title_ar", "title_en", "summary_ar", "summary_en", "category", "tags", "impact_level", "status"]
    u = updates.select("id", F.lit(True).alias("hit"), *[F.col(c).alias(f"u_{c}") for c in columns])
    j, hit = items.join(u, "id", "left"), F.coalesce("hit", F.lit(False))
    return j.select(*[F.when(hit, F.col(f"u_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.when(hit, F.lit(now)).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in items.columns])


def enrichable(items: DataFrame, limit: int = 10) -> DataFrame:
    """The latest verified rows that wait for review, at most ``limit`` (1 to 500)."""
    return items.where((F.col("status") == "needs_review") & F.col("verified")).orderBy(F.desc("detected_at"), F.desc("id")).limit(max(1, min(500, limit)))


def promotable() -> Column:
    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    return (F.col("status") == "needs_review") & F.col("verified") & filled("title_ar") & filled("summary_ar")


@dataclass
class Tier:
    """A kind of rows that are kept for some days."""

    name: str
    rule: Column
    days: int


def tiers(junk: int = 14, low: int = 60, medium: int = 180, high: int = 365) -> list[Tier]:
    """Retention: ignored and duplicate rows, then low, medium and high impact among the others."""
    is_junk = F.col("status").isin("ignored", "duplicate")
    level = lambda x: ~is_junk & (F.col("impact_level") == x)
    return [Tier("junk", is_junk, junk), Tier("low", level("low"), low), Tier("medium", level("medium"), medium), Tier("high", level("high"), high)]


def expired(tier: Tier, now: datetime) -> Column:
    """Older than the tier's days by published_at, else detected_at; false where that can't be told."""
    age = F.coalesce("published_at", "detected_at")
    return F.coalesce(tier.rule & (age < F.lit(now) - F.make_dt_interval(F.lit(tier.days))), F.lit(False))


def tier_counts(items: DataFrame, now: datetime, rules: list[Tier] | None = None) -> DataFrame:
    """tier, n for each tier and for all rows, from one reading."""
    rules = rules or tiers()
    one = items.agg(*[F.count_if(expired(t, now)).alias(t.name) for t in rules], F.count("*").alias("all_items"))
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(t.name) for t in rules], F.lit("all_items")), F.array(*[F.col(t.name) for t in rules], F.col("all_items")))).alias("tier", "n"))


def survivors(items: DataFrame, now: datetime, rules: list[Tier] | None = None) -> DataFrame:
    gone = F.lit(False)
    for t in rules or tiers():
        gone = gone | expired(t, now)
    return items.where(~gone)


def started(runs: DataFrame, job_name: str, now: datetime) -> tuple[DataFrame, int]:
    """(runs with a row of status running, its id)."""
    id_ = (runs.agg(F.max("id")).first()[0] or 0) + 1  # one number
    row = {"id": id_, "job_name": job_name, "started_at": now, "status": "running", **dict.fromkeys(COUNTS, 0)}
    new = runs.sparkSession.createDataFrame([tuple(row.get(c) for c in runs.columns)], runs.schema)
    return runs.unionByName(new), id_


def finished(runs: DataFrame, id_: int, update: dict, now: datetime) -> DataFrame:
    """Runs with the end of one run: finished_at, and what ``update`` has (status, counts, detail as JSON); the rest stays."""
    hit = F.col("id") == id_
    new = {c: v for c, v in update.items() if v is not None} | {"finished_at": now}
    return runs.select(*[F.when(hit, F.lit(new[c]).cast(runs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in runs.columns])


class CapExceeded(RuntimeError):
    """A change would touch more rows than its safety cap allows."""


def purge(items: DataFrame, now: datetime, cap: int = 5000, dry_run: bool = True, rules: list[Tier] | None = None) -> tuple[DataFrame, dict]:
    """(items afterwards, counts by tier). A dry run leaves them as they are; more rows than ``cap`` raise CapExceeded."""
    counts = {r["tier"]: r["n"] for r in tier_counts(items, now, rules).collect()}  # a row for each tier
    if dry_run:
        return items, counts
    total = sum(n for t, n in counts.items() if t != "all_items")
    if total > cap:
        raise CapExceeded(f"{total} rows to delete, the cap is {cap}")
    return survivors(items, now, rules), counts


def promote(items: DataFrame, now: datetime, cap: int = 5000, dry_run: bool = True) -> tuple[DataFrame, int]:
    """(items afterwards, number of rows to publish)."""
    n = items.where(promotable()).count()
    if dry_run:
        return items, n
    if n > cap:
        raise CapExceeded(f"{n} rows to publish, the cap is {cap}")
    hit = F.coalesce(promotable(), F.lit(False))
    return items.withColumns({"updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at")), "status": F.when(hit, "published").otherwise(F.col("status"))}), n
