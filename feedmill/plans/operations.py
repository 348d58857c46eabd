"""What the operator of the service asks: sources that are due, previews, runs and health."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F


def ordered_sources(sources: DataFrame) -> DataFrame:
    return sources.orderBy("company", F.asc_nulls_first("product"), "id")


def is_due(now: datetime) -> Column:
    """Active and never checked, or checked at least its interval ago."""
    interval = F.make_dt_interval(F.lit(0), F.lit(0), F.col("crawl_interval_minutes"))
    return F.col("active") & (F.col("last_checked_at").isNull() | (F.col("last_checked_at") <= F.lit(now) - interval))


def due_sources(sources: DataFrame, now: datetime) -> DataFrame:
    return sources.where(is_due(now)).orderBy("priority", F.asc_nulls_first("last_checked_at"), "id")


def run_subset(sources: DataFrame, now: datetime, force: bool = False, ids: list[int] | None = None) -> DataFrame:
    """Sources of a run: all or the due ones, of these the active ones, of these the named ones; no names mean all."""
    chosen = sources.where("active") if force else due_sources(sources, now)
    return chosen.where(F.col("id").isin(list(ids))) if ids else chosen


def matches_terms(terms: list[str]) -> Column:
    """One of the terms occurs in company, product or address; % and _ in a term stand for any text and any character."""
    hit = F.lit(False)
    for t in terms:
        pattern = f"%{t.lower()}%"
        for c in (F.col("company"), F.coalesce("product", F.lit("")), F.col("source_url")):
            hit = hit | F.lower(c).like(pattern)
    return hit


def activation_preview(sources: DataFrame, terms: list[str]) -> DataFrame:
    return sources.where(matches_terms(terms)).orderBy("active", "company", F.asc_nulls_first("product"))


def latest_run(runs: DataFrame, job_name: str) -> DataFrame:
    return runs.where(F.col("job_name") == job_name).orderBy(F.desc("started_at"), F.desc("id")).limit(1)


def recent_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("id")).limit(max(1, min(100, limit)))


def latest_by_job(runs: DataFrame) -> DataFrame:
    """The latest run of each job, in one aggregation."""
    fields = ["started_at", "id", "status", "items_found", "items_inserted", "items_skipped", "errors"]
    top = runs.groupBy("job_name").agg(F.max(F.struct(*fields)).alias("r"), F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failed_runs"))
    return top.select("job_name", F.col("r.id").alias("id"), F.col("r.status").alias("status"), F.col("r.items_found").alias("items_found"), F.col("r.errors").alias("errors"), "runs", "failed_runs")


def health(runs: DataFrame, job_name: str = "ingestion") -> DataFrame:
    """healthy, status, last_success_at: healthy unless the job's latest run failed (or if it has none).

    last_success_at is when the latest successful or partly successful of the ten latest runs of any job finished.
    """
    last = latest_run(runs, job_name).agg(F.max("status").alias("status"))
    good = recent_runs(runs, 10).where(F.col("status").isin("success", "partial"))
    # the end may be null, so it is wrapped: max_by must take the latest run, finished or not
    good = good.agg(F.max_by(F.struct("finished_at"), F.struct("started_at", "id")).alias("r"))
    both = last.select("status", F.lit(None).cast("timestamp").alias("at"))
    both = both.unionByName(good.select(F.lit(None).cast("string").alias("status"), F.col("r.finished_at").alias("at")))
    both = both.agg(F.max("status").alias("status"), F.max("at").alias("last_success_at"))
    return both.select(F.coalesce(F.col("status") != "failed", F.lit(True)).alias("healthy"), "status", "last_success_at")
