"""Schemas, enumerations and constraints of the feed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CATEGORIES = ["model", "api", "coding", "security", "pricing", "research", "tool", "sdk", "product", "company", "deprecation"]
IMPACT_LEVELS = ["low", "medium", "high", "critical"]
STATUSES = ["published", "draft", "needs_review", "ignored", "duplicate"]
SOURCE_TYPES = ["rss", "html", "github", "playwright"]
JOB_STATUSES = ["running", "success", "partial", "failed"]

EXTRA = "struct<html:struct<itemSelector:string,titleSelector:string,linkSelector:string,linkAttr:string,dateSelector:string,contentSelector:string,imageSelector:string,baseUrl:string>,github:struct<owner:string,repo:string,mode:string,path:string,branch:string>>"

SOURCES = (
    "id int, company string, product string, source_url string, source_type string, official_domain string, priority int, crawl_interval_minutes int, active boolean, "
    f"last_checked_at timestamp, last_success_at timestamp, failure_count int, extra {EXTRA}, created_at timestamp, updated_at timestamp"
)
NEWS_ITEMS = (
    "id int, company string, product string, title_original string, title_ar string, title_en string, summary_ar string, summary_en string, content_original string, official_source_url string, "
    "image_url string, source_name string, source_language string, category string, tags array<string>, impact_level string, verified boolean, published_at timestamp, detected_at timestamp, "
    "content_hash string, status string, source_id int, created_at timestamp, updated_at timestamp"
)
NEWS_COLUMNS = [c.split()[0] for c in NEWS_ITEMS.split(", ")]
RAW_ENTRY = "title string, url string, content string, published_at string, image_url string"
JOB_RUNS = "id int, job_name string, started_at timestamp, finished_at timestamp, status string, sources_checked int, items_found int, items_inserted int, items_skipped int, errors int, detail string"


def news_constraints() -> Column:
    """True for a row that may be stored as a news item: required columns present, enumerations respected."""
    required = ["company", "title_original", "content_original", "official_source_url", "source_name", "content_hash", "status", "impact_level"]
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return ok & (F.col("category").isNull() | F.col("category").isin(CATEGORIES)) & F.col("impact_level").isin(IMPACT_LEVELS) & F.col("status").isin(STATUSES)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that satisfy the constraints, quarantined rows)."""
    ok = F.coalesce(news_constraints(), F.lit(False))
    return df.where(ok), df.where(~ok)


def iso(ts: Column) -> Column:
    """ISO 8601 in UTC with milliseconds, whatever the session's time zone; null for null."""
    micros = F.unix_micros(ts)
    second = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / F.lit(1_000_000)).cast("decimal(18,6)"))
    return F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
