"""The family of feed queries: filters, order, pages, counts, and the rows that are shown."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import CATEGORIES, IMPACT_LEVELS, NEWS_COLUMNS, iso

DEFAULT_PAGE, LARGEST_PAGE = 20, 100
SHOWN = "id company product title title_ar title_en summary_ar summary_en source_name source_url image_url category tags impact_level verified status published_at detected_at".split()


def resolve_since(text: str | None, now: datetime) -> datetime | None:
    """A moment given as a distance (30m, 24h, 7d, 2w) or as a date; None for anything else and for a distance of nothing."""
    if not text or not text.strip():
        return None
    m = re.fullmatch(r"(\d+)\s*([mhdw])", text.strip().lower())
    if m:
        back = int(m[1]) * {"m": 60, "h": 3600, "d": 86400, "w": 604800}[m[2]]
        return now - timedelta(seconds=back) if back else None
    try:
        at = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def clamp_limit(n) -> int:
    try:
        n = int(n)
    except (TypeError, ValueError, OverflowError):
        return DEFAULT_PAGE
    return max(1, min(LARGEST_PAGE, n))


@dataclass
class FeedQuery:
    """What a reader asks for. Unknown categories, impacts and moments mean no filter, not an empty result."""

    company: str | None = None
    product: str | None = None
    category: str | None = None
    impact: str | None = None
    tag: str | None = None
    verified: bool | None = None
    since: str | None = None
    from_: str | None = None
    to: str | None = None
    date_field: str = "detected_at"
    sort: str = "desc"
    published_only: bool = False
    limit: int | None = None
    offset: int | None = None
    lang: str = "both"

    @classmethod
    def from_parameters(cls, p: dict) -> FeedQuery:
        """From texts as they arrive in a request; of a repeated parameter the first counts."""

        def text(key: str) -> str | None:
            v = p.get(key)
            v = v[0] if isinstance(v, list) and v else v
            return v.strip() or None if isinstance(v, str) else None

        def number(key: str) -> int | None:
            try:
                return int(float(text(key) or ""))
            except (ValueError, OverflowError):
                return None

        low = lambda key: (text(key) or "").lower()
        verified = text("verified")
        return cls(
            company=text("company"), product=text("product"), category=text("category"), impact=text("impact"), tag=text("tag"),
            verified=None if verified is None else verified.lower() in ("1", "true", "yes"), since=text("since") or text("window"), from_=text("from"), to=text("to"),
            date_field="published_at" if low("date_field") in ("published", "published_at") else "detected_at", sort="asc" if low("sort") == "asc" else "desc",
            published_only=low("status") == "published", limit=number("limit"), offset=number("offset"), lang=low("lang") if low("lang") in ("ar", "en") else "both",
        )


def predicate(q: FeedQuery, now: datetime) -> Column:
    """The conjunction of the filters that were asked for; shared by the page and its count."""
    p = (F.col("status") == "published") if q.published_only else ~F.col("status").isin("ignored", "duplicate")
    for column, value in (("company", q.company), ("product", q.product)):
        if value:
            p = p & (F.lower(column) == value.lower())
    if q.category in CATEGORIES:
        p = p & (F.col("category") == q.category)
    if q.impact in IMPACT_LEVELS:
        p = p & (F.col("impact_level") == q.impact)
    if q.tag:
        p = p & F.array_contains("tags", q.tag)
    if q.verified is not None:
        p = p & (F.col("verified") == q.verified)
    date = F.col("published_at" if q.date_field == "published_at" else "detected_at")
    low = resolve_since(q.from_ if q.from_ is not None else q.since, now)
    high = resolve_since(q.to, now)
    if low:
        p = p & (date >= F.lit(low))
    if high:
        p = p & (date <= F.lit(high))
    return p


def matching(items: DataFrame, q: FeedQuery, now: datetime) -> DataFrame:
    return items.where(predicate(q, now))


def page(items: DataFrame, q: FeedQuery, now: datetime) -> DataFrame:
    """One page: by date in the asked direction, nulls last, then by id in the same direction."""
    date = "published_at" if q.date_field == "published_at" else "detected_at"
    order = [F.asc_nulls_last(date), F.asc("id")] if q.sort == "asc" else [F.desc_nulls_last(date), F.desc("id")]
    columns = [c for c in NEWS_COLUMNS if c in items.columns]
    rows = matching(items, q, now).select(*columns).orderBy(*order)
    skip = max(0, int(q.offset or 0))
    return (rows.offset(skip) if skip else rows).limit(clamp_limit(q.limit))


def count(items: DataFrame, q: FeedQuery, now: datetime) -> DataFrame:
    return matching(items, q, now).agg(F.count(F.lit(1)).alias("total"))


def envelope(items: DataFrame, q: FeedQuery, now: datetime) -> dict:
    """A page with what a reader needs to go on: data, total, has_more, next_offset."""
    limit, skip = clamp_limit(q.limit), max(0, int(q.offset or 0))
    data = [r.asDict(True) for r in shown(page(items, q, now), q.lang).collect()]  # at most LARGEST_PAGE rows
    total = count(items, q, now).first()["total"]
    more = skip + len(data) < total
    return {"data": data, "pagination": {"limit": limit, "offset": skip, "total": total, "has_more": more, "next_offset": skip + len(data) if more else None}}


def shown(items: DataFrame, lang: str = "both", metadata: bool = False, extra: tuple[Column, ...] = ()) -> DataFrame:
    """The rows as they are handed out: the other language's texts null, tags never null, moments as ISO texts; and ``extra`` columns."""
    ar, en = lang in ("ar", "both"), lang in ("en", "both")
    keep = lambda want, c: F.when(F.lit(want), F.col(c)).alias(c)
    columns = [
        "id", "company", "product", F.col("title_original").alias("title"), keep(ar, "title_ar"), keep(en, "title_en"), keep(ar, "summary_ar"), keep(en, "summary_en"), "source_name",
        F.col("official_source_url").alias("source_url"), "image_url", "category", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "impact_level", "verified", "status",
        iso(F.col("published_at")).alias("published_at"), iso(F.col("detected_at")).alias("detected_at"),
    ]
    if metadata:
        columns += ["content_hash", "source_id", iso(F.col("created_at")).alias("created_at"), iso(F.col("updated_at")).alias("updated_at")]
    return items.select(*columns, *extra)


def by_id(items: DataFrame, id_: int) -> DataFrame:
    return shown(items.where(F.col("id") == id_), metadata=True)


def latest_verified(items: DataFrame, now: datetime, company: str | None = None, category: str | None = None, limit: int | None = None, lang: str = "both") -> DataFrame:
    q = FeedQuery(company=company, category=category, limit=limit, verified=True, published_only=True, lang=lang)
    return shown(page(items, q, now), lang)


def digest(items: DataFrame, since: datetime, lang: str = "both") -> DataFrame:
    """company, total, categories: array of (category, count, items). Companies by total, categories by count, the largest first;
    equal ones by name, a missing category last. Items are the latest first."""
    rows = items.where((F.col("detected_at") >= F.lit(since)) & (F.col("status") == "published"))
    body = F.struct(*[c for c in SHOWN if c not in ("company",)])
    flat = shown(rows, lang, extra=(F.unix_micros("detected_at").alias("t"), F.col("category").alias("c0"))).withColumn("item", F.struct((-F.col("t")).alias("o"), (-F.col("id")).alias("o2"), body.alias("v")))
    by = flat.groupBy("company", "c0").agg(F.count("*").alias("count"), F.transform(F.array_sort(F.collect_list("item")), lambda x: x["v"]).alias("items"))
    block = F.struct((-F.col("count")).alias("o"), F.col("c0").isNull().alias("o2"), F.coalesce("c0", F.lit("uncategorized")).alias("category"), F.col("count"), F.col("items"))
    out = by.groupBy("company").agg(F.sum("count").alias("total"), F.array_sort(F.collect_list(block), lambda a, b: _compare(a, b)).alias("b"))
    return out.select("company", "total", F.transform("b", lambda x: F.struct(x["category"].alias("category"), x["count"].alias("count"), x["items"].alias("items"))).alias("categories")).orderBy(F.desc("total"), "company")


def _compare(a: Column, b: Column) -> Column:
    less = (a["o"] < b["o"]) | ((a["o"] == b["o"]) & ((~a["o2"] & b["o2"]) | ((a["o2"] == b["o2"]) & (a["category"] < b["category"]))))
    return F.when(less, -1).when((a["o"] == b["o"]) & (a["o2"] == b["o2"]) & (a["category"] == b["category"]), 0).otherwise(1)


def digest_counts(items: DataFrame, since: datetime) -> DataFrame:
    """The digest's numbers alone: company, category, n, total; no items are gathered."""
    rows = items.where((F.col("detected_at") >= F.lit(since)) & (F.col("status") == "published"))
    by = rows.groupBy("company", "category").agg(F.count("*").alias("n"))
    totals = by.groupBy("company").agg(F.sum("n").alias("total"))
    return by.join(totals, "company").select("company", F.coalesce("category", F.lit("uncategorized")).alias("category"), "n", "total")


def companies(sources: DataFrame, items: DataFrame) -> DataFrame:
    """An overview of each company that has sources: their numbers, products, last check, and its latest item that isn't junk."""
    per = sources.groupBy("company").agg(
        F.count_if("active").alias("active_sources"), F.count("*").alias("total_sources"), F.array_sort(F.collect_set("product")).alias("products"), F.max("last_checked_at").alias("last_checked_at")
    )
    kept = items.where(~F.col("status").isin("ignored", "duplicate")).select("company", "id", "detected_at", "title_original")
    # the latest moment first, by hash aggregation over all items; what stands at that moment is little
    moment = kept.groupBy("company").agg(F.max("detected_at").alias("detected_at"))
    latest = kept.join(moment, ["company", "detected_at"]).groupBy("company").agg(F.max(F.struct("id", "detected_at", "title_original")).alias("latest"))
    out = per.join(latest, "company", "left")
    return out.select("company", "active_sources", "total_sources", "products", "last_checked_at", F.col("latest.title_original").alias("latest_title"), F.col("latest.detected_at").alias("latest_detected_at")).orderBy("company")
