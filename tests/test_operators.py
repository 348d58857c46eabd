import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from feedmill import schema
from feedmill.operators import changes, ingest
from feedmill.operators.store import Store
from feedmill.plans import feed, operations
from feedmill.streaming import ingest as stream

NOW = datetime(2026, 5, 28, 12, tzinfo=timezone.utc)
ENTRY = "source_id int, source_rank bigint, entry_pos bigint, title string, url string, content string, published_at string, image_url string"


def source(spark, **over):
    base = {
        "id": 1, "company": "OpenSite", "product": "Newsroom", "source_url": "https://open.example/rss.xml", "source_type": "rss", "official_domain": "open.example", "priority": 10,
        "crawl_interval_minutes": 60, "active": True, "last_checked_at": None, "last_success_at": None, "failure_count": 0, "extra": None, "created_at": NOW, "updated_at": NOW,
    }
    return base | over


def sources(spark, *rows):
    return spark.createDataFrame([source(spark, **r) for r in rows], schema.SOURCES)


def item(**over):
    base = {
        "id": 1, "company": "OpenSite", "product": "API", "title_original": "New model released", "title_ar": "ن", "title_en": "New", "summary_ar": "م", "summary_en": "Short.", "content_original": "<p>raw</p>",
        "official_source_url": "https://open.example/x", "image_url": None, "source_name": "OpenSite · Newsroom", "source_language": "en", "category": "model", "tags": ["gpt", "model"], "impact_level": "high",
        "verified": True, "published_at": NOW - timedelta(hours=2), "detected_at": NOW - timedelta(hours=1), "content_hash": "a" * 64, "status": "published", "source_id": 1, "created_at": NOW, "updated_at": NOW,
    }
    return base | over


def items(spark, *rows):
    return spark.createDataFrame([item(id=i + 1) | r for i, r in enumerate(rows)], schema.NEWS_ITEMS)


def test_relative_times_and_limits():
    at = lambda t: feed.resolve_since(t, NOW)
    assert at("24h") == NOW - timedelta(days=1) and at(" 7D ") == NOW - timedelta(days=7) and at("30m") == NOW - timedelta(minutes=30) and at("2w") == NOW - timedelta(weeks=2)
    assert at("2026-05-01T00:00:00Z") == datetime(2026, 5, 1, tzinfo=timezone.utc)
    assert at("nonsense") is at("0d") is at(None) is at("") is None
    assert [feed.clamp_limit(x) for x in (None, 9999, 0, "7")] == [20, 100, 1, 7]


def test_parameters():
    q = feed.FeedQuery.from_parameters({"company": [" A ", "B"], "category": "", "verified": "banana", "date_field": "PUBLISHED_AT", "sort": "ASC", "status": "published", "limit": "x", "offset": "5", "lang": "AR", "window": "7d"})
    assert (q.company, q.category, q.verified, q.date_field, q.sort, q.published_only, q.limit, q.offset, q.lang, q.since) == ("A", None, False, "published_at", "asc", True, None, 5, "ar", "7d")


def ids(df):
    return [r.id for r in df.collect()]


def test_feed_filters_and_order(spark):
    t = items(spark, {}, {"status": "ignored"}, {"company": "other", "published_at": None}, {"category": None, "verified": False, "status": "draft", "detected_at": NOW - timedelta(days=9)}, {"tags": None, "impact_level": "low", "published_at": NOW - timedelta(days=3)})
    page = lambda **k: ids(feed.page(t, feed.FeedQuery(**k), NOW))
    assert page() == [5, 3, 1, 4]
    assert page(published_only=True) == [5, 3, 1]
    assert page(company="OPENSITE") == [5, 1, 4] and page(company="") == [5, 3, 1, 4]
    assert page(category="nonsense") == page() and page(category="model", verified=True) == [5, 3, 1]
    assert page(tag="gpt") == [3, 1, 4] and page(tag="GPT") == []
    assert page(since="24h") == [5, 3, 1] and page(from_="junk", since="24h") == page()  # junk masks a valid moment
    assert page(date_field="published_at", sort="asc") == [5, 1, 4, 3] and page(date_field="published_at") == [4, 1, 5, 3]
    assert page(limit=2, offset=1) == [3, 1]
    exact = (NOW - timedelta(hours=1)).isoformat()
    assert page(from_=exact, to=exact) == [5, 3, 1]  # both ends belong to the range
    assert feed.count(t, feed.FeedQuery(limit=1, offset=3), NOW).first().total == 4
    last = feed.envelope(t, feed.FeedQuery(limit=2, offset=2), NOW)["pagination"]
    assert last == {"limit": 2, "offset": 2, "total": 4, "has_more": False, "next_offset": None}
    assert feed.envelope(t, feed.FeedQuery(limit=2), NOW)["pagination"]["next_offset"] == 2


def test_pages_join_to_the_whole(spark):
    t = items(spark, *[{"detected_at": NOW - timedelta(hours=i % 3), "published_at": None if i % 4 == 0 else NOW - timedelta(days=i % 5)} for i in range(23)])
    for field in ("detected_at", "published_at"):
        pages = [i for k in range(0, 25, 5) for i in ids(feed.page(t, feed.FeedQuery(date_field=field, limit=5, offset=k), NOW))]
        assert pages == ids(feed.page(t, feed.FeedQuery(date_field=field, limit=100), NOW)) and len(set(pages)) == 23
    assert feed.page(t.limit(0), feed.FeedQuery(), NOW).count() == 0


def test_language_masking(spark):
    (r,) = feed.shown(items(spark, {"tags": None}), "ar").collect()
    assert (r.title_ar, r.title_en, r.summary_en, r.tags, r.published_at) == ("ن", None, None, [], "2026-05-28T10:00:00.000Z")


def test_digest_and_companies(spark):
    t = items(spark, {"company": "A"}, {"company": "A", "detected_at": NOW}, {"company": "A", "category": "pricing"}, {"company": "B", "category": None}, {"company": "C", "status": "draft"}, {"company": "A", "category": None, "status": "ignored"})
    got = feed.digest(t, NOW - timedelta(days=1)).collect()
    assert [(g.company, g.total, [(c["category"], c["count"], [i.id for i in c["items"]]) for c in g.categories]) for g in got] == [("A", 3, [("model", 2, [2, 1]), ("pricing", 1, [3])]), ("B", 1, [("uncategorized", 1, [4])])]
    s = sources(spark, {"company": "A"}, {"id": 2, "company": "A", "product": None, "active": False, "source_url": "u2"}, {"id": 3, "company": "D", "source_url": "u3"}, {"id": 4, "company": "E", "source_url": "u4"})
    only_junk = t.union(items(spark, {"company": "E", "status": "duplicate"}))
    got = [(r.company, r.active_sources, r.total_sources, r.products, r.latest_title) for r in feed.companies(s, only_junk).collect()]
    assert got == [("A", 1, 2, ["Newsroom"], "New model released"), ("D", 1, 1, ["Newsroom"], None), ("E", 1, 1, ["Newsroom"], None)]


def test_due_sources(spark):
    s = sources(
        spark, {"id": 1, "last_checked_at": NOW - timedelta(minutes=60)}, {"id": 2, "last_checked_at": NOW - timedelta(minutes=59)}, {"id": 3, "priority": 5}, {"id": 4, "active": False}, {"id": 5, "last_checked_at": None}
    )
    assert ids(operations.due_sources(s, NOW)) == [3, 5, 1]
    assert sorted(ids(operations.run_subset(s, NOW, True, [2, 4]))) == [2] and sorted(ids(operations.run_subset(s, NOW, False, []))) == [1, 3, 5]
    assert sorted(ids(operations.activation_preview(s, ["ROOM", "no%thing"]))) == [1, 2, 3, 4, 5] and ids(operations.activation_preview(s, [])) == []


def test_upsert(spark):
    s = sources(spark, {"id": 3, "active": False, "priority": 7}, {"id": 5, "source_url": "u5"})
    new = spark.createDataFrame([("N", "https://open.example/rss.xml", None, 1), ("O", "https://open.example/rss.xml", 9, 2), ("P", "new-b", 1, 3), ("Q", "new-a", None, 4), ("R", None, 1, 5)], "company string, source_url string, priority int, seq int")
    got = {r.source_url: r for r in changes.upsert_sources(s, new, NOW).collect()}
    assert len(got) == 4 and (got["https://open.example/rss.xml"].company, got["https://open.example/rss.xml"].priority, got["https://open.example/rss.xml"].active, got["https://open.example/rss.xml"].id) == ("O", 9, True, 3)
    assert (got["new-a"].id, got["new-b"].id, got["new-a"].priority, got["new-a"].crawl_interval_minutes) == (6, 7, 100, 60) and got["u5"].company == "OpenSite"
    kept = {r.source_url: r.active for r in changes.upsert_sources(s, new, NOW, keep_active=True).collect()}
    assert kept["https://open.example/rss.xml"] is False and kept["new-a"] is True
    assert changes.upsert_sources(s, new.limit(0), NOW).count() == 2


def test_mark_checked(spark):
    s = sources(spark, {"id": 1, "failure_count": 2}, {"id": 2, "failure_count": 2, "source_url": "b"}, {"id": 3, "failure_count": 2, "source_url": "c"})
    o = spark.createDataFrame([(1, True), (2, False)], "source_id int, success boolean")
    assert {r.id: (r.failure_count, r.last_checked_at is None, r.last_success_at is None) for r in changes.mark_checked(s, o, NOW).collect()} == {1: (0, False, False), 2: (3, False, True), 3: (2, True, True)}


def test_retention(spark):
    days = lambda n: NOW - timedelta(days=n)
    t = items(
        spark, {"status": "ignored", "impact_level": "critical", "published_at": days(15)}, {"impact_level": "critical", "published_at": days(999)}, {"impact_level": "low", "published_at": days(60)},
        {"impact_level": "low", "published_at": None, "detected_at": days(61)}, {"impact_level": "medium", "published_at": days(179)}, {"impact_level": "high", "published_at": days(366)},
    )
    assert sorted(ids(changes.survivors(t, NOW))) == [2, 3, 5]  # exactly at the limit stays
    after, counts = changes.purge(t, NOW)
    assert counts == {"junk": 1, "low": 1, "medium": 0, "high": 1, "all_items": 6} and after.count() == 6
    assert sorted(ids(changes.purge(t, NOW, dry_run=False)[0])) == [2, 3, 5]
    with pytest.raises(changes.CapExceeded):
        changes.purge(t, NOW, cap=2, dry_run=False)


def test_promotion_and_enrichment(spark):
    r = {"status": "needs_review"}
    t = items(spark, r, r | {"title_ar": ""}, r | {"verified": False}, r | {"summary_ar": None}, {})
    after, n = changes.promote(t, NOW, dry_run=False)
    assert n == 1 and {x.id: x.status for x in after.collect()} == {1: "published", 2: "needs_review", 3: "needs_review", 4: "needs_review", 5: "published"}
    assert ids(changes.enrichable(t, 2)) == [4, 2]
    with pytest.raises(changes.CapExceeded):
        changes.promote(t, NOW, cap=0, dry_run=False)


def scenario(spark):
    long = "<p>A long enough body about a new feature that people can read today.</p>"
    rows = [
        (1, 0, 0, "New model", "https://open.example/a", long, "2026-05-01T00:00:00Z", None), (1, 0, 1, "New  model", "https://open.example/a?utm_source=x", long, "2026-05-02T00:00:00Z", None),
        (1, 0, 2, "Elsewhere", "https://other.example/a", long, None, None), (1, 0, 3, "Doubtful", "https://open.example/b", long, "junk", "/i.png"), (1, 0, 4, "v1.2.3", "https://open.example/c", "v1.2.3", None, None),
        (1, 0, 5, "Known", "https://open.example/k", long, None, None), (1, 0, 6, None, None, None, None, None), (99, 0, 0, "No source", "https://x.example", long, None, None),
    ]
    return spark.createDataFrame(rows, ENTRY)


def model():
    def complete(ask):  # made here, so that it travels to the workers by value
        sure = 0.1 if ask["title"] == "Doubtful" else 0.9
        return json.dumps({"category": "model", "tags": ["t"], "impact": "high", "title_ar": "ع", "summary_ar": "م", "title_en": "t", "summary_en": "s", "confidence": sure})

    return complete


def test_pipeline_scenario(spark):
    src, raw = sources(spark, {}), scenario(spark)
    known = ingest.normalise(raw.where("title = 'Known'"), src).first().content_hash
    stored = items(spark, {"content_hash": known})
    run = ingest.ingest(raw, src, stored, NOW, model())
    got = {r.title_original: r for r in run.items.collect()}
    assert set(got) == {"New model", "Elsewhere", "Doubtful", ""}
    assert {t: r.status for t, r in got.items()} == {"New model": "published", "Elsewhere": "needs_review", "Doubtful": "needs_review", "": "needs_review"}
    away = got["Elsewhere"]
    assert (away.verified, away.category, away.tags, away.impact_level, away.title_ar) == (False, None, [], "low", None)
    assert got["New model"].published_at.replace(tzinfo=timezone.utc) == datetime(2026, 5, 1, tzinfo=timezone.utc) and got["Doubtful"].image_url == "https://open.example/i.png"
    assert {r.reason: r.n for r in run.tagged.groupBy("reason").agg(F.count("*").alias("n")).collect()} == {"new": 4, "duplicate": 2, "contentless": 1}
    m = ingest.run_metrics(run.per_source).first()
    assert (m.sources_checked, m.items_found, m.items_inserted, m.items_skipped, m.errors, m.status) == (1, 7, 4, 3, 0, "success")
    # without a model nothing is published; a budget of one leaves the second to the rules
    assert {r.status for r in ingest.ingest(raw, src, stored, NOW).items.collect()} == {"needs_review"}
    few = {r.title_original: r.status for r in ingest.ingest(raw, src, stored, NOW, model(), cap=1).items.collect()}
    assert few["New model"] == "published" and few["Doubtful"] == "needs_review"
    assert ingest.ingest(raw.limit(0), src, stored, NOW).items.count() == 0


def test_failed_and_denied_sources(spark):
    rows = [(1, 0, None, None, None, None, None, None, "HTTP 500"), (2, 1, None, None, None, None, None, None, "disallowed-by-robots")]
    raw = spark.createDataFrame(rows, ENTRY + ", error string")
    src = sources(spark, {}, {"id": 2, "source_url": "b"})
    m = ingest.run_metrics(ingest.ingest(raw, src, items(spark, {}), NOW).per_source).first()
    assert (m.sources_checked, m.errors, m.status) == (2, 1, "partial")
    assert ingest.run_metrics(ingest.ingest(raw.limit(1), src, items(spark, {}), NOW).per_source).first().status == "failed"


def test_stream_equals_batch(spark, tmp_path):
    src, raw = sources(spark, {}), scenario(spark)
    landing, store = str(tmp_path / "landing"), Store(spark, f"file://{tmp_path}/store")
    for k in range(3):
        raw.where(F.col("entry_pos") % 3 == k).coalesce(1).write.mode("append").parquet(landing)
    for _ in range(2):  # the second start finds nothing new
        stream.start(spark, landing, src, store, str(tmp_path / "cp"), lambda: NOW, model(), files_per_batch=1).awaitTermination()
    got = store.read("items", schema.NEWS_ITEMS)
    batch = ingest.ingest(raw, src, got.limit(0), NOW, model()).items
    assert sorted(r.content_hash for r in got.collect()) == sorted(r.content_hash for r in batch.collect())
    assert sorted(ids(got)) == list(range(1, got.count() + 1))


def test_store_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    assert store.read("t", "id int").count() == 0
    first = store.write("t", spark.range(3).select(F.col("id").cast("int")))
    old = store.read("t", "id int")
    second = store.write("t", old.where("id > 0"))
    assert first != second and store.version("t") == second and store.read("t", "id int").count() == 2 and old.count() == 3
    store.append("t", spark.range(1).select(F.col("id").cast("int")))
    assert store.read("t", "id int").count() == 3


def test_constraints(spark):
    good, bad = schema.split_valid(items(spark, {}, {"category": "odd"}, {"status": None}, {"category": None}))
    assert sorted(ids(good)) == [1, 4] and sorted(ids(bad)) == [2, 3]


def test_first_seen_with_ties_and_nulls(spark):
    df = spark.createDataFrame([("h", 1, 2, "b"), ("h", 1, 1, "a"), ("h", 1, 1, "a"), (None, 0, 0, "n"), ("g", 5, 5, "c")], "content_hash string, source_rank int, entry_pos int, title string")
    assert sorted((r.content_hash, r.title) for r in changes.first_seen(df).collect()) == [("g", "c"), ("h", "a")]


def test_runs(spark):
    at = lambda n: NOW - timedelta(hours=n)
    rows = [{"id": 1, "job_name": "ingest", "started_at": at(3), "status": "success"}, {"id": 2, "job_name": "ingest", "started_at": at(1), "status": "failed"}, {"id": 3, "job_name": "purge", "started_at": at(2), "finished_at": at(1.5), "status": "success"}]
    t = spark.createDataFrame([dict.fromkeys(c.split()[0] for c in schema.JOB_RUNS.split(", ")) | r for r in rows], schema.JOB_RUNS)
    h = operations.health(t, "ingest").first()
    assert (h.healthy, h.status) == (False, "failed") and h.last_success_at.replace(tzinfo=timezone.utc) == at(1.5)
    assert operations.health(t).first().healthy is True and operations.health(t.limit(0)).first().status is None
    assert ids(operations.recent_runs(t, 0)) == [2] and ids(operations.latest_run(t, "purge")) == [3]
