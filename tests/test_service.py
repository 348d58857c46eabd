import json
import logging
import os
import time
from datetime import datetime, timedelta, timezone

import pytest

from feedmill.config import JsonLines, Settings, flag, provider, whole
from feedmill.operators.changes import CapExceeded
from feedmill.operators.store import Store
from feedmill.service import Busy, Invalid, Service
from feedmill.sources.model import ModelError, with_retries
from feedmill.streaming import ingest as stream

NOW = datetime(2026, 5, 28, 12, tzinfo=timezone.utc)
ENTRY = "source_id int, source_rank bigint, entry_pos bigint, title string, url string, content string, published_at string, image_url string, error string"
LONG = "<p>A long enough body about a new feature that people can read today.</p>"


def model():
    def complete(ask):
        return json.dumps({"category": "model", "tags": ["t"], "impact": "low", "title_ar": "ع", "summary_ar": "م", "title_en": "t", "summary_en": "s", "confidence": 0.9})

    return complete


def test_service(spark, tmp_path):
    s = Service(spark, Store(spark, f"file://{tmp_path}/store"), lambda: NOW)
    assert s.health()["healthy"] and s.health()["latest"] is None and s.feed({})["data"] == []
    s.put_source({"company": "A", "source_url": "https://a.example/rss", "source_type": "rss", "official_domain": "a.example"})
    for bad in ({"company": "A"}, {"company": "A", "source_url": "u", "source_type": "odd", "official_domain": "d"}, {"company": "A", "source_url": "u", "source_type": "rss", "official_domain": "d", "priority": 1001}):
        with pytest.raises(Invalid):
            s.put_source(bad)
    rows = [(1, 0, i, f"Title {i}", f"https://a.example/{i}", LONG + str(i), (NOW - timedelta(days=i)).isoformat(), None, None) for i in range(3)]
    entries = spark.createDataFrame(rows, ENTRY)
    m = s.run(entries)
    assert (m["items_inserted"], m["status"]) == (3, "success") and s.run(entries)["items_skipped"] == 3
    assert s.feed({"limit": "2"})["pagination"] == {"limit": 2, "offset": 0, "total": 3, "has_more": True, "next_offset": 2}
    assert s.latest({}).count() == 0  # without a model nothing is published
    assert s.backfill(model(), 2) == 2 and s.latest({}).count() == 2 and s.digest().first().total == 2
    assert s.promote() == 1 and s.promote(dry_run=False) == 1 and s.latest({}).count() == 3
    assert s.item("2")["id"] == 2 and s.item(99) is None
    for bad in ("x", 0, None):
        with pytest.raises(Invalid):
            s.item(bad)
    assert s.companies().first().total_sources == 1 and s.health()["healthy"] and s.health()["latest"]["status"] == "success"
    assert s.purge()["all_items"] == 3 and s.purge(dry_run=False)["low"] == 0
    assert sorted(r.job_name for r in s.runs.collect()) == ["ingestion", "ingestion", "promote", "purge"]
    assert s.activate(["a.example"]).count() == 1 and s.sources.first().failure_count == 0
    s.lock.acquire()
    with pytest.raises(Busy):
        s.run(entries)
    s.lock.release()
    failed = spark.createDataFrame([(1, 0, None, None, None, None, None, None, "HTTP 500")], ENTRY)
    assert s.run(failed)["status"] == "failed" and s.sources.first().failure_count == 1 and not s.health()["healthy"] and len(s.health()["recent"]) == 5
    with pytest.raises(CapExceeded):
        s.promote(dry_run=False, cap=-1)


def counted(at):
    """A model that notes each call in a folder, as the calls are made by other processes; and the number of its calls."""
    answer, at = model(), str(at)

    def complete(ask):
        import pathlib
        import uuid

        pathlib.Path(at, uuid.uuid4().hex).touch()
        return answer(ask)

    return complete, lambda: len(os.listdir(at))


def test_each_entry_is_asked_once(spark, tmp_path):
    s = Service(spark, Store(spark, f"file://{tmp_path}/store"), lambda: NOW)
    s.put_source({"company": "A", "source_url": "https://a.example/rss", "source_type": "rss", "official_domain": "a.example"})
    entries = spark.createDataFrame([(1, 0, i, f"Title {i}", f"https://a.example/{i}", LONG + str(i), None, None, None) for i in range(11)], ENTRY)
    for folder in ("run", "backfill"):
        (tmp_path / folder).mkdir()
    ask, calls = counted(tmp_path / "run")
    assert s.run(entries, ask, cap=5)["items_inserted"] == 11 and calls() == 5
    ask, calls = counted(tmp_path / "backfill")
    assert s.backfill(ask, 6) == 6 and calls() == 6


def test_ingest_from_the_due_sources_on(spark, tmp_path):
    feed = "<rss><channel>{}</channel></rss>"
    entry = "<item><title>News {0}</title><link>https://a.example/{0}</link><description>A body that is long enough to say something, number {0}.</description><pubDate>03/04/2026 10:00</pubDate></item>"
    (tmp_path / "full.xml").write_text(feed.format("".join(entry.format(i) for i in range(3))))
    (tmp_path / "empty.xml").write_text(feed.format(""))
    s = Service(spark, Store(spark, f"file://{tmp_path}/store"), lambda: NOW)
    assert s.migrate() == ["sources created", "items created", "runs created"] and s.migrate() == []
    names = {"full": "full.xml", "empty": "empty.xml", "gone": "gone.xml"}
    seeds = [{"company": c, "source_url": f"file://{tmp_path}/{f}", "source_type": "rss", "official_domain": "a.example", "priority": i} for i, (c, f) in enumerate(names.items())]
    (tmp_path / "seeds.json").write_text(json.dumps(seeds))
    assert s.seed(f"file://{tmp_path}/seeds.json") == 3
    m = s.ingest()
    assert (m["sources_checked"], m["items_found"], m["items_inserted"], m["errors"], m["status"]) == (3, 3, 3, 1, "partial")
    by = {r.company: r for r in s.sources.collect()}
    assert all(r.last_checked_at for r in by.values()) and by["gone"].failure_count == 1 and by["empty"].failure_count == 0 and by["empty"].last_success_at
    assert {r.published_at.replace(tzinfo=timezone.utc) for r in s.items.collect()} == {datetime(2026, 3, 4, 10, tzinfo=timezone.utc)}  # the month first
    per = {p["source_id"]: p for p in json.loads(s.health()["latest"]["detail"])["perSource"]}
    assert per[by["empty"].id]["found"] == 0 and per[by["full"].id]["inserted"] == 3
    assert s.ingest()["sources_checked"] == 0  # none is due
    assert s.ingest(force=True, ids=[by["full"].id])["items_skipped"] == 3
    zones = spark.createDataFrame([(1, "Europe/Berlin", True)], "source_id int, zone_name string, day_first boolean")
    other = Service(spark, Store(spark, f"file://{tmp_path}/other"), lambda: NOW)
    other.load_sources(seeds[:1])
    other.ingest(zones=zones)
    assert {r.published_at.replace(tzinfo=timezone.utc) for r in other.items.collect()} == {datetime(2026, 4, 3, 8, tzinfo=timezone.utc)}


def test_ticks(spark, tmp_path):
    s = Service(spark, Store(spark, f"file://{tmp_path}/store"), lambda: NOW)
    s.migrate()
    ticks = stream.scheduled(s, f"file://{tmp_path}/progress", "1 second")
    try:
        until = time.time() + 100
        while time.time() < until and not [r for r in s.runs.collect() if r.status == "success"]:
            time.sleep(0.5)
    finally:
        ticks.stop()
    assert "success" in {r.status for r in s.runs.collect()}


def test_a_run_that_breaks_off_is_noted_as_failed(spark, tmp_path):
    s = Service(spark, Store(spark, f"file://{tmp_path}/store"), lambda: NOW)
    with pytest.raises(Exception):
        s.run(spark.createDataFrame([(1,)], "wrong int"))
    assert [(r.status, r.finished_at is not None) for r in s.runs.collect()] == [("failed", True)] and not s.lock.locked()


def test_model_services():
    assert provider({}) == ("none", False)
    env = {"FEEDMILL_MODEL_BASE_URL": "https://models.example/v1", "FEEDMILL_MODEL_NAME": "m"}
    assert provider(env) == ("openai", False) and provider(env | {"FEEDMILL_MODEL_KEY": "k"}) == ("openai", True)
    assert provider(env | {"FEEDMILL_MODEL_BASE_URL": "http://localhost:1/v1"}) == ("openai", True)
    assert provider({"FEEDMILL_MODEL_DIRECT_KEY": "k"}) == ("anthropic", True) and provider(env | {"FEEDMILL_MODEL_PROVIDER": "anthropic"}) == ("anthropic", False)
    assert Settings.from_environment({"FEEDMILL_MODEL_PAUSE_MS": "250"}).model_pause_seconds == 0.25


def test_retries():
    waits, answers = [], [(429, 3.0, ""), (500, None, ""), OSError("net"), (200, None, "ok")]

    def send(ask):
        a = answers.pop(0)
        if isinstance(a, OSError):
            raise a
        return a

    assert with_retries(send, 4, waits.append)({}) == "ok"
    assert waits[0] == 3.0 and 2 <= waits[1] <= 2.4 and 4 <= waits[2] <= 4.4
    for status, text in ((401, "x"), (200, " ")):
        answers[:] = [(status, None, text)]
        with pytest.raises(ModelError):
            with_retries(send, 4, waits.append)({})
        assert answers == []
    answers[:] = [(503, None, "")] * 2
    with pytest.raises(ModelError):
        with_retries(send, 2, waits.append)({})


def test_settings_and_logs():
    assert [flag(x, True) for x in (None, "", "no", "Yes", "1")] == [True, True, False, True, True]
    assert [whole(x, 7) for x in (None, "", "text", "0", "-5", "30", "45.7", "nan", "inf")] == [7, 7, 7, 7, 7, 30, 45, 7, 7]
    s = Settings.from_environment({"FEEDMILL_RETAIN_LOW_DAYS": "30", "FEEDMILL_ROBOTS": "0", "FEEDMILL_MODEL_BUDGET": "0"})
    assert s.retention == {"junk": 14, "low": 30, "medium": 180, "high": 365} and not s.respect_robots and s.model_budget == 0
    record = logging.LogRecord("x", logging.WARNING, "", 0, "said %s", ("a",), None)
    record.fields = {"source_id": 3}
    line = json.loads(JsonLines().format(record))
    assert (line["level"], line["msg"], line["source_id"]) == ("warning", "said a", 3)
