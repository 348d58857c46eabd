"""What the service offers, as functions over its store; serving them over HTTP is left to the caller."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import schema
from .config import Settings
from .operators import changes, ingest
from .operators.store import Store
from .plans import feed, operations
from .scratch import written
from .sources import listings
from .sources.fetch import DENIED, PageSource

JOB = "ingestion"


class Busy(RuntimeError):
    """A run is going on."""


class Invalid(ValueError):
    """A request that can't be carried out."""


class Service:
    """Reads and changes of the tables ``sources``, ``items`` and ``runs``. One run at a time."""

    def __init__(self, spark: SparkSession, store: Store, now: Callable[[], datetime]) -> None:
        self.spark, self.store, self.now, self.lock = spark, store, now, threading.Lock()

    @property
    def items(self) -> DataFrame:
        return self.store.read("items", schema.NEWS_ITEMS)

    @property
    def sources(self) -> DataFrame:
        return self.store.read("sources", schema.SOURCES)

    @property
    def runs(self) -> DataFrame:
        return self.store.read("runs", schema.JOB_RUNS)

    # reads
    def feed(self, parameters: dict) -> dict:
        return feed.envelope(self.items, feed.FeedQuery.from_parameters(parameters), self.now())

    def latest(self, parameters: dict) -> DataFrame:
        q = feed.FeedQuery.from_parameters(parameters)
        return feed.latest_verified(self.items, self.now(), q.company, q.category, q.limit, q.lang)

    def digest(self, window: str | None = None, lang: str = "both") -> DataFrame:
        """Over the last week for 7d, over the last day for anything else."""
        return feed.digest(self.items, self.now() - timedelta(days=7 if window == "7d" else 1), lang)

    def companies(self) -> DataFrame:
        return feed.companies(self.sources, self.items)

    def item(self, id_: str | int) -> dict | None:
        """The item, or None if there is none; Invalid for an id that isn't a positive whole number."""
        try:
            n = int(id_)
        except (TypeError, ValueError):
            raise Invalid("bad id") from None
        if n <= 0:
            raise Invalid("bad id")
        row = feed.by_id(self.items, n).first()
        return row.asDict(True) if row else None

    def health(self) -> dict:
        """healthy, last_success_at, the latest run of the ingestion and the ten latest runs of any job."""
        h = operations.health(self.runs, JOB).first()
        latest = operations.latest_run(self.runs, JOB).first()
        recent = [r.asDict() for r in operations.recent_runs(self.runs, 10).collect()]
        return {"healthy": h.healthy, "last_success_at": h.last_success_at, "latest": latest.asDict() if latest else None, "recent": recent}

    # changes
    def put_source(self, source: dict, keep_active: bool = False) -> None:
        for field in ("company", "source_url", "source_type", "official_domain"):
            if not source.get(field):
                raise Invalid(f"{field} is missing")
        if source["source_type"] not in schema.SOURCE_TYPES:
            raise Invalid("unknown source_type")
        for field, low, high in (("priority", 0, 1000), ("crawl_interval_minutes", 1, 10080)):
            if source.get(field) is not None and not low <= source[field] <= high:
                raise Invalid(f"{field} is out of range")
        self.load_sources([source], keep_active)

    def load_sources(self, rows: list[dict], keep_active: bool = True) -> None:
        """Many sources at once; ``keep_active`` leaves what an operator switched as it is."""
        fields = ["source_url", *changes.SOURCE_FIELDS]
        kinds = {f.split(" ", 1)[0]: f.split(" ", 1)[1] for f in schema.SOURCES.split(", ")}
        new = self.spark.createDataFrame([tuple(r.get(f) for f in fields) + (i,) for i, r in enumerate(rows)], ", ".join(f"{f} {kinds[f]}" for f in fields) + ", seq int")
        self.store.write("sources", changes.upsert_sources(self.sources, new, self.now(), keep_active))

    def activate(self, terms: list[str], dry_run: bool = True) -> DataFrame:
        """The preview; with ``dry_run`` off the inactive ones among them are switched on."""
        preview = operations.activation_preview(self.sources, terms)
        if not dry_run:
            self.store.write("sources", changes.set_active(self.sources, operations.matches_terms(terms) & ~F.col("active"), self.now()))
        return preview

    def migrate(self) -> list[str]:
        """Brings the stored tables to their schemas; what was changed."""
        tables = {"sources": schema.SOURCES, "items": schema.NEWS_ITEMS, "runs": schema.JOB_RUNS}
        return [line for name, wanted in tables.items() for line in self.store.migrate(name, wanted)]

    def seed(self, path: str) -> int:
        """Loads the sources of a JSON file (an array of objects, or one object a line); known ones keep their switch. How many."""
        fields = schema.SOURCES.replace("id int, ", "", 1)
        rows = [r.asDict(True) for r in self.spark.read.schema(fields).option("multiLine", True).json(path).collect()]  # a control table
        self.load_sources(rows)
        return len(rows)

    def ingest(
        self,
        complete: Callable[[dict], str | None] | None = None,
        force: bool = False,
        ids: list[int] | None = None,
        settings: Settings | None = None,
        zones: DataFrame | None = None,
    ) -> dict:
        """Fetches the sources that are due (all active ones with ``force``, of these the named ones), reads and stores their entries."""
        s = settings or Settings()
        due = operations.run_subset(self.sources, self.now(), force, ids)
        chosen = [r.asDict(True) for r in due.select("id", "source_url", "source_type", "extra").collect()]  # a control table
        self.spark.dataSource.register(PageSource)
        options = {"timeout": s.timeout_seconds, "agent": s.user_agent, "limit": s.max_items_per_source, "robots": str(s.respect_robots).lower()}
        pages = self.spark.read.format("feed_pages").options(sources=json.dumps(chosen), **options).load()
        entries = listings.read_entries(written(pages, "pages"), s.max_items_per_source)  # fetched once
        ran = self.spark.createDataFrame([(c["id"],) for c in chosen], "source_id int")
        return self.run(entries, complete, s.model_budget, zones, ran)

    def run(
        self,
        entries: DataFrame,
        complete: Callable[[dict], str | None] | None = None,
        cap: int = 0,
        zones: DataFrame | None = None,
        ran: DataFrame | None = None,
    ) -> dict:
        """One ingestion run over read entries; its numbers. Busy while another runs.

        ``ran`` (source_id) names the sources of the run, so that those without entries are counted and marked as checked too.
        """
        if not self.lock.acquire(blocking=False):
            raise Busy("a run is going on")
        try:
            with self._job(JOB) as job:
                now, items = self.now(), self.items
                run = ingest.ingest(entries, self.sources, items, now, complete, cap, zones, ran)
                new = changes.next_ids(run.items, items, ["source_rank", "entry_pos"])
                metrics = ingest.run_metrics(run.per_source).first().asDict()
                self.store.append("items", new.select(*items.columns))
                fine = F.col("error").isNull() | (F.col("error") == DENIED)
                outcome = run.per_source.select("source_id", fine.alias("success"))
                self.store.write("sources", changes.mark_checked(self.sources, outcome, now))
                per = [r.asDict() for r in run.per_source.orderBy("source_id").collect()]  # a row for each source
                job |= metrics | {"detail": json.dumps({"perSource": per})}
                return metrics
        finally:
            self.lock.release()

    @contextmanager
    def _job(self, name: str) -> Iterator[dict]:
        """A run's row: running while the block is, then with what the block put into the dictionary; failed if it raises."""
        runs, id_ = changes.started(self.runs, name, self.now())
        self.store.write("runs", runs)
        update: dict = {"status": "failed"}
        try:
            yield update
        finally:
            self.store.write("runs", changes.finished(self.runs, id_, update, self.now()))

    def backfill(self, complete: Callable[[dict], str | None], limit: int = 10) -> int:
        """Enriches the latest verified items that wait for review; how many were updated."""
        chosen = changes.enrichable(self.items, limit)
        updates = ingest.backfilled(chosen, complete)  # asked once: the answers are written
        n = updates.count()
        self.store.write("items", changes.apply_enrichment(self.items, updates, self.now()))
        return n

    def purge(self, dry_run: bool = True, cap: int = 5000, tiers: list[changes.Tier] | None = None) -> dict:
        if dry_run:
            return changes.purge(self.items, self.now(), cap, True, tiers)[1]
        with self._job("purge") as job:
            after, counts = changes.purge(self.items, self.now(), cap, False, tiers)
            self.store.write("items", after)
            job |= {"status": "success", "detail": json.dumps({"deleted": counts})}
            return counts

    def promote(self, dry_run: bool = True, cap: int = 5000) -> int:
        if dry_run:
            return changes.promote(self.items, self.now(), cap, True)[1]
        with self._job("promote") as job:
            after, n = changes.promote(self.items, self.now(), cap, False)
            self.store.write("items", after)
            job |= {"status": "success", "items_found": n, "detail": json.dumps({"promoted": n})}
            return n
