"""From raw entries to stored items as one plan: normalise, hash, drop repeats, drop bare versions, verify, enrich, gate.

The cheap steps come first, so that a model (an injected function) sees only new, verified rows within its budget.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import enrich, rules, text, url
from ..functions.html import text_of
from ..schema import NEWS_COLUMNS
from ..scratch import spread, written
from . import timestamps

SOURCE_CONTEXT = ["company", "product", "official_domain", "source_type"]


READ = "official_source_url string, body string, image_url string"


def _read_texts(entries: DataFrame) -> DataFrame:
    """Entries with the columns that need a parser, all made in one Arrow pass: canonical address, plain text, image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for address, content, image in zip(*(b.column(c).to_pylist() for c in ("url", "content", "image_url"))):
                canonical = url.canonicalize(address or "")
                out.append((canonical, text_of(content or ""), url.clean_image(image, canonical)))
            keep = [c for c in b.schema.names if c not in ("url", "image_url")]
            columns = [pa.array(c, pa.string()) for c in (zip(*out) if out else ([], [], []))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *columns], names=[*keep, "official_source_url", "body", "image_url"])

    kept = [f for f in entries.schema.fields if f.name not in ("url", "image_url")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", " + READ
    return entries.mapInArrow(run, schema)


def normalise(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Entries (source_id, source_rank, entry_pos, title, url, content, published_at text, image_url) with their source's context and
    the columns of an item: clean title, canonical address, body, language, hash. Entries of unknown sources are left out; null
    texts count as empty, but the stored content keeps what was fetched ('' for null). The text of the date is kept as published_text."""
    s = sources.select(F.col("id").alias("source_id"), *SOURCE_CONTEXT)
    e = spread(entries).join(s, "source_id").withColumn("title_original", text.normalize_title(F.coalesce("title", F.lit("")))).drop("title")
    e = _read_texts(e.withColumnRenamed("published_at", "published_text"))
    e = e.withColumn("content_original", F.coalesce("content", F.lit(""))).drop("content")
    return e.withColumns({
        "source_name": text.source_name(F.col("company"), F.col("product")),
        "source_language": text.detect_language(F.concat("title_original", F.lit("\n"), "body")),
        "content_hash": text.content_hash(F.col("official_source_url"), F.col("title_original"), F.col("body")),
    })


def dated(rows: DataFrame, now: datetime, zones: DataFrame | None = None) -> DataFrame:
    """Normalised entries with published_at, an instant, in place of published_text.

    zones: source_id, zone_name, day_first; a source without a row there writes UTC and the month before the day.  Distances in
    time count from fetched_at, or from ``now`` where the entries have none.  Texts that denote no moment give null.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source_id", "source_rank", "entry_pos")))
    fetched = F.coalesce(F.col("fetched_at") if "fetched_at" in rows.columns else F.lit(None), F.lit(now).cast("timestamp"))
    texts = rows.select(key.alias("entry_id"), "source_id", F.col("published_text").alias("published_at"), fetched.alias("fetched_at"))
    found = timestamps.normalise(texts, zones, day_first=False)
    found = found.groupBy(F.col("entry_id").alias("_key")).agg(F.timestamp_micros(F.min("micros")).alias("published_at"))
    return rows.join(found, key == F.col("_key"), "left").drop("_key", "published_text")


def reasons(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """Normalised entries with ``reason``: duplicate (stored, or seen earlier in this run), contentless, or new.

    An entry repeats an earlier one only if that one was stored, so bare versions don't make later ones duplicates.
    """
    # of the stored hashes only those that arrive again are kept, so that the store itself isn't shuffled
    hashes = entries.select("content_hash").where(F.col("content_hash").isNotNull()).distinct()
    known = stored.select("content_hash").join(hashes, "content_hash", "left_semi").distinct().withColumn("known", F.lit(True))
    e = entries.join(known, "content_hash", "left")
    bare = rules.is_contentless(F.col("title_original"), F.col("body"))
    e = e.withColumn("bare", bare)
    order = F.struct("source_rank", "entry_pos")
    heads = e.where(F.col("known").isNull() & ~F.col("bare")).groupBy("content_hash").agg(F.min(order).alias("head"))
    e = e.join(heads, "content_hash", "left")
    reason = F.when(F.col("known") | (F.col("head") < order), "duplicate").when(F.col("bare"), "contentless").otherwise("new")
    return e.withColumn("reason", reason).drop("known", "head", "bare")


def within_budget(rows: DataFrame, cap: int) -> DataFrame:
    """``rows`` with ``in_budget``: true for the first ``cap`` in arrival order (0: for all).

    The last arrival within the budget is found by a top-k, so the order of all rows is never made in one place.
    """
    if cap <= 0:
        return rows.withColumn("in_budget", F.lit(True))
    last = rows.select("source_rank", "entry_pos").orderBy("source_rank", "entry_pos").limit(cap).agg(F.max(F.struct("source_rank", "entry_pos")).alias("last")).first()["last"]
    if last is None:
        return rows.withColumn("in_budget", F.lit(True))
    rank, pos = last
    return rows.withColumn("in_budget", F.coalesce((F.col("source_rank") < rank) | ((F.col("source_rank") == rank) & (F.col("entry_pos") <= pos)), F.lit(False)))


def ask(rows: DataFrame, complete: Callable[[dict], str | None], most: int = 6000) -> DataFrame:
    """``rows`` with ``answer``: what the injected function says to each (company, product, title, body, language); null if it fails."""
    asked = rows.select("*", text.truncate(F.col("body"), most).alias("_body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            answers = []
            for r in b.select(["company", "product", "title_original", "_body", "source_language"]).to_pylist():
                try:
                    answers.append(complete({"company": r["company"], "product": r["product"], "title": r["title_original"], "body": r["_body"], "language": r["source_language"]}))
                except Exception:  # a failed call falls back like an unusable answer
                    answers.append(None)
            keep = [c for c in b.schema.names if c != "_body"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(answers, pa.string())], names=[*keep, "answer"])

    return asked.mapInArrow(run, StructType([*rows.schema.fields, StructField("answer", StringType())]))


def enriched(new: DataFrame, complete: Callable[[dict], str | None] | None = None, cap: int = 0) -> DataFrame:
    """New entries with verified, status and the enrichment columns; only verified rows are enriched, and only ``cap`` of them by the model."""
    e = new.withColumn("verified", url.on_official_domain(F.col("official_source_url"), F.col("official_domain")))
    inside = within_budget(e.where("verified"), cap)
    if complete is None:
        inside = inside.withColumn("answer", F.lit(None).cast("string"))
    else:
        asked = written(ask(inside.where("in_budget"), complete), "answers")  # each call is paid for, so the plan must not run twice
        inside = asked.unionByName(inside.where("not in_budget").withColumn("answer", F.lit(None).cast("string")))
    fb = enrich.fallback(F.col("title_original"), F.col("body"))
    inside = inside.withColumn("fb", fb).withColumn("en", enrich.normalized(enrich.extract_json(F.col("answer")), F.col("fb"))).drop("fb", "answer")
    none = F.lit(None)
    outside = e.where("not verified").withColumns({"in_budget": F.lit(False), "en": none.cast(f"struct<{', '.join(':'.join(x.split()) for x in enrich.ENRICHMENT.split(', '))}>")})
    both = inside.unionByName(outside)
    conf = F.coalesce(F.col("en.confidence"), F.lit(0.2))
    return both.withColumns({
        "category": F.col("en.category"), "tags": F.coalesce(F.col("en.tags"), F.array().cast("array<string>")), "impact_level": F.coalesce(F.col("en.impact"), F.lit("low")),
        "title_ar": F.col("en.title_ar"), "title_en": F.col("en.title_en"), "summary_ar": F.col("en.summary_ar"), "summary_en": F.col("en.summary_en"),
        "status": enrich.status(F.col("verified"), conf, conf),
    }).drop("en")


def backfilled(items: DataFrame, complete: Callable[[dict], str | None]) -> DataFrame:
    """Updates (id and the enrichment columns) for stored items, asked of the model with their text, or their title where they have none.

    Items whose call fails get the rules' result and stay in review.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text_at = b.schema.get_field_index("content_original")
            bodies = [text_of(c or "") or t for c, t in zip(b.column(text_at).to_pylist(), b.column("title_original").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bodies, pa.string())], names=[*b.schema.names, "body"])

    rows = items.select("id", "company", "product", "title_original", "content_original", "source_language", "verified")
    rows = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("body", StringType())]))
    fb = enrich.fallback(F.col("title_original"), F.col("body"))
    done = written(ask(rows, complete), "answers").withColumn("fb", fb).withColumn("en", enrich.normalized(enrich.extract_json(F.col("answer")), F.col("fb")))
    conf = F.col("en.confidence")
    return done.select("id", "en.title_ar", "en.title_en", "en.summary_ar", "en.summary_en", "en.category", "en.tags", F.col("en.impact").alias("impact_level"), enrich.status(F.col("verified"), conf, conf).alias("status"))


@dataclass
class Run:
    """What a run yields: the items to insert (ids still to be given), the tagged entries, and per-source numbers."""

    items: DataFrame
    tagged: DataFrame
    per_source: DataFrame


def ingest(
    entries: DataFrame,
    sources: DataFrame,
    stored: DataFrame,
    now: datetime,
    complete: Callable[[dict], str | None] | None = None,
    cap: int = 0,
    zones: DataFrame | None = None,
    ran: DataFrame | None = None,
) -> Run:
    """One run over read entries; rows of ``entries`` with an ``error`` mark sources that failed and hold no entry.

    ran: source_id of the sources of the run, which are then counted even if they yielded nothing.  ``complete`` is called once
    for each entry within the budget (a task that fails is run again, and asks again).
    """
    has_error = "error" in entries.columns
    good = entries.where(F.col("error").isNull()).drop("error") if has_error else entries
    tagged = written(reasons(written(normalise(good, sources), "entries"), stored), "tagged")  # read again by the items and the numbers
    done = enriched(dated(tagged.where("reason = 'new'"), now, zones), complete, cap)
    stamp = F.lit(now).cast("timestamp")
    columns = [stamp.alias(c) if c in ("detected_at", "created_at", "updated_at") else F.col(c) for c in NEWS_COLUMNS if c != "id"]
    items = done.select("source_rank", "entry_pos", "in_budget", *columns)
    return Run(items, tagged, per_source(tagged, entries if has_error else None, ran))


def per_source(tagged: DataFrame, entries: DataFrame | None = None, ran: DataFrame | None = None) -> DataFrame:
    """source_id, found, inserted, skipped, error: one row for each source of the run (``ran``), that yielded entries, or that failed."""
    is_new = F.col("reason") == "new"
    n = tagged.groupBy("source_id").agg(F.count("*").alias("found"), F.count_if(is_new).alias("inserted"), F.count_if(~is_new).alias("skipped"))
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("string")
    bad = n.select("source_id", none.alias("error")).limit(0) if entries is None else entries.where(F.col("error").isNotNull()).groupBy("source_id").agg(F.min("error").alias("error"))
    out = n.join(bad, "source_id", "full")
    if ran is not None:
        out = out.join(ran.select("source_id").distinct(), "source_id", "full")
    return out.select("source_id", *[F.coalesce(c, zero).alias(c) for c in ("found", "inserted", "skipped")], "error")


def run_metrics(per: DataFrame, denied: str = "disallowed-by-robots") -> DataFrame:
    """One row: sources_checked, items_found, items_inserted, items_skipped, errors, status. A source that robots.txt closes isn't an error."""
    failed = F.col("error").isNotNull() & (F.col("error") != denied)
    zero = F.lit(0).cast("bigint")
    m = per.agg(F.count("*").alias("sources_checked"), *[F.coalesce(F.sum(a), zero).alias(b) for a, b in (("found", "items_found"), ("inserted", "items_inserted"), ("skipped", "items_skipped"))], F.count_if(failed).alias("errors"))
    return m.withColumn("status", F.when(F.col("errors") == 0, "success").when((F.col("items_inserted") > 0) | (F.col("sources_checked") > F.col("errors")), "partial").otherwise("failed"))


def arrivals(raw: DataFrame) -> DataFrame:
    """raw_entries as read entries: the fetch decides the order (the day's rank), then the entry's number."""
    return raw.select("source_id", F.unix_micros("fetched_at").alias("source_rank"), F.col("entry_id").alias("entry_pos"), "title", "url", "content", "published_at", "image_url", "fetched_at")
