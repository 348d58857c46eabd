"""Queries of readers, requests, enrichment and the whole ingestion, and their SQL.

Pages, feeds and responses are made from the rows of the tables, one for each row, and read again, so that SQL can say what must come
out.  What depends on constants alone is held against literal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import queries as q
from .functions import enrich, html, rules, text, url
from .operators import ingest
from .operators.store import Store
from .plans import feed
from .schema import NEWS_COLUMNS, NEWS_ITEMS
from .scratch import new_path, spread
from .sources import fetch, listings
from .streaming import ingest as stream

_add, _read, _table = q._add, q._read, q._table
_trim_sql = lambda c: f"regexp_replace({c}, '^{q.WS}+|{q.WS}+$', '', 'g')"


def _pages(rows: DataFrame, kind, body, extra=None) -> DataFrame:
    """A page for each row of raw_entries, under the row's number."""
    null = F.lit(None).cast("string")
    return rows.select(
        F.col("entry_id").cast("int").alias("source_id"), F.lit(0).alias("source_rank"), kind.alias("source_type"), body.alias("body"),
        F.lit("https://base.example").alias("base_url"), (null if extra is None else extra).alias("extra"), null.alias("error"),
    )


READ_BACK = ["title", "url", "content", "published_at", "image_url", "error"]


# feeds: a third of the entries has its image as a thumbnail, a third as an enclosure, a third within the text
def _feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spread(_read(spark, sf_dir, "raw_entries"))
    e = q._escaped
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    image = F.when(F.col("image_url").isNull(), "").when(
        F.col("entry_id") % 3 == 0, F.concat(F.lit('<media:thumbnail url="'), e("image_url"), F.lit('"/>'))
    ).when(F.col("entry_id") % 3 == 1, F.concat(F.lit('<enclosure type="image/png" url="'), e("image_url"), F.lit('"/>'))).otherwise("")
    inner = F.when(F.col("image_url").isNotNull() & (F.col("entry_id") % 3 == 2), F.concat(F.lit("<img src='"), F.col("image_url"), F.lit("'>"))).otherwise("")
    item = F.concat(
        tag("title", e("title")), tag("link", e("url")), tag("description", e(F.concat(F.col("content"), inner))),
        tag("pubDate", F.date_format(F.col("fetched_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")), image,
    )
    body = F.concat(F.lit('<rss xmlns:media="http://search.yahoo.com/mrss/"><channel>'), tag("item", item), F.lit("</channel></rss>"))
    got = listings.read_entries(_pages(t, F.lit("rss"), body))
    return got.select(F.col("source_id").alias("entry_id"), "title", "url", F.length("content").alias("length"), "published_at", "image_url", "error")


_add(
    "feed_entries",
    _feeds,
    f"""SELECT CAST(entry_id AS INT) AS entry_id, {_trim_sql('title')} AS title, {_trim_sql('url')} AS url,
          CAST(length(replace(content, chr(13) || chr(10), chr(10))) + CASE WHEN entry_id % 3 = 2 AND image_url IS NOT NULL THEN length(image_url) + 12 ELSE 0 END AS INT) AS length,
          strftime(fetched_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') AS published_at, image_url, NULL::VARCHAR AS error FROM raw_entries""",
)


# responses of a repository: releases, commits and a watched file
def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spread(_read(spark, sf_dir, "raw_entries"))
    n = F.col("entry_id") % 3
    release = F.array(F.struct(
        F.when(F.col("entry_id") % 4 != 0, F.col("title")).alias("name"), F.concat(F.lit("v"), F.col("entry_id")).alias("tag_name"), F.col("url").alias("html_url"),
        F.col("content").alias("body"), (F.col("entry_id") % 5 == 0).alias("draft"), F.col("published_at"),
    ))
    message = F.concat(F.lit("Subject "), F.col("entry_id"), F.lit("\n"), F.col("content"))
    commit = F.array(F.struct(F.col("url").alias("html_url"), F.struct(message.alias("message"), F.struct(F.col("published_at").alias("date")).alias("committer")).alias("commit")))
    watched = F.struct(F.col("url").alias("html_url"), F.lit("base64").alias("encoding"), F.base64(F.encode("content", "UTF-8")).alias("content"))
    body = F.when(n == 0, F.to_json(release)).when(n == 1, F.to_json(commit)).otherwise(F.to_json(watched))
    mode = F.when(n == 0, "releases").when(n == 1, "commits").otherwise("file")
    extra = F.concat(F.lit('{"github": {"owner": "o", "repo": "r", "path": "NEWS", "mode": "'), mode, F.lit('"}}'))
    return listings.read_entries(_pages(t, F.lit("github"), body, extra)).select(F.col("source_id").alias("entry_id"), *READ_BACK)


_add(
    "repository_entries",
    _responses,
    f"""SELECT CAST(entry_id AS INT) AS entry_id,
          CASE entry_id % 3 WHEN 0 THEN CASE WHEN entry_id % 4 <> 0 AND {_trim_sql('title')} <> '' THEN {_trim_sql('title')} ELSE 'v' || entry_id END WHEN 1 THEN 'Subject ' || entry_id ELSE 'r NEWS updated' END AS title,
          url, CASE entry_id % 3 WHEN 0 THEN CASE WHEN {_trim_sql('content')} <> '' THEN {_trim_sql('content')} WHEN entry_id % 4 <> 0 AND title <> '' THEN title ELSE 'v' || entry_id END WHEN 1 THEN 'Subject ' || entry_id || chr(10) || content ELSE content END AS content,
          CASE WHEN entry_id % 3 < 2 THEN published_at END AS published_at, NULL::VARCHAR AS image_url, NULL::VARCHAR AS error
        FROM raw_entries WHERE NOT (entry_id % 3 = 0 AND entry_id % 5 = 0)""",
)


# what can't be read says why
def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = _read(spark, sf_dir, "sources"), F.col("id") % 5
    null = F.lit(None).cast("string")
    pages = s.select(
        F.col("id").alias("source_id"), F.lit(0).alias("source_rank"), F.when(n == 0, "odd").when(n == 1, "html").when(n == 4, "github").otherwise("rss").alias("source_type"),
        F.when(n == 3, null).otherwise(F.lit("[]")).alias("body"), F.lit("https://base.example").alias("base_url"),
        F.when(n == 4, F.lit('{"github": {"mode": "stars"}}')).alias("extra"), F.when(n == 2, "HTTP 503").alias("error"),
    )
    return listings.read_entries(pages).select("source_id", "url", "error")


_add(
    "reading_failures",
    _failures,
    """SELECT id AS source_id, NULL::VARCHAR AS url, CASE id % 5 WHEN 0 THEN 'unknown source type ''odd''' WHEN 1 THEN 'a source of type ''html'' needs a configuration'
         WHEN 2 THEN 'HTTP 503' WHEN 3 THEN 'nothing was fetched' ELSE 'unknown mode ''stars''' END AS error FROM sources""",
)


def _limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array_join(F.transform(F.sequence(F.lit(1), F.col("id") % 25), lambda k: F.concat(F.lit("<li><a href='/n/"), k, F.lit("'>No "), k, F.lit("</a></li>"))), "")
    config = F.lit('{"html": {"itemSelector": "li", "dateSelector": "time"}}')
    pages = _read(spark, sf_dir, "sources").where("id % 25 > 0").select(
        F.col("id").alias("source_id"), F.lit(0).alias("source_rank"), F.lit("html").alias("source_type"), items.alias("body"),
        F.lit("https://base.example/list").alias("base_url"), config.alias("extra"), F.lit(None).cast("string").alias("error"),
    )
    return listings.read_entries(pages, 15).select("source_id", "entry_pos", "title", "url")


_add(
    "entries_limited",
    _limited,
    """SELECT id AS source_id, CAST(k - 1 AS INT) AS entry_pos, 'No ' || k AS title, 'https://base.example/n/' || k AS url
       FROM (SELECT id, unnest(range(1, least(15, id % 25) + 1)) AS k FROM sources)""",
)


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [r.asDict(True) for r in _read(spark, sf_dir, "sources").select("id", "source_type", "source_url", "extra").collect()]  # a control table
    reader = fetch._Reader({"sources": "[]", "limit": "15"})
    return spark.createDataFrame([(r["id"], reader.address(r)) for r in rows], "id int, address string")


_add(
    "fetch_addresses",
    _addresses,
    """SELECT id, CASE WHEN source_type <> 'github' OR extra.github IS NULL THEN source_url ELSE 'https://api.github.com/repos/' || extra.github.owner || '/' || extra.github.repo ||
         CASE coalesce(extra.github.mode, 'releases') WHEN 'releases' THEN '/releases?per_page=15'
           WHEN 'commits' THEN '/commits?per_page=15' || CASE WHEN extra.github.branch IS NULL THEN '' ELSE '&sha=' || extra.github.branch END
           ELSE '/contents/' || extra.github.path || CASE WHEN extra.github.branch IS NULL THEN '' ELSE '?ref=' || extra.github.branch END END END AS address FROM sources""",
)


# requests
REQUESTS = [
    ({}, (None, None, None, None, "detected_at", "desc", False, 20, 0, "both")),
    ({"company": [" A ", "B"], "limit": "7", "offset": "3.9", "verified": "YES"}, ("A", None, True, None, "detected_at", "desc", False, 7, 3, "both")),
    ({"window": "7d", "limit": "9999", "sort": "ASC", "verified": "banana"}, (None, None, False, "7d", "detected_at", "asc", False, 100, 0, "both")),
    ({"since": "24h", "window": "7d", "limit": "x", "lang": "AR"}, (None, None, None, "24h", "detected_at", "desc", False, 20, 0, "ar")),
    ({"category": "sdk", "date_field": "PUBLISHED", "status": "published", "offset": "-4"}, (None, "sdk", None, None, "published_at", "desc", True, 20, 0, "both")),
    ({"lang": "de", "limit": "0", "company": "  "}, (None, None, None, None, "detected_at", "desc", False, 1, 0, "both")),
]
_REQUEST = "company string, category string, verified string, since string, date_field string, sort string, published_only boolean, page_limit int, skip int, lang string"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for i, (p, _) in enumerate(REQUESTS):
        f = feed.FeedQuery.from_parameters(p)
        verified = None if f.verified is None else str(f.verified).lower()
        rows.append((i, f.company, f.category, verified, f.since, f.date_field, f.sort, f.published_only, feed.clamp_limit(f.limit), max(0, f.offset or 0), f.lang))
    return spark.createDataFrame(rows, "n int, " + _REQUEST)


def _literal(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower()  # truth values cast to texts alike


_KINDS = {"string": "VARCHAR", "boolean": "BOOLEAN", "int": "INT"}
_NAMED = [c.split() for c in _REQUEST.split(", ")]
_add(
    "request_parameters",
    _requests,
    " UNION ALL ".join(f"SELECT {i} AS n, " + ", ".join(f"{_literal(v)}::{_KINDS[k]} AS {c}" for v, (c, k) in zip(want, _NAMED)) for i, (_, want) in enumerate(REQUESTS)),
)


def _envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = feed.envelope(_read(spark, sf_dir, "news_items"), feed.FeedQuery(verified=True, limit=40, offset=20, lang="en"), q.NOW)
    p = e["pagination"]
    row = (p["limit"], p["offset"], p["total"], p["has_more"], p["next_offset"], ",".join(str(r["id"]) for r in e["data"]), len([r for r in e["data"] if r["title_ar"] is None]))
    return spark.createDataFrame([row], "page_limit int, skip int, total bigint, has_more boolean, next_offset int, ids string, without_ar int")


_add(
    "feed_envelope",
    _envelope,
    """WITH m AS (SELECT * FROM news_items WHERE status NOT IN ('ignored', 'duplicate') AND verified), p AS (SELECT * FROM m ORDER BY detected_at DESC, id DESC LIMIT 40 OFFSET 20),
       c AS (SELECT (SELECT count(*) FROM m) AS total, (SELECT count(*) FROM p) AS n)
       SELECT CAST(40 AS INT) AS page_limit, CAST(20 AS INT) AS skip, total, 20 + n < total AS has_more, CAST(CASE WHEN 20 + n < total THEN 20 + n END AS INT) AS next_offset,
         (SELECT coalesce(string_agg(id::VARCHAR, ',' ORDER BY detected_at DESC, id DESC), '') FROM p) AS ids, CAST(n AS INT) AS without_ar FROM c""",
)

# texts, links and images
_add("entry_texts_exact", _table("raw_entries", lambda t: spread(t).select("entry_id", html.html_to_text(F.col("content")).alias("body"))), f"SELECT entry_id, {q.NATIVE_SQL} AS body FROM raw_entries")
_add(
    "source_names",
    _table("sources", lambda t: t.select("id", text.source_name(F.col("company"), F.col("product")).alias("source_name"))),
    "SELECT id, CASE WHEN product IS NULL OR product = '' THEN company ELSE company || ' · ' || product END AS source_name FROM sources",
)


def _links(t: DataFrame) -> DataFrame:
    n, k = F.col("entry_id") % 8, F.col("entry_id").cast("string")
    href = (
        F.when(n == 0, F.concat(F.lit("/p/"), k)).when(n == 1, F.concat(F.lit("../up/"), k)).when(n == 2, F.concat(F.lit("?q="), k)).when(n == 3, F.concat(F.lit("//cdn.example/"), k))
        .when(n == 4, F.concat(F.lit(" https://x.example/"), k, F.lit("#f "))).when(n == 5, F.concat(F.lit("data:image/png;base64,"), k)).when(n == 6, F.lit("")).otherwise(F.lit(None))
    )
    base = F.lit("https://base.example/a/b")
    return t.select("entry_id", url.resolve_url(F.when(n < 5, href), base).alias("link"), url.clean_image_url(href, base).alias("image"))


_add(
    "resolved_links",
    _table("raw_entries", _links),
    """WITH r AS (SELECT entry_id, CASE entry_id % 8 WHEN 0 THEN 'https://base.example/p/' || entry_id WHEN 1 THEN 'https://base.example/up/' || entry_id
         WHEN 2 THEN 'https://base.example/a/b?q=' || entry_id WHEN 3 THEN 'https://cdn.example/' || entry_id WHEN 4 THEN 'https://x.example/' || entry_id || '#f' END AS link FROM raw_entries)
       SELECT entry_id, link, link AS image FROM r""",
)


def _cleaned_tags(t: DataFrame) -> DataFrame:
    raw = F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit("  MiXed "), F.lit(""), F.repeat(F.lit("x"), 41), F.upper("company"), F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"), F.lit("e")))
    return t.select("id", F.array_join(enrich.clean_tags(raw), "|").alias("tags"), F.size(enrich.clean_tags(F.lit(None).cast("array<string>"))).alias("of_null"))


_add(
    "cleaned_tags",
    _table("news_items", _cleaned_tags),
    """SELECT id, array_to_string(list_filter(list_transform(list_concat(coalesce(tags, []), ['  MiXed ', '', repeat('x', 41), upper(company), 'a', 'b', 'c', 'd', 'e']),
         lambda t: trim(lower(t))), lambda t: length(t) BETWEEN 1 AND 40)[1:8], '|') AS tags, CAST(0 AS INT) AS of_null FROM news_items""",
)


# enrichment without a model, and the whole pipeline
def _tags_sql(rows: str, key: str, words: str) -> str:
    """key, tags of the column ``words`` of ``rows``, by the pieces of the query tags."""
    found = f"regexp_extract_all({words}, '[a-z][a-z0-9+.-]{{2,}}')"
    return f"""(WITH w AS (SELECT {key}, unnest({found}) AS w, generate_subscripts({found}, 1) AS i FROM {rows}),
        c AS (SELECT {key}, w, count(*) AS n, min(i) AS i FROM w WHERE NOT list_contains({q._STOP}, w) GROUP BY {key}, w),
        k AS (SELECT {key}, t, g AS i FROM (SELECT {key}, {words} AS x, unnest({q._KNOWN}) AS t, generate_subscripts({q._KNOWN}, 1) AS g FROM {rows}) WHERE contains(x, t)),
        a AS (SELECT {key}, t AS w, 0 AS g, 0 AS n, i FROM k UNION ALL SELECT {key}, w, 1, -n, i FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.{key} = c.{key} AND k.t = c.w)),
        r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY g, n, i) AS p FROM a)
        SELECT {key}, string_agg(w, '|' ORDER BY p) AS tags FROM r WHERE p <= 6 GROUP BY {key})"""


_EXCERPT = """CASE WHEN length({0}) <= 280 THEN {0} ELSE regexp_replace(CASE WHEN strpos(reverse(left({0}, 280)), ' ') > 0 AND 280 - strpos(reverse(left({0}, 280)), ' ') > 168
    THEN left({0}, 280 - strpos(reverse(left({0}, 280)), ' ')) ELSE left({0}, 280) END, '^{1}+|{1}+$', '', 'g') || '…' END"""


def _fallback(t: DataFrame) -> DataFrame:
    e = spread(t).select("id", enrich.fallback(F.col("title_original"), F.col("content_original")).alias("e"))
    return e.select("id", "e.category", "e.impact", F.array_join("e.tags", "|").alias("tags"), "e.title_ar", "e.summary_en", "e.confidence")


_add(
    "fallback_enrichment",
    _table("news_items", _fallback),
    f"""WITH d AS (SELECT id, title_original, content_original AS c, {q.TEXT_SQL} AS x, lower({q.TEXT_SQL}) AS low, replace({q._collapse_sql('title_original')}, chr(10), ' ') AS name FROM news_items)
        SELECT d.id, {q._case_sql('x', rules.CATEGORY_RULES, 'product')} AS category, {q._case_sql('x', rules.IMPACT_RULES, 'low')} AS impact, coalesce(tags, '') AS tags, name AS title_ar,
          CASE WHEN c = '' THEN {_EXCERPT.format('name', q.WS)} ELSE {_EXCERPT.format('c', q.WS)} END AS summary_en, CAST(0.2 AS DOUBLE) AS confidence
        FROM d LEFT JOIN {_tags_sql('d', 'id', 'low')} t ON t.id = d.id""",
)
# each entry with what the run makes of it
_TAGGED = f"""WITH e AS (SELECT r.entry_id, r.source_id, r.fetched_at, s.company, s.product, s.official_domain, c.url, c.host, replace({q._collapse_sql('r.title')}, chr(10), ' ') AS title,
    {q.NATIVE_SQL.replace('content', 'r.content')} AS body, r.content FROM raw_entries r JOIN sources s ON s.id = r.source_id JOIN {q.CANONICAL_SQL} c USING (entry_id)),
  h AS (SELECT *, sha256(url || chr(10) || lower({q._collapse_sql('title')}) || chr(10) || lower({q._collapse_sql('body')})) AS content_hash, title || chr(10) || body AS x,
    list_filter(regexp_split_to_array(title, '\\s+'), lambda w: w <> '') AS ws,
    length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '(?is)full changelog:?.*', '', 'g'), 'https?://[^\\s]+', '', 'g'), '[*#`>_~\\-]+', ' ', 'g'), '{q.WS}+', ' ', 'g'))) < 30 AS bare FROM e),
  b AS (SELECT *, list_filter(list_transform(ws, lambda w: regexp_replace(regexp_replace(w, '^[(\\[{{]+', ''), '[:•·,)\\]}}]+$', '')), lambda w: w <> '') AS vs FROM h),
  v AS (SELECT * EXCLUDE (bare, ws, vs), bare AND len(ws) BETWEEN 1 AND 4 AND len(list_filter(vs, lambda w: NOT ({q._VERSION} OR {q._NOISE}))) = 0 AND len(list_filter(vs, lambda w: {q._VERSION})) > 0 AS bare,
    content_hash IN (SELECT n.content_hash FROM news_items n WHERE n.content_hash IS NOT NULL) AS known FROM b),
  t AS (SELECT *, CASE WHEN known OR (fetched_at, entry_id) > min((fetched_at, entry_id)) FILTER (WHERE NOT known AND NOT bare) OVER (PARTITION BY content_hash) THEN 'duplicate'
    WHEN bare THEN 'contentless' ELSE 'new' END AS reason,
    coalesce(official_domain <> '' AND (regexp_replace(host, '^www\\.', '') = regexp_replace(lower(official_domain), '^www\\.', '') OR ends_with(host, '.' || regexp_replace(lower(official_domain), '^www\\.', ''))), false) AS verified
    FROM v)"""


def _run(spark: SparkSession, sf_dir: str) -> ingest.Run:
    read = lambda name: _read(spark, sf_dir, name)
    return ingest.ingest(ingest.arrivals(read("raw_entries")), read("sources"), read("news_items"), q.NOW, zones=read("source_zones"))


ITEM = ["title_original", "official_source_url", "content_original", "source_name", "source_language", "category", "impact_level", "verified", "status", "content_hash"]
_add(
    "ingested",
    lambda s, d: _run(s, d).items.select(
        "source_id", F.col("entry_pos").alias("entry_id"), *ITEM, "title_ar", "summary_en", "image_url", F.array_join("tags", "|").alias("tags")
    ),
    f"""{_TAGGED}, i AS (SELECT *, lower(x) AS low FROM t WHERE reason = 'new'), n AS (SELECT i.*, g.tags, CASE WHEN body = '' THEN {_EXCERPT.format('title', q.WS)} ELSE {_EXCERPT.format('body', q.WS)} END AS excerpt
          FROM i LEFT JOIN {_tags_sql('i', 'entry_id', 'low')} g ON g.entry_id = i.entry_id)
        SELECT n.source_id, n.entry_id, n.title AS title_original, n.url AS official_source_url, n.content AS content_original,
          CASE WHEN product IS NULL OR product = '' THEN company ELSE company || ' · ' || product END AS source_name,
          CASE WHEN length(regexp_replace(x, '[^\\x{{600}}-\\x{{6ff}}]', '', 'g')) > length(regexp_replace(x, '[^A-Za-z]', '', 'g')) THEN 'ar' ELSE 'en' END AS source_language,
          CASE WHEN verified THEN {q._case_sql('x', rules.CATEGORY_RULES, 'product')} END AS category, CASE WHEN verified THEN {q._case_sql('x', rules.IMPACT_RULES, 'low')} ELSE 'low' END AS impact_level,
          verified, 'needs_review' AS status, content_hash, CASE WHEN verified THEN n.title END AS title_ar, CASE WHEN verified THEN excerpt END AS summary_en, r.image_url,
          CASE WHEN verified THEN coalesce(n.tags, '') ELSE '' END AS tags FROM n JOIN raw_entries r ON r.entry_id = n.entry_id""",
)
_add("ingested_dates", lambda s, d: _run(s, d).items.select(F.col("entry_pos").alias("entry_id"), q.iso(F.col("published_at")).alias("published_at"), q.iso(F.col("detected_at")).alias("detected_at")))
_PER = """p AS (SELECT source_id, count(*) AS found, count(*) FILTER (WHERE reason = 'new') AS inserted, count(*) FILTER (WHERE reason <> 'new') AS skipped, NULL::VARCHAR AS error FROM t GROUP BY source_id)"""
_add("ingest_per_source", lambda s, d: _run(s, d).per_source, f"{_TAGGED}, {_PER} SELECT * FROM p")


def _with_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run with every fifth source failing instead of yielding, and all sources among those of the run."""
    read = lambda name: _read(spark, sf_dir, name)
    entries = ingest.arrivals(read("raw_entries")).withColumn("error", F.lit(None).cast("string")).where("source_id % 5 <> 0")
    blank = {c: F.lit(None) for c in entries.columns if c not in ("source_id", "error")}
    failed = read("sources").where("id % 5 = 0").select(F.col("id").alias("source_id"), F.when(F.col("id") % 10 == 0, fetch.DENIED).otherwise("HTTP 500").alias("error")).withColumns(blank)
    run = ingest.ingest(entries.unionByName(failed), read("sources"), read("news_items"), q.NOW, ran=read("sources").select(F.col("id").alias("source_id")))
    return ingest.run_metrics(run.per_source)


_add(
    "run_metrics",
    _with_failures,
    f"""{_TAGGED.replace('FROM raw_entries r JOIN', 'FROM (SELECT * FROM raw_entries WHERE source_id % 5 <> 0) r JOIN')}, m AS (SELECT count(*) AS found, count(*) FILTER (WHERE reason = 'new') AS ins FROM t)
        SELECT (SELECT count(*) FROM sources) AS sources_checked, found AS items_found, ins AS items_inserted, found - ins AS items_skipped,
          (SELECT count(*) FROM sources WHERE id % 5 = 0 AND id % 10 <> 0) AS errors, CASE WHEN (SELECT count(*) FROM sources WHERE id % 5 = 0 AND id % 10 <> 0) = 0 THEN 'success' ELSE 'partial' END AS status FROM m""",
)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run as a stream: all raw entries landed in files, taken in by micro-batches."""
    landing, store = new_path(spark, "landing"), Store(spark, new_path(spark, "store"))
    ingest.arrivals(_read(spark, sf_dir, "raw_entries")).drop("fetched_at").write.parquet(landing)
    store.write("items", _read(spark, sf_dir, "news_items").select(*NEWS_COLUMNS))
    stream.start(spark, landing, _read(spark, sf_dir, "sources"), store, new_path(spark, "progress"), lambda: q.NOW).awaitTermination()
    return store.read("items", NEWS_ITEMS).select("id", "title_original", "status", "content_hash")


_add(
    "stream_ingested",
    _streamed,
    f"""{_TAGGED} SELECT id, title_original, status, content_hash FROM news_items
        UNION ALL SELECT CAST((SELECT max(id) FROM news_items) + row_number() OVER (ORDER BY fetched_at, entry_id) AS INT), title, 'needs_review', content_hash FROM t WHERE reason = 'new'""",
)
