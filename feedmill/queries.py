"""The operators over the service's tables, and their SQL where a query engine can express them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import enrich, html, rules, text, url
from .operators import changes, ingest, timestamps
from .plans import feed, operations
from .schema import iso
from .scratch import spread
from .sources import listings, robots

NOW = datetime(2026, 5, 1, tzinfo=timezone.utc)
NOW_SQL = "TIMESTAMPTZ '2026-05-01 00:00:00+00'"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _table(name: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(_read(spark, sf_dir, name))


ISO_SQL = "strftime({} AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%gZ')"
PAGE = ["id", "company", "product", "title_original", "category", "impact_level", "status"]
PAGE_SQL = ", ".join(PAGE)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _page(q: feed.FeedQuery) -> Callable[[SparkSession, str], DataFrame]:
    return _table("news_items", lambda t: feed.page(t, q, NOW).select(*PAGE))


# pages of the feed
_add("feed_default", _page(feed.FeedQuery()), f"SELECT {PAGE_SQL} FROM news_items WHERE status NOT IN ('ignored', 'duplicate') ORDER BY detected_at DESC NULLS LAST, id DESC LIMIT 20")
_add(
    "feed_filtered",
    _page(feed.FeedQuery(company="HALIDUNE", category="security", impact="low", verified=True, since="700d", to="2026-04-01", limit=100)),
    f"""SELECT {PAGE_SQL} FROM news_items WHERE status NOT IN ('ignored', 'duplicate') AND lower(company) = 'halidune' AND category = 'security' AND impact_level = 'low' AND verified
        AND detected_at >= {NOW_SQL} - INTERVAL 700 DAY AND detected_at <= TIMESTAMPTZ '2026-04-01 00:00:00+00' ORDER BY detected_at DESC NULLS LAST, id DESC LIMIT 100""",
)
_add(
    "feed_published_asc",
    _page(feed.FeedQuery(published_only=True, date_field="published_at", sort="asc", limit=40, offset=25)),
    f"SELECT {PAGE_SQL} FROM news_items WHERE status = 'published' ORDER BY published_at ASC NULLS LAST, id ASC LIMIT 40 OFFSET 25",
)
_add("feed_tag", _page(feed.FeedQuery(tag="sdk", limit=100)), f"SELECT {PAGE_SQL} FROM news_items WHERE status NOT IN ('ignored', 'duplicate') AND list_contains(tags, 'sdk') ORDER BY detected_at DESC NULLS LAST, id DESC LIMIT 100")
_add(
    "feed_ignored_filters",
    _page(feed.FeedQuery(category="nonsense", impact="HIGH", from_="soon", since="1h", limit=30)),
    f"SELECT {PAGE_SQL} FROM news_items WHERE status NOT IN ('ignored', 'duplicate') ORDER BY detected_at DESC NULLS LAST, id DESC LIMIT 30",
)
_add(
    "feed_count",
    _table("news_items", lambda t: feed.count(t, feed.FeedQuery(verified=True, date_field="published_at", since="52w"), NOW)),
    f"SELECT count(*) AS total FROM news_items WHERE status NOT IN ('ignored', 'duplicate') AND verified AND published_at >= {NOW_SQL} - INTERVAL 364 DAY",
)
SHOWN_SQL = f"""id, company, product, title_original AS title, {{}}, source_name, official_source_url AS source_url, image_url, category,
    coalesce(array_to_string(tags, '|'), '') AS tags, impact_level, verified, status, {ISO_SQL.format('published_at')} AS published_at, {ISO_SQL.format('detected_at')} AS detected_at"""
_add(
    "items_shown_ar",
    _table("news_items", lambda t: feed.shown(t, "ar").withColumn("tags", F.array_join("tags", "|"))),
    f"SELECT {SHOWN_SQL.format('title_ar, NULL::VARCHAR AS title_en, summary_ar, NULL::VARCHAR AS summary_en')} FROM news_items",
)
_add(
    "item_by_id",
    _table("news_items", lambda t: feed.by_id(t, 7).withColumn("tags", F.array_join("tags", "|"))),
    f"""SELECT {SHOWN_SQL.format('title_ar, title_en, summary_ar, summary_en')}, content_hash, source_id, {ISO_SQL.format('created_at')} AS created_at, {ISO_SQL.format('updated_at')} AS updated_at
        FROM news_items WHERE id = 7""",
)
_add(
    "latest_verified",
    _table("news_items", lambda t: feed.latest_verified(t, NOW, category="sdk", limit=50).withColumn("tags", F.array_join("tags", "|"))),
    f"""SELECT {SHOWN_SQL.format('title_ar, title_en, summary_ar, summary_en')} FROM
        (SELECT * FROM news_items n WHERE n.status = 'published' AND n.verified AND n.category = 'sdk' ORDER BY n.detected_at DESC NULLS LAST, n.id DESC LIMIT 50)""",
)

# grouped reads
SINCE = datetime(2025, 5, 1, tzinfo=timezone.utc)
SINCE_SQL = "TIMESTAMPTZ '2025-05-01 00:00:00+00'"
_add(
    "digest_counts",
    _table("news_items", lambda t: feed.digest_counts(t, SINCE)),
    f"""SELECT company, coalesce(category, 'uncategorized') AS category, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY company) AS BIGINT) AS total
        FROM news_items WHERE status = 'published' AND detected_at >= {SINCE_SQL} GROUP BY company, category""",
)
_add(
    "digest",
    _table("news_items", lambda t: feed.digest(t, SINCE).select("company", "total", F.posexplode("categories").alias("pos", "c")).select("company", "total", "pos", "c.category", "c.count", F.array_join(F.transform("c.items", lambda x: x["id"].cast("string")), ",").alias("ids"))),
    f"""WITH f AS (SELECT company, category, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY detected_at DESC, id DESC) AS ids FROM news_items
          WHERE status = 'published' AND detected_at >= {SINCE_SQL} GROUP BY company, category)
        SELECT company, CAST(sum(n) OVER (PARTITION BY company) AS BIGINT) AS total, CAST(row_number() OVER (PARTITION BY company ORDER BY n DESC, category ASC NULLS LAST) - 1 AS INT) AS pos,
          coalesce(category, 'uncategorized') AS category, n AS "count", ids FROM f""",
)
_add(
    "companies_overview",
    lambda s, d: feed.companies(_read(s, d, "sources"), _read(s, d, "news_items")).withColumns({"products": F.array_join("products", "|"), "last_checked_at": iso(F.col("last_checked_at")), "latest_detected_at": iso(F.col("latest_detected_at"))}),
    f"""WITH s AS (SELECT company, count(*) FILTER (WHERE active) AS active_sources, count(*) AS total_sources, coalesce(string_agg(DISTINCT product, '|' ORDER BY product), '') AS products,
          max(last_checked_at) AS lc FROM sources GROUP BY company)
        SELECT s.company, active_sources, total_sources, products, {ISO_SQL.format('lc')} AS last_checked_at, t.title_original AS latest_title, {ISO_SQL.format('t.detected_at')} AS latest_detected_at
        FROM s LEFT JOIN LATERAL (SELECT n.title_original, n.detected_at FROM news_items n WHERE n.company = s.company AND n.status NOT IN ('ignored', 'duplicate')
          ORDER BY n.detected_at DESC, n.id DESC LIMIT 1) t ON true""",
)

# sources and runs
DUE = datetime(2026, 4, 30, 12, tzinfo=timezone.utc)
DUE_SQL = "TIMESTAMPTZ '2026-04-30 12:00:00+00'"
_add("sources_ordered", _table("sources", lambda t: operations.ordered_sources(t).select("id", "company", "product", "source_type")), "SELECT id, company, product, source_type FROM sources ORDER BY company, product NULLS FIRST, id")
_add(
    "due_sources",
    _table("sources", lambda t: operations.due_sources(t, DUE).select("id", "company", "priority")),
    f"SELECT id, company, priority FROM sources WHERE active AND (last_checked_at IS NULL OR last_checked_at <= {DUE_SQL} - to_minutes(crawl_interval_minutes)) ORDER BY priority, last_checked_at NULLS FIRST",
)
_add("run_subset", _table("sources", lambda t: operations.run_subset(t, DUE, True, list(range(1, 60, 3))).select("id")), "SELECT id FROM sources WHERE active AND id < 60 AND id % 3 = 1")
TERMS = ["DOCS", "rss", "loom%news"]
_add(
    "activation_preview",
    _table("sources", lambda t: operations.activation_preview(t, TERMS).select("id", "company", "product", "active")),
    "SELECT id, company, product, active FROM sources WHERE " + " OR ".join(f"lower({c}) LIKE '%{x.lower()}%'" for x in TERMS for c in ("company", "coalesce(product, '')", "source_url")),
)
_add(
    "sources_activated",
    _table("sources", lambda t: changes.set_active(t, operations.matches_terms(["docs"]) & ~F.col("active"), NOW).select("id", "active", iso(F.col("updated_at")).alias("updated_at"))),
    f"""WITH h AS (SELECT *, NOT active AND (lower(company) LIKE '%docs%' OR lower(coalesce(product, '')) LIKE '%docs%' OR lower(source_url) LIKE '%docs%') AS hit FROM sources)
        SELECT id, active OR hit AS active, {ISO_SQL.format(f'CASE WHEN hit THEN {NOW_SQL} ELSE updated_at END')} AS updated_at FROM h""",
)


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "sources")
    old = s.where("id % 4 = 0").select(F.concat("company", F.lit("!")).alias("company"), "product", "source_url", "source_type", "official_domain", F.lit(None).cast("int").alias("priority"), "crawl_interval_minutes", F.lit(None).cast("boolean").alias("active"), "extra")
    new = s.where("id % 9 = 0").select("company", "product", F.concat("source_url", F.lit("/new")).alias("source_url"), "source_type", "official_domain", F.lit(5).alias("priority"), F.lit(None).cast("int").alias("crawl_interval_minutes"), F.lit(False).alias("active"), "extra")
    return changes.upsert_sources(s, old.unionByName(new), NOW).select("id", "company", "source_url", "priority", "crawl_interval_minutes", "active", "failure_count")


_add(
    "source_upsert",
    _upserted,
    """SELECT id, CASE WHEN id % 4 = 0 THEN company || '!' ELSE company END AS company, source_url, CASE WHEN id % 4 = 0 THEN 100 ELSE priority END AS priority, crawl_interval_minutes,
         CASE WHEN id % 4 = 0 THEN true ELSE active END AS active, failure_count FROM sources
       UNION ALL SELECT CAST((SELECT max(id) FROM sources) + row_number() OVER (ORDER BY source_url || '/new') AS INT), company, source_url || '/new', 5, 60, false, 0 FROM sources WHERE id % 9 = 0""",
)
_add(
    "mark_checked",
    lambda s, d: changes.mark_checked(_read(s, d, "sources"), _read(s, d, "raw_entries").groupBy("source_id").agg((F.count("*") % 2 == 0).alias("success")), NOW).select("id", "failure_count", iso(F.col("last_checked_at")).alias("last_checked_at"), iso(F.col("last_success_at")).alias("last_success_at")),
    f"""WITH o AS (SELECT source_id, count(*) % 2 = 0 AS ok FROM raw_entries GROUP BY source_id)
        SELECT id, CASE WHEN ok THEN 0 WHEN NOT ok THEN failure_count + 1 ELSE failure_count END AS failure_count,
          {ISO_SQL.format(f'CASE WHEN ok IS NOT NULL THEN {NOW_SQL} ELSE last_checked_at END')} AS last_checked_at, {ISO_SQL.format(f'CASE WHEN ok THEN {NOW_SQL} ELSE last_success_at END')} AS last_success_at
        FROM sources LEFT JOIN o ON source_id = id""",
)
_add("recent_runs", _table("job_runs", lambda t: operations.recent_runs(t, 25).select("id", "job_name", "status")), "SELECT id, job_name, status FROM job_runs ORDER BY started_at DESC, id DESC LIMIT 25")
_add(
    "latest_runs",
    _table("job_runs", operations.latest_by_job),
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY job_name ORDER BY started_at DESC, id DESC) AS k, count(*) OVER (PARTITION BY job_name) AS runs,
         count(*) FILTER (WHERE status = 'failed') OVER (PARTITION BY job_name) AS failed_runs FROM job_runs) SELECT job_name, id, status, items_found, errors, runs, failed_runs FROM r WHERE k = 1""",
)
_add(
    "health",
    _table("job_runs", lambda t: operations.health(t, "ingest").withColumn("last_success_at", iso(F.col("last_success_at")))),
    f"""WITH l AS (SELECT status FROM job_runs WHERE job_name = 'ingest' ORDER BY started_at DESC, id DESC LIMIT 1), r AS (SELECT * FROM (SELECT * FROM job_runs ORDER BY started_at DESC, id DESC LIMIT 10) WHERE status IN ('success', 'partial') ORDER BY started_at DESC, id DESC LIMIT 1)
        SELECT coalesce((SELECT status FROM l) <> 'failed', true) AS healthy, (SELECT status FROM l) AS status, {ISO_SQL.format("(SELECT finished_at FROM r)")} AS last_success_at""",
)
_add(
    "run_details",
    _table("job_runs", lambda t: t.select("id", "job_name", F.explode(F.from_json(F.get_json_object("detail", "$.perSource"), "array<struct<sourceId:int,found:int>>")).alias("p")).select("id", "job_name", F.col("p.sourceId").alias("source_id"), F.col("p.found").alias("found"))),
    """SELECT id, job_name, CAST(p->>'sourceId' AS INT) AS source_id, CAST(p->>'found' AS INT) AS found FROM (SELECT id, job_name, unnest(CAST(json_extract(detail, '$.perSource') AS JSON[])) AS p FROM job_runs
       WHERE json_extract(detail, '$.perSource') IS NOT NULL)""",
)

# upkeep of the items
AGE_SQL = "coalesce(published_at, detected_at)"
TIER_SQL = {
    "junk": f"status IN ('ignored', 'duplicate') AND {AGE_SQL} < {NOW_SQL} - INTERVAL 14 DAY",
    **{x: f"status NOT IN ('ignored', 'duplicate') AND impact_level = '{x}' AND {AGE_SQL} < {NOW_SQL} - INTERVAL {n} DAY" for x, n in (("low", 60), ("medium", 180), ("high", 365))},
}
_add("purge_tier_counts", _table("news_items", lambda t: changes.tier_counts(t, NOW)), " UNION ALL ".join(f"SELECT '{k}' AS tier, count(*) AS n FROM news_items WHERE {v}" for k, v in TIER_SQL.items()) + " UNION ALL SELECT 'all_items', count(*) FROM news_items")
_add("purge_survivors", _table("news_items", lambda t: changes.survivors(t, NOW).select("id", "status", "impact_level")), "SELECT id, status, impact_level FROM news_items WHERE NOT (" + " OR ".join(f"coalesce({v}, false)" for v in TIER_SQL.values()) + ")")
PROMOTABLE_SQL = "status = 'needs_review' AND verified AND title_ar IS NOT NULL AND title_ar <> '' AND summary_ar IS NOT NULL AND summary_ar <> ''"
_add(
    "promotion_counts",
    _table("news_items", lambda t: t.agg(F.count_if(changes.promotable()).alias("candidates"), F.count_if(F.col("status") == "published").alias("published"))),
    f"SELECT count(*) FILTER (WHERE {PROMOTABLE_SQL}) AS candidates, count(*) FILTER (WHERE status = 'published') AS published FROM news_items",
)
_add("promoted", _table("news_items", lambda t: changes.promote(t, NOW, cap=10**9, dry_run=False)[0].select("id", "status")), f"SELECT id, CASE WHEN {PROMOTABLE_SQL} THEN 'published' ELSE status END AS status FROM news_items")
_add("enrichable", _table("news_items", lambda t: changes.enrichable(t, 200).select("id", "company")), "SELECT id, company FROM news_items WHERE status = 'needs_review' AND verified ORDER BY detected_at DESC, id DESC LIMIT 200")
_add(
    "enrichment_applied",
    _table("news_items", lambda t: changes.apply_enrichment(t, t.where("id % 5 = 0").select("id", F.lit("ع").alias("title_ar"), "title_en", "summary_ar", "summary_en", F.lit("tool").alias("category"), "tags", "impact_level", F.lit("published").alias("status")), NOW).select("id", "title_ar", "category", "status")),
    "SELECT id, CASE WHEN id % 5 = 0 THEN 'ع' ELSE title_ar END AS title_ar, CASE WHEN id % 5 = 0 THEN 'tool' ELSE category END AS category, CASE WHEN id % 5 = 0 THEN 'published' ELSE status END AS status FROM news_items",
)

# addresses and texts of the raw entries
CANONICAL_SQL = r"""(WITH u AS (SELECT entry_id, source_id, trim(url, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) AS u FROM raw_entries),
  p AS (SELECT entry_id, source_id, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(u, '^[A-Za-z]+://([^/:?#]*)', 1)) AS host,
    regexp_extract(u, '^[A-Za-z]+://[^/?#]*?:([0-9]+)', 1) AS port, regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS query FROM u),
  q AS (SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT list_contains(['utm_source','utm_medium','utm_campaign','utm_term','utm_content','utm_id','gclid','fbclid','mc_cid','mc_eid','ref','ref_src','source'], split_part(x, '=', 1)))), '&') AS search,
    scheme || '://' || host || CASE WHEN port = '' OR (scheme = 'https' AND port = '443') OR (scheme = 'http' AND port = '80') THEN '' ELSE ':' || port END || CASE WHEN path = '' THEN '/' ELSE path END AS base FROM p)
  SELECT entry_id, source_id, host, CASE WHEN search = '' AND path NOT IN ('', '/') AND ends_with(base, '/') THEN left(base, length(base) - 1) WHEN search = '' THEN base ELSE base || '?' || search END AS url FROM q)"""
_add("canonical_urls", _table("raw_entries", lambda t: t.select("entry_id", url.canonical_url(F.col("url")).alias("url"))), f"SELECT entry_id, url FROM {CANONICAL_SQL}")
_add(
    "verified_domains",
    lambda s, d: _read(s, d, "raw_entries").join(_read(s, d, "sources").select(F.col("id").alias("source_id"), "official_domain"), "source_id").select("entry_id", url.on_official_domain(F.col("url"), F.col("official_domain")).alias("verified")),
    f"""SELECT entry_id, coalesce(official_domain <> '' AND (regexp_replace(host, '^www\\.', '') = regexp_replace(lower(official_domain), '^www\\.', '') OR ends_with(host, '.' || regexp_replace(lower(official_domain), '^www\\.', ''))), false) AS verified
        FROM {CANONICAL_SQL} c JOIN sources s ON s.id = c.source_id""",
)
WS = "[\\t\\n\\v\\f\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"


def _collapse_sql(c: str) -> str:
    x = f"regexp_replace(replace({c}, chr(13), ''), '[ \\t\\f\\v]+', ' ', 'g')"
    x = f"regexp_replace({x}, '{WS}*\\n{WS}*', chr(10), 'g')"
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


_add("normal_titles", _table("raw_entries", lambda t: t.select("entry_id", text.normalize_title(F.col("title")).alias("title"))), f"SELECT entry_id, replace({_collapse_sql('title')}, chr(10), ' ') AS title FROM raw_entries")
NATIVE_SQL = f"""CASE WHEN regexp_matches(content, '[<&]') THEN {_collapse_sql("replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(content, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?i)</(p|div|li|h[1-6]|tr)>|<br */?>', chr(10), 'g'), '</?[A-Za-z][^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&')")} ELSE {_collapse_sql('content')} END"""
_add("entry_texts", _table("raw_entries", lambda t: t.select("entry_id", text.html_to_text_native(F.col("content")).alias("body"))), f"SELECT entry_id, {NATIVE_SQL} AS body FROM raw_entries")
def _hashes(t: DataFrame) -> DataFrame:
    """The hashes that the pipeline gives."""
    body = html.html_to_text(F.col("content"))
    return spread(t).select("entry_id", "fetched_at", text.content_hash(url.canonical_url(F.col("url")), F.col("title"), body).alias("content_hash"))


_add(
    "content_hashes",
    _table("raw_entries", lambda t: _hashes(t).select("entry_id", "content_hash")),
    f"SELECT r.entry_id, sha256(c.url || chr(10) || lower({_collapse_sql('r.title')}) || chr(10) || lower({NATIVE_SQL.replace('content', 'r.content')})) AS content_hash FROM raw_entries r JOIN {CANONICAL_SQL} c USING (entry_id)",
)
HASHED_SQL = SQL["content_hashes"]


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashes(_read(spark, sf_dir, "raw_entries"))


_add(
    "first_seen",
    lambda s, d: changes.first_seen(_hashed(s, d), ("fetched_at", "entry_id")).select("entry_id", "content_hash"),
    f"SELECT arg_min(entry_id, (fetched_at, entry_id)) AS entry_id, content_hash FROM ({HASHED_SQL}) h JOIN raw_entries r USING (entry_id) GROUP BY content_hash",
)
_add(
    "not_in_store",
    lambda s, d: changes.insert_new(_read(s, d, "news_items"), _read(s, d, "news_batches").select("id", "content_hash", F.col("batch_no").alias("source_rank"), F.col("id").alias("entry_pos"))).select("id", "content_hash"),
    "SELECT min(id) AS id, content_hash FROM news_batches b WHERE content_hash IS NOT NULL AND NOT EXISTS (SELECT 1 FROM news_items n WHERE n.content_hash = b.content_hash) GROUP BY content_hash",
)

# rules over the items
def _case_sql(name: str, table: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({name}, '{p}', 'i') THEN '{k}'" for k, p in table) + f" ELSE '{default}' END"


TEXT_SQL = "(title_original || chr(10) || content_original)"
_add(
    "classified",
    _table("news_items", lambda t: spread(t).select("id", rules.category(F.concat("title_original", F.lit("\n"), "content_original")).alias("category"), rules.impact(F.concat("title_original", F.lit("\n"), "content_original")).alias("impact"))),
    f"SELECT id, {_case_sql('x', rules.CATEGORY_RULES, 'product')} AS category, {_case_sql('x', rules.IMPACT_RULES, 'low')} AS impact FROM (SELECT id, {TEXT_SQL} AS x FROM news_items)",
)
_KNOWN = "[" + ", ".join(f"'{t}'" for t in rules.KNOWN_TAGS) + "]"
_STOP = "[" + ", ".join(f"'{t}'" for t in rules.STOPWORDS) + "]"
_add(
    "tags",
    _table("news_items", lambda t: spread(t).select("id", F.array_join(rules.tags(F.concat("title_original", F.lit("\n"), "content_original")), "|").alias("tags"))),
    f"""WITH d AS (SELECT id, lower({TEXT_SQL}) AS x FROM news_items), w AS (SELECT id, unnest(regexp_extract_all(x, '[a-z][a-z0-9+.-]{{2,}}')) AS w, generate_subscripts(regexp_extract_all(x, '[a-z][a-z0-9+.-]{{2,}}'), 1) AS i FROM d),
        c AS (SELECT id, w, count(*) AS n, min(i) AS i FROM w WHERE NOT list_contains({_STOP}, w) GROUP BY id, w),
        k AS (SELECT id, t, generate_subscripts AS i FROM (SELECT id, x, unnest({_KNOWN}) AS t, generate_subscripts({_KNOWN}, 1) AS generate_subscripts FROM d) WHERE contains(x, t)),
        a AS (SELECT id, t AS w, 0 AS g, 0 AS n, i FROM k UNION ALL SELECT id, w, 1, -n, i FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.id = c.id AND k.t = c.w)),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY g, n, i) AS p FROM a)
        SELECT d.id, coalesce(string_agg(w, '|' ORDER BY p) FILTER (WHERE p <= 6), '') AS tags FROM d LEFT JOIN r ON r.id = d.id GROUP BY d.id""",
)
_add(
    "script_language",
    _table("news_items", lambda t: t.select("id", text.detect_language(F.concat("title_original", F.lit("\n"), "content_original")).alias("lang"))),
    f"SELECT id, CASE WHEN length(regexp_replace({TEXT_SQL}, '[^\\x{{600}}-\\x{{6ff}}]', '', 'g')) > length(regexp_replace({TEXT_SQL}, '[^A-Za-z]', '', 'g')) THEN 'ar' ELSE 'en' END AS lang FROM news_items",
)
_add(
    "excerpts",
    _table("news_items", lambda t: t.select("id", text.truncate(F.col("content_original"), 280).alias("excerpt"))),
    f"""SELECT id, CASE WHEN length(c) <= 280 THEN c ELSE regexp_replace(CASE WHEN strpos(reverse(left(c, 280)), ' ') > 0 AND 280 - strpos(reverse(left(c, 280)), ' ') > 168 THEN left(c, 280 - strpos(reverse(left(c, 280)), ' '))
        ELSE left(c, 280) END, '^{WS}+|{WS}+$', '', 'g') || '…' END AS excerpt FROM (SELECT id, content_original AS c FROM news_items)""",
)
_VERSION = "regexp_matches(w, '^[@A-Za-z0-9_./+-]*[0-9][@A-Za-z0-9_./+-]*$')"
_NOISE = "(list_contains([" + ", ".join(f"'{w}'" for w in rules.RELEASE_WORDS) + "], lower(w)) OR regexp_matches(lower(w), '-(?:" + "|".join(rules.PACKAGE_ENDINGS) + ")$'))"
_add(
    "contentless",
    _table("news_items", lambda t: t.select("id", rules.is_version_title(F.col("title_original")).alias("version_title"), rules.is_contentless(F.col("title_original"), F.col("content_original")).alias("contentless"))),
    rf"""WITH t AS (SELECT id, list_filter(regexp_split_to_array(title_original, '\s+'), lambda w: w <> '') AS ws, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content_original, '(?is)full changelog:?.*', '', 'g'), 'https?://[^\s]+', '', 'g'), '[*#`>_~\-]+', ' ', 'g'), '{WS}+', ' ', 'g'))) < 30 AS bare FROM news_items),
        b AS (SELECT id, len(ws) AS n, bare, list_filter(list_transform(ws, lambda w: regexp_replace(regexp_replace(w, '^[(\[{{]+', ''), '[:•·,)\]}}]+$', '')), lambda w: w <> '') AS ws FROM t),
        v AS (SELECT id, bare, n BETWEEN 1 AND 4 AND len(list_filter(ws, lambda w: NOT ({_VERSION} OR {_NOISE}))) = 0 AND len(list_filter(ws, lambda w: {_VERSION})) > 0 AS v FROM b)
        SELECT id, v AS version_title, v AND bare AS contentless FROM v""",
)
_add(
    "outcomes",
    _table("news_items", lambda t: t.select("id", enrich.status(F.col("verified"), (F.col("id") % 7) / 10, (F.col("id") % 11) / 20).alias("outcome"))),
    "SELECT id, CASE WHEN verified AND (id % 11) / 20.0 >= 0.25 AND (id % 7) / 10.0 >= 0.2 THEN 'published' ELSE 'needs_review' END AS outcome FROM news_items",
)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model in all conditions, made of the items, and what becomes of them."""
    t = _read(spark, sf_dir, "news_items")
    obj = F.concat(
        F.lit('{"category": "'), F.when(F.col("id") % 3 == 0, F.lit("Nonsense")).otherwise(F.upper(F.coalesce("category", F.lit("tool")))), F.lit('", "impact": " '), F.col("impact_level"), F.lit('", "title_ar": "ا", "summary_ar": "'),
        F.when(F.col("id") % 4 == 0, F.lit(" ")).otherwise(F.lit("ب")), F.lit('", "title_en": "t", "summary_en": "s"'), F.when(F.col("id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(', "confidence": '), ((F.col("id") % 30) / 10.0 - 1).cast("decimal(4,1)").cast("string"))), F.lit("}"),
    )
    answer = F.when(F.col("id") % 10 == 0, F.lit("no answer")).when(F.col("id") % 2 == 0, F.concat(F.lit("```json\n"), obj, F.lit("\n```"))).otherwise(obj)
    s = lambda v, c: v.alias(c)
    empty = F.array().cast("array<string>")
    fb = F.struct(s(F.lit("product"), "category"), s(empty, "tags"), s(F.lit("low"), "impact"), *[s(F.lit("f"), c) for c in ("title_ar", "summary_ar", "title_en", "summary_en")], s(F.lit(0.2), "confidence"))
    return t.select("id", enrich.normalized(enrich.extract_json(answer), fb).alias("e")).select("id", "e.category", "e.impact", "e.summary_ar", F.round("e.confidence", 3).alias("confidence"))


_add(
    "model_answers",
    _answers,
    """SELECT id, CASE WHEN id % 10 = 0 OR id % 3 = 0 THEN 'product' ELSE coalesce(category, 'tool') END AS category, CASE WHEN id % 10 = 0 THEN 'low' ELSE impact_level END AS impact,
         CASE WHEN id % 10 = 0 OR id % 4 = 0 THEN 'f' ELSE 'ب' END AS summary_ar,
         round(CASE WHEN id % 10 = 0 THEN 0.2 ELSE least(CASE WHEN id % 5 = 0 THEN 0.6 ELSE least(greatest((id % 30) / 10.0 - 1, 0), 1) END, CASE WHEN id % 4 = 0 THEN 0.3 ELSE 1.0 END) END::DOUBLE, 3) AS confidence FROM news_items""",
)
_add(
    "model_budget",
    _table("news_items", lambda t: ingest.within_budget(t.where("verified").select("id", F.unix_micros("detected_at").alias("source_rank"), F.col("id").alias("entry_pos")), 250).select("id", "in_budget")),
    "SELECT id, row_number() OVER (ORDER BY detected_at, id) <= 250 AS in_budget FROM news_items WHERE verified",
)


# pages: each raw entry set as a listing of its own, and read again
def _escaped(c: str):
    x = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _read(spark, sf_dir, "raw_entries")
    date = F.when(F.col("published_at").isNull(), "").otherwise(F.concat(F.lit("<time>"), _escaped("published_at"), F.lit("</time>")))
    image = F.when(F.col("image_url").isNull(), "").otherwise(F.concat(F.lit('<img src="'), _escaped("image_url"), F.lit('">')))
    body = F.concat(F.lit('<ul><li class="post"><h3><a href="'), _escaped("url"), F.lit('">'), _escaped("title"), F.lit("</a></h3>"), date, image, F.lit("</ul>"))
    config = F.lit('{"html": {"itemSelector": "li.post", "titleSelector": "h3", "dateSelector": "time", "imageSelector": "img[src*=\\"img\\"]"}}')
    pages = t.select(F.col("entry_id").cast("int").alias("source_id"), F.lit(0).alias("source_rank"), F.lit("html").alias("source_type"), body.alias("body"), F.lit("https://base.example").alias("base_url"), config.alias("extra"), F.lit(None).cast("string").alias("error"))
    return listings.read_entries(pages).select(F.col("source_id").alias("entry_id"), "title", "url", "published_at", "image_url", "error")


_add(
    "listing_entries",
    _listing,
    f"""SELECT CAST(entry_id AS INT) AS entry_id, trim(regexp_replace(title, '{WS}+', ' ', 'g')) AS title, url, coalesce(regexp_replace(published_at, '^{WS}+|{WS}+$', '', 'g'), '') AS published_at, image_url, NULL::VARCHAR AS error
        FROM raw_entries""",
)
ROBOTS = "User-agent: *\nDisallow: /loom\nAllow: /loomkit/\nDisallow: /*-1$\n\nUser-agent: other\nDisallow: /"
_add(
    "robots_decisions",
    _table("raw_entries", lambda t: t.select("entry_id", robots.is_allowed("feedmill/1.0")(F.lit(ROBOTS), F.regexp_extract("url", r"^[a-z]+://[^/]+([^#]*)", 1)).alias("allowed"))),
    r"""WITH p AS (SELECT entry_id, regexp_extract(url, '^[a-z]+://[^/]+([^#]*)', 1) AS p FROM raw_entries)
        SELECT entry_id, CASE WHEN starts_with(p, '/loomkit/') THEN true WHEN starts_with(p, '/loom') THEN false WHEN strpos(p, '-1') > 1 AND strpos(p, '-1') = length(p) - 1 THEN false ELSE true END AS allowed FROM p""",
)

# timestamps of many forms
_add("p5_found", lambda s, d: timestamps.normalise(_read(s, d, "raw_entries"), _read(s, d, "source_zones")).select("entry_id", "published_utc"))
_add("p5_forms", lambda s, d: timestamps.normalise(_read(s, d, "raw_entries"), _read(s, d, "source_zones")).groupBy("source_id", "form").agg(F.count("*").alias("entries"), F.count_if(F.col("n_readings") > 1).alias("ambiguous")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import queries_sources  # noqa: F401  (adds its own)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import queries_sources  # noqa: F401

    return dict(SQL)
