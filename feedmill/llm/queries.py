"""The llm operators over their tables, with production parameters; SQL where a query engine can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import batch_dedup, encode, language, mixing, near_dup, quality, site_lines, truncation


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each arrival of news_batches that repeats an earlier row (same hash, or three-word overlap of at least 0.5)."""
    names = (F.col("content_original").alias("text"), F.col("content_hash").alias("hash"))
    history = _read(spark, sf_dir, "news_items").select("id", *names)
    arrivals = _read(spark, sf_dir, "news_batches").select("id", *names, F.col("batch_no").alias("batch"))
    found = batch_dedup.repeats(history, arrivals, words=3, threshold=0.5)
    return found.select(F.col("id_a").cast("int").alias("id_a"), F.col("id_b").cast("int").alias("id_b"))


def p2_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, confidence and segments of each news item."""
    return language.identify(_read(spark, sf_dir, "news_items"), "id", "content_original", "source_language")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the news items whose source_language is missing or wrong or that mix languages."""
    return language.mislabelled(p2_labels(spark, sf_dir)).select(F.col("id").cast("int").alias("id"), "lang")


TEXT_FIELDS = ["content_original", "summary_ar", "summary_en"]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of content_original and the summaries that were cut before their end."""
    found = truncation.truncated(_read(spark, sf_dir, "news_items"), "id", "source_name", TEXT_FIELDS)
    return found.select(F.col("id").cast("int").alias("id"), "field")


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source_name truncates each field."""
    return truncation.rates(_read(spark, sf_dir, "news_items"), "id", "source_name", TEXT_FIELDS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of content_original that their source repeats in at least 5 and at least 10 % of its rows."""
    found = site_lines.repeated_lines(_read(spark, sf_dir, "news_items"), "id", "source_name", "content_original")
    return found.select(F.col("id").cast("int").alias("id"), "line_no")


def p4_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each content_original without the lines of its site."""
    return site_lines.cleaned(_read(spark, sf_dir, "news_items"), "id", "source_name", "content_original")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of news items of at least 20 words whose three-word overlap is at least 0.5."""
    pairs, copies = near_dup.near_duplicates(_read(spark, sf_dir, "news_items"), "id", "content_original", words=3, threshold=0.5, min_words=20)
    return near_dup.with_copies(pairs, copies).select(F.col("id_a").cast("int").alias("id_a"), F.col("id_b").cast("int").alias("id_b"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each near-duplicate news item with its group (five-word shingles, overlap 0.8 or more)."""
    pairs, copies = near_dup.near_duplicates(_read(spark, sf_dir, "news_items"), "id", "content_original")
    return near_dup.near_duplicate_groups(pairs, copies)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and ids of each document by byte_bpe_50k."""
    return encode.encode(_read(spark, sf_dir, "documents"), "doc_id", "text")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture by mix_targets, a row for each time one is taken."""
    return mixing.mix(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source of mix_targets."""
    return mixing.mix(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "mix_targets"))[1]


def p9_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality statistics of each document."""
    return quality.statistics(_read(spark, sf_dir, "documents"), "doc_id", "text", "lang")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that aren't natural prose, with their kind."""
    return p9_stats(spark, sf_dir).where("kind <> 'prose'").select("doc_id", "kind")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p2_found": p2_found,
        "p2_labels": p2_labels,
        "p3_found": p3_found,
        "p3_rates": p3_rates,
        "p4_cleaned": p4_cleaned,
        "p4_found": p4_found,
        "p6_found": p6_found,
        "p6_groups": p6_groups,
        "p7_ids": p7_ids,
        "p8_mix": p8_mix,
        "p8_shares": p8_shares,
        "p9_found": p9_found,
        "p9_stats": p9_stats,
    }


# visible text and its words; the entities are those that a fixed list of replacements resolves
_VISIBLE = "regexp_replace({}, '(?s)<!--.*?-->|</?[A-Za-z][^<>]*(>|$)', ' ', 'g')"
_PLAIN = _VISIBLE
for _entity, _text in (("&#39;", "chr(39)"), ("&quot;", "chr(34)"), ("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&amp;", "'&'")):
    _PLAIN = f"replace({_PLAIN}, '{_entity}', {_text})"
_WORDS = f"regexp_extract_all(lower({_PLAIN}), '[\\p{{L}}\\p{{N}}]+')"
_SHINGLES = """w AS (SELECT id, {words} AS ws FROM {table}),
  s AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(ws) - 1), lambda i: hash(ws[i], ws[i + 1], ws[i + 2]))) AS h FROM w WHERE len(ws) >= {least}),
  n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
  c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.id < b.id {only} GROUP BY a.id, b.id),
  p AS (SELECT id_a, id_b FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE 2 * k >= x.n + y.n - k)"""


def oracle_sql() -> dict[str, str]:
    letters = f"regexp_extract_all(lower({_PLAIN.format('line')}), '[\\p{{L}}\\p{{M}}]+')"
    both = "(SELECT id, content_original, content_hash FROM news_items UNION ALL SELECT id, content_original, content_hash FROM news_batches) t"
    return {
        "p1_found": "WITH " + _SHINGLES.format(words=_WORDS.replace("{}", "content_original"), table=both, least=3, only="AND b.id IN (SELECT id FROM news_batches)")
        + f""", hs AS (SELECT id, lower(regexp_replace(content_hash, '\\s+', '', 'g')) AS h FROM {both} WHERE content_hash IS NOT NULL AND trim(content_hash) <> ''),
        m AS (SELECT h, min(id) AS id FROM hs GROUP BY h), e AS (SELECT m.id AS id_a, hs.id AS id_b FROM hs JOIN m USING (h) WHERE m.id < hs.id AND hs.id IN (SELECT id FROM news_batches))
        SELECT CAST(min(id_a) AS INT) AS id_a, id_b FROM (SELECT * FROM p UNION ALL SELECT * FROM e) GROUP BY id_b""",
        "p4_found": f"""WITH l AS (SELECT id, source_name, unnest(string_split(content_original, chr(10))) AS line, generate_subscripts(string_split(content_original, chr(10)), 1) AS line_no FROM news_items),
        k AS (SELECT id, source_name, CAST(line_no AS INT) AS line_no, {letters} AS ws FROM l), d AS (SELECT source_name, array_to_string(ws, '') AS k, count(DISTINCT id) AS n FROM k WHERE len(ws) >= 2 GROUP BY ALL),
        z AS (SELECT source_name, count(*) AS size FROM news_items GROUP BY source_name)
        SELECT k.id, k.line_no FROM k JOIN d ON d.source_name = k.source_name AND d.k = array_to_string(k.ws, '') JOIN z ON z.source_name = k.source_name WHERE len(k.ws) >= 2 AND d.n >= 5 AND d.n * 10 >= z.size""",
        "p6_found": "WITH " + _SHINGLES.format(words=_WORDS.replace("{}", "content_original"), table="news_items", least=20, only="")
        + ", r AS (SELECT min(id) AS id FROM w GROUP BY ws) SELECT id_a, id_b FROM p WHERE id_a IN (SELECT id FROM r) OR id_b IN (SELECT id FROM r)",
    }
