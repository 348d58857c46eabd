"""Summaries and classifications: fallbacks, repair of a model's answer, and the gate to publication."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import CATEGORIES, IMPACT_LEVELS
from . import rules
from .text import normalize_title, trim, truncate

ENRICHMENT = "category string, tags array<string>, impact string, title_ar string, summary_ar string, title_en string, summary_en string, confidence double"


def fallback(title: Column, body: Column) -> Column:
    """Rules for the class, the text itself for the summaries, confidence 0.2."""
    text = F.concat(title, F.lit("\n"), body)
    name = normalize_title(title)
    excerpt = truncate(F.when(F.coalesce(body, F.lit("")) == "", name).otherwise(body), 280)
    return F.struct(
        rules.category(text).alias("category"), rules.tags(text).alias("tags"), rules.impact(text).alias("impact"), name.alias("title_ar"), excerpt.alias("summary_ar"),
        name.alias("title_en"), excerpt.alias("summary_en"), F.lit(0.2).alias("confidence"),
    )


def extract_json(text: Column) -> Column:
    """The outermost braces of an answer as JSON text; null where they hold no JSON object."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when((found != "") & F.get_json_object(found, "$").isNotNull(), found)


def confidence(json: Column, missing: float) -> Column:
    """The confidence of an answer within 0 and 1; ``missing`` where there is no number; null and '' count as 0."""
    raw = F.get_json_object(json, "$.confidence")
    absent = raw.isNull() & ~json.rlike(r'"confidence"\s*:\s*null')
    number = F.when(absent, F.lit(missing)).when(raw.isNull() | (trim(raw) == ""), F.lit(0.0)).when(raw == "true", 1.0).when(raw == "false", 0.0).otherwise(raw.try_cast("double"))
    finite = F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), F.lit(missing)).otherwise(number)
    return F.least(F.greatest(finite, F.lit(0.0)), F.lit(1.0))


def clean_tags(tags: Column) -> Column:
    """Lower case, trimmed, of 1 to 40 characters, the first eight; an empty array for null."""
    low = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: trim(F.lower(F.coalesce(t, F.lit("null")))))
    return F.slice(F.filter(low, lambda t: (F.length(t) > 0) & (F.length(t) <= 40)), 1, 8)


def normalized(json: Column, fb: Column) -> Column:
    """A model's answer with each unusable part replaced from ``fb``; without four summary texts the confidence is at most 0.3.

    A null answer gives ``fb``.
    """
    field = lambda k: F.get_json_object(json, f"$.{k}")
    low = lambda k: trim(F.lower(F.coalesce(field(k), F.lit(""))))
    cat = F.when(low("category").isin(CATEGORIES), low("category")).otherwise(fb["category"])
    imp = F.when(low("impact").isin(IMPACT_LEVELS), low("impact")).otherwise(fb["impact"])
    tags = clean_tags(F.from_json(field("tags"), "array<string>"))
    conf = confidence(json, 0.6)
    texts = [trim(F.coalesce(field(k), F.lit(""))) for k in ("title_ar", "summary_ar", "title_en", "summary_en")]
    whole = (texts[0] != "") & (texts[1] != "") & (texts[2] != "") & (texts[3] != "")
    pick = lambda i, k: F.when(whole, texts[i]).otherwise(fb[k]).alias(k)
    return F.when(json.isNull(), fb).otherwise(
        F.struct(
            cat.alias("category"), F.when(F.size(tags) > 0, tags).otherwise(fb["tags"]).alias("tags"), imp.alias("impact"), pick(0, "title_ar"), pick(1, "summary_ar"), pick(2, "title_en"), pick(3, "summary_en"),
            F.when(whole, conf).otherwise(F.least(conf, F.lit(0.3))).alias("confidence"),
        )
    )


def status(verified: Column, classify: Column, summary: Column) -> Column:
    """published for a verified row whose confidences reach 0.2 and 0.25, else needs_review."""
    return F.when(verified & (summary >= 0.25) & (classify >= 0.2), "published").otherwise("needs_review")
