"""Scalar text functions as built-in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Fixed value: what counts as white space in the dialect whose results are kept.
WHITE = r"[\t\n\x0B\f\r    -     　﻿]"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def collapse_whitespace(c: Column) -> Column:
    """Carriage returns dropped, blanks and tabs to one blank, white space around a newline to the newline, ends trimmed."""
    c = F.regexp_replace(c, r"\r", "")
    c = F.regexp_replace(c, r"[ \t\f\x0B]+", " ")
    return trim(F.regexp_replace(c, f"{WHITE}*\n{WHITE}*", "\n"))


def normalize_title(c: Column) -> Column:
    return trim(F.regexp_replace(collapse_whitespace(c), "\n", " "))


def truncate(c: Column, most: int) -> Column:
    """At most ``most`` characters; cut at the last blank if it lies beyond 60 % of them; an ellipsis marks the cut."""

    def cut(x: Column) -> Column:
        head = F.substring(x, 1, most)
        blank = F.lit(most) - F.instr(F.reverse(head), " ")  # counted from 0; without one it is ``most``, and too far
        return F.when(F.length(x) <= most, x).otherwise(bind(blank, lambda n: F.concat(trim(F.when((n > most * 0.6) & (n < most), F.substring(head, F.lit(1), n)).otherwise(head)), F.lit("…"))))

    return bind(c, cut)


def detect_language(c: Column) -> Column:
    """ar if there are more Arabic than Latin letters, else en."""
    return F.when(F.regexp_count(c, F.lit(r"[\u0600-\u06FF]")) > F.regexp_count(c, F.lit("[A-Za-z]")), "ar").otherwise("en")


def source_name(company: Column, product: Column) -> Column:
    return F.when(product.isNull() | (product == ""), company).otherwise(F.concat(company, F.lit(" · "), product))


def content_hash(canonical: Column, title: Column, body: Column) -> Column:
    """SHA-256 of an address in canonical form, the title and the body; nulls count as empty."""
    low = lambda c: F.lower(collapse_whitespace(F.coalesce(c, F.lit(""))))
    return F.sha2(F.concat_ws("\n", F.coalesce(canonical, F.lit("")), low(title), low(body)), 256)


def contentless_body(c: Column) -> Column:
    """Fewer than 30 characters are left without change-log links, addresses and markup signs; true for null."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)full changelog:?.*", "")
    c = F.regexp_replace(c, r"https?://[^\s\u00A0]+", "")
    c = F.regexp_replace(c, r"[*#`>_~\-]+", " ")
    return F.length(trim(F.regexp_replace(c, f"{WHITE}+", " "))) < 30


def html_to_text_native(c: Column) -> Column:
    """Text of simple markup by regular expressions alone: hidden elements dropped, blocks end a line, common entities resolved.

    For any other markup use ``feedmill.functions.html.html_to_text``, which parses.
    """
    x = F.regexp_replace(c, r"(?is)<(script|style|noscript|template|svg)\b[^>]*>.*?</\1\s*>", "")
    x = F.regexp_replace(x, r"(?i)</(p|div|li|h[1-6]|tr)\s*>|<br\s*/?>", "\n")
    x = F.regexp_replace(x, r"<!--[\s\S]*?-->|</?[A-Za-z][^>]*>", "")
    for entity, text in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&apos;|&#x27;", "'"), ("&amp;", "&")):
        x = F.regexp_replace(x, entity, text)
    return F.when(c.rlike("[<&]"), collapse_whitespace(x)).otherwise(collapse_whitespace(c))
