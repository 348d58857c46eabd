"""Entries out of fetched pages: HTML listings, RSS and Atom feeds, and the three kinds of repository responses.

Each reader takes a table of fetched bodies, one row per source, with its position in the run (source_rank), and yields entries in the
order of the page (entry_pos), so that later steps can tell which came first.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import html
from ..functions.url import resolve

ENTRIES = "source_id int, source_rank int, entry_pos int, title string, url string, content string, published_at string, image_url string, error string"
IMAGE = re.compile(r"(?i)\.(png|jpe?g|webp|gif|avif|svg)([?#]|$)")
FIRST_IMAGE = re.compile(r"(?i)<img[^>]+src=[\"']([^\"']+)[\"']")


def parse_listing(page: str, config: dict, base_url: str) -> list[dict]:
    """Entries of a listing page by a source's selectors; an item without title or address gives none.

    Without a titleSelector the item's whole text is the title; without a linkSelector its first link counts; an item that is a link
    itself stands in for a missing one.
    """
    base = config.get("baseUrl") or base_url
    out = []
    one_line = lambda t: re.sub(r"\s+", " ", t).strip()
    for item in html.select(html.parse(page), config["itemSelector"]):
        pick = lambda key, default: html.first(item, config.get(key) or default) if config.get(key) or default else None  # noqa: E731, B023
        head = pick("titleSelector", None) if config.get("titleSelector") else item
        link = pick("linkSelector", "a")
        href = link.attrs.get(config.get("linkAttr") or "href") if link else None
        if href is None and item.name == "a":
            href = item.attrs.get("href")
        title, url = one_line(head.text()) if head else "", resolve(href, base) if href else None
        if not title or not url:
            continue
        published = None
        if config.get("dateSelector"):
            date = pick("dateSelector", None)
            published = (date.attrs.get("datetime", date.text().strip()) if date else "")
        if config.get("contentSelector"):
            body = pick("contentSelector", None)
            content = (body.text().strip() if body else "") or title
        else:
            content = one_line(item.text())
        image = pick("imageSelector", "img")
        raw = next((image.attrs[k] for k in ("src", "data-src", "content") if k in image.attrs), "") if image else ""
        out.append({"title": title, "url": url, "content": content, "published_at": published, "image_url": resolve(raw, base) if raw else None})
    return out


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _prefixed(element) -> str:
    space = element.tag[1:].split("}")[0] if element.tag.startswith("{") else ""
    if "content/1.0" in space or "purl.org/rss/1.0/modules/content" in space:
        return "content:" + _local(element.tag)
    return ("media:" if "mrss" in space else "") + _local(element.tag)


def rss_image(item: dict) -> str | None:
    """thumbnail, media content, an enclosure that is an image, else the first image in the text."""
    for key in ("media:thumbnail", "media:content"):
        for attrs in item.get(key, []):
            if attrs.get("url"):
                return attrs["url"]
    for attrs in item.get("enclosure", [])[:1]:
        if attrs.get("url") and (re.match(r"(?i)image/", attrs.get("type", "")) or IMAGE.search(attrs["url"])):
            return attrs["url"]
    m = FIRST_IMAGE.search(item.get("content:encoded") or item.get("content") or "")
    return m[1] if m else None


def _iso(text: str | None) -> str | None:
    if not text or re.match(r"\s*\d{1,2}[-/.]\d", text):  # the order of day and month is the source's, not ours to guess
        return None
    for read in (lambda t: datetime.fromisoformat(t.replace("Z", "+00:00")), parsedate_to_datetime):
        try:
            at = read(text.strip())
            at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
            return at.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"
        except (ValueError, TypeError):
            continue
    return None


def parse_feed(xml: str, limit: int) -> list[dict]:
    """Entries of an RSS or Atom feed: the first ``limit`` items, then without those that lack an address or a title."""
    if "<!ENTITY" in xml:
        raise ValueError("feeds with own entities aren't read")
    root = ElementTree.fromstring(xml.strip())
    items = [e for e in root.iter() if _local(e.tag) in ("item", "entry")][:limit]
    out = []
    for e in items:
        item: dict = {}
        for c in e:
            name = _prefixed(c)
            if name in ("media:thumbnail", "media:content", "enclosure"):
                item.setdefault(name, []).append(dict(c.attrib))
            elif name == "media:group":
                for g in c:
                    item.setdefault(_prefixed(g), []).append(dict(g.attrib))
            elif name == "link" and c.get("href"):
                if c.get("rel", "alternate") == "alternate":
                    item.setdefault("link", c.get("href"))
            else:
                inner = "".join(c.itertext()) if c.get("type") != "xhtml" else "".join(ElementTree.tostring(x, encoding="unicode") for x in c)
                item.setdefault(name, inner)
        url, title = (item.get("link") or item.get("guid") or item.get("id") or "").strip(), (item.get("title") or "").strip()
        if not url or not title:
            continue
        summary = next((item[k] for k in ("content", "description", "summary") if item.get(k) is not None), None)
        raw = item.get("pubDate") or item.get("published") or item.get("updated") or item.get("date")
        content = next((x for x in (item.get("content:encoded"), summary) if x is not None), title)
        out.append({"title": title, "url": url, "content": content, "published_at": _iso(raw) or raw, "image_url": rss_image({**item, "content": summary})})
    return out


def parse_repository(body: str, config: dict, limit: int) -> list[dict]:
    """Entries of a repository response: releases (without drafts), commits, or one watched file."""
    mode, data = config.get("mode") or "releases", json.loads(body)
    if mode == "releases":
        kept = [r for r in data if not r.get("draft")][:limit]
        return [{"title": (r.get("name") or "").strip() or r["tag_name"], "url": r["html_url"], "content": (r.get("body") or "").strip() or r.get("name") or r["tag_name"], "published_at": r.get("published_at"), "image_url": None} for r in kept]
    if mode == "commits":
        rows = [(c, c["commit"].get("message") or "") for c in data[:limit]]
        return [{"title": m.split("\n")[0], "url": c["html_url"], "content": m, "published_at": (c["commit"].get("committer") or {}).get("date"), "image_url": None} for c, m in rows]
    if mode == "file":
        if not config.get("path"):
            raise ValueError("a watched file needs a path")
        text = base64.b64decode(data["content"]).decode("utf-8", "replace") if data.get("encoding") == "base64" else data["content"]
        return [{"title": f"{config['repo']} {config['path']} updated", "url": data["html_url"], "content": text, "published_at": None, "image_url": None}]
    raise ValueError(f"unknown mode {mode!r}")


def entries_of(source_type: str, body: str, base_url: str, extra: dict | None, limit: int) -> list[dict]:
    """Dispatch by the type of a source; an unknown type or a missing configuration is an error."""
    if source_type == "rss":
        return parse_feed(body, limit)
    config = (extra or {}).get("github" if source_type == "github" else "html")
    if source_type in ("html", "playwright", "github") and not config:
        raise ValueError(f"a source of type {source_type!r} needs a configuration")
    if source_type in ("html", "playwright"):
        return parse_listing(body, config, base_url)[:limit]
    if source_type == "github":
        return parse_repository(body, config, limit)
    raise ValueError(f"unknown source type {source_type!r}")


def read_entries(pages: DataFrame, limit: int = 15) -> DataFrame:
    """Entries of fetched pages: source_id, source_rank, source_type, body, base_url, extra (struct or JSON text), error.

    A page that can't be read yields one row with its error and no entry, and doesn't disturb the others; so does a page that already
    carries an error, or a null body.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                key = {"source_id": r["source_id"], "source_rank": r["source_rank"]}
                try:
                    if r.get("error"):
                        raise ValueError(r["error"])
                    if r["body"] is None:
                        raise ValueError("nothing was fetched")
                    extra = json.loads(r["extra"]) if isinstance(r["extra"], str) else r["extra"]
                    found = entries_of(r["source_type"], r["body"], r["base_url"], extra, limit)
                    out += [key | e | {"entry_pos": i, "error": None} for i, e in enumerate(found)]
                except Exception as e:  # kept with the source
                    out.append(key | {"error": str(e) or type(e).__name__})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = pa.schema([("source_id", pa.int32()), ("source_rank", pa.int32()), ("entry_pos", pa.int32()), *[(c, pa.string()) for c in ("title", "url", "content", "published_at", "image_url", "error")]])
    return pages.mapInArrow(run, ENTRIES)
