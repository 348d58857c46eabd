"""A Python data source that fetches the page of each source: one partition per origin, failures kept as rows.

spark.dataSource.register(PageSource); spark.read.format("feed_pages").option("sources", json).load()
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import robots

PAGES = "source_id int, source_rank int, source_type string, body string, base_url string, extra string, error string"
DENIED = "disallowed-by-robots"


def http_get(url: str, timeout: float, agent: str) -> tuple[int, str, str]:
    """(status, text, final address); redirects are followed, an error status doesn't raise."""
    request = urllib.request.Request(url, headers={"user-agent": agent, "accept": "*/*"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return getattr(r, "status", None) or 200, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), r.geturl()
    except urllib.error.HTTPError as e:
        return e.code, "", url


class RobotsGate:
    """Permissions per origin, kept for ``ttl`` seconds; open if robots.txt can't be fetched, closed for an unreadable address."""

    def __init__(self, get=http_get, timeout: float = 15.0, agent: str = "feedmill", ttl: float = 6 * 3600) -> None:
        self.get, self.timeout, self.agent, self.ttl, self.kept = get, timeout, agent, ttl, {}

    def __call__(self, url: str, now: float | None = None) -> bool:
        u = urlsplit(url)
        if not u.scheme or not u.netloc:
            return False
        origin, now = f"{u.scheme}://{u.netloc}", time.time() if now is None else now
        if origin not in self.kept or now - self.kept[origin][1] > self.ttl:
            try:
                status, text, _ = self.get(f"{origin}/robots.txt", self.timeout, self.agent)
            except OSError:
                return True
            self.kept[origin] = (text if 200 <= status < 300 else "", now)
        return robots.allowed(self.kept[origin][0], (u.path or "/") + (f"?{u.query}" if u.query else ""), self.agent)


class _Part(InputPartition):
    """The sources of one origin: they share its robots.txt, and it gets one request at a time."""

    def __init__(self, sources: list[dict]) -> None:
        self.sources = sources


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.sources = json.loads(options["sources"])
        self.timeout, self.agent, self.limit = float(options.get("timeout", 15)), options.get("agent", "feedmill"), int(options.get("limit", 15))
        self.gate = options.get("robots", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        by_origin: dict[str, list[dict]] = {}
        for i, s in enumerate(self.sources):
            u = urlsplit(self.address(s))
            by_origin.setdefault(f"{u.scheme}://{u.netloc or i}", []).append(s | {"rank": i})
        return [_Part(x) for x in by_origin.values()]

    def address(self, s: dict) -> str:
        g = (s.get("extra") or {}).get("github") if s["source_type"] == "github" else None
        if not g:
            return s["source_url"]
        api, n = f"https://api.github.com/repos/{g['owner']}/{g['repo']}", min(self.limit, 30)
        branch = g.get("branch")
        return {
            "releases": f"{api}/releases?per_page={n}",
            "commits": f"{api}/commits?per_page={n}" + (f"&sha={branch}" if branch else ""),
            "file": f"{api}/contents/{g.get('path')}" + (f"?ref={branch}" if branch else ""),
        }[g.get("mode") or "releases"]

    def read(self, partition: _Part | None) -> Iterator[tuple]:
        allowed = RobotsGate(timeout=self.timeout, agent=self.agent)
        for s in partition.sources if partition else ():  # without sources there is one empty partition
            body = base = error = None
            try:
                url = self.address(s)
                if self.gate and s["source_type"] != "github" and url.startswith("http") and not allowed(url):
                    raise PermissionError(DENIED)
                status, body, base = http_get(url, self.timeout, self.agent)
                if not 200 <= status < 300:
                    body, error = None, f"HTTP {status} fetching {url}"
            except Exception as e:  # a source's failure is its own
                error = str(e) or type(e).__name__
            yield s["id"], s["rank"], s["source_type"], body, base or s["source_url"], json.dumps(s.get("extra")), error


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
