import base64
import json

from feedmill.sources import listings
from feedmill.sources.fetch import PageSource, RobotsGate

LISTING = """<article><h2><a href="/one">First  item</a></h2><time datetime="2026-05-01">May</time><p>Body one</p><img src="/i.png"></article>
<article><h2><a href="https://o.example/two">Second</a></h2><p></p></article><article><h2>No link</h2></article>"""
CONFIG = {"itemSelector": "article", "titleSelector": "h2 a", "linkSelector": "h2 a", "dateSelector": "time", "contentSelector": "p"}
RSS = """<?xml version="1.0"?><rss xmlns:media="http://search.yahoo.com/mrss/" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>
<item><title>A</title><link>https://o.example/a</link><pubDate>Tue, 28 May 2024 03:07:26 +0200</pubDate><content:encoded><![CDATA[<p>x</p><img src="https://o.example/c.png">]]></content:encoded><media:thumbnail url="https://o.example/t.png"/></item>
<item><title>No address</title></item>
<item><title>B</title><guid>https://o.example/b</guid><description>d</description><enclosure url="https://o.example/e.mp3" type="audio/mpeg"/></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link rel="alternate" href="https://o.example/t"/><updated>2026-01-02T03:04:05Z</updated><summary>s</summary></entry></feed>"""


def test_listing():
    a, b = listings.parse_listing(LISTING, CONFIG, "https://o.example/blog")
    assert a == {"title": "First item", "url": "https://o.example/one", "content": "Body one", "published_at": "2026-05-01", "image_url": "https://o.example/i.png"}
    assert b["content"] == "Second" and b["published_at"] == "" and b["image_url"] is None
    whole = listings.parse_listing("<a class=c href=/z>Z <b>z</b></a>", {"itemSelector": "a.c"}, "https://o.example")
    assert whole == [{"title": "Z z", "url": "https://o.example/z", "content": "Z z", "published_at": None, "image_url": None}]


def test_feeds():
    a, b = listings.parse_feed(RSS, 15)
    assert a["image_url"] == "https://o.example/t.png" and a["published_at"] == "2024-05-28T01:07:26.000Z" and a["content"].startswith("<p>x")
    assert b["url"] == "https://o.example/b" and b["content"] == "d" and b["image_url"] is None
    assert [e["title"] for e in listings.parse_feed(RSS, 2)] == ["A"]  # cut before the unusable ones are dropped
    (t,) = listings.parse_feed(ATOM, 5)
    assert t["url"] == "https://o.example/t" and t["published_at"] == "2026-01-02T03:04:05.000Z" and t["content"] == "s"


def test_repositories():
    releases = [{"draft": True, "tag_name": "d", "html_url": "u0"}, {"draft": False, "name": " ", "tag_name": "v1", "html_url": "u1", "body": None, "published_at": "2026-01-01T00:00:00Z"}]
    assert listings.parse_repository(json.dumps(releases), {}, 5) == [{"title": "v1", "url": "u1", "content": " ", "published_at": "2026-01-01T00:00:00Z", "image_url": None}]
    commits = [{"html_url": "c", "sha": "s", "commit": {"message": "one\ntwo", "committer": {"date": "2026"}}}, {"html_url": "c", "sha": "s", "commit": {"message": ""}}]
    assert [e["title"] for e in listings.parse_repository(json.dumps(commits), {"mode": "commits"}, 5)] == ["one", ""]
    file = {"content": base64.b64encode("é".encode()).decode(), "encoding": "base64", "html_url": "f"}
    assert listings.parse_repository(json.dumps(file), {"mode": "file", "repo": "r", "path": "C.md"}, 5)[0] == {"title": "r C.md updated", "url": "f", "content": "é", "published_at": None, "image_url": None}


def test_reading_isolates_failures(spark):
    rows = [(1, 0, "rss", RSS, "https://o.example", None, None), (2, 1, "html", LISTING, "https://o.example", json.dumps({"html": CONFIG}), None), (3, 2, "rss", "<broken", "b", None, None), (4, 3, "html", "x", "b", None, None), (5, 4, "odd", "x", "b", None, None), (6, 5, "rss", None, "b", None, "HTTP 500")]
    df = spark.createDataFrame(rows, "source_id int, source_rank int, source_type string, body string, base_url string, extra string, error string")
    got = listings.read_entries(df, 15).collect()
    assert sorted((r.source_id, r.entry_pos) for r in got if r.error is None) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert {r.source_id for r in got if r.error} == {3, 4, 5, 6}
    assert listings.read_entries(df.limit(0)).count() == 0


def test_page_source_reads_one_partition_per_source(spark, tmp_path):
    page = tmp_path / "p.html"
    page.write_text(LISTING)
    spark.dataSource.register(PageSource)
    sources = [{"id": 7, "source_type": "html", "source_url": page.as_uri(), "extra": {"html": CONFIG}}, {"id": 8, "source_type": "html", "source_url": (tmp_path / "none").as_uri(), "extra": {}}]
    df = spark.read.format("feed_pages").option("sources", json.dumps(sources)).option("robots", "false").load()
    got = {r.source_id: r for r in df.collect()}
    assert got[7].body == LISTING and got[7].error is None and got[8].body is None and got[8].error


def test_robots_gate_keeps_answers():
    calls = []

    def get(url, timeout, agent):
        calls.append(url)
        if "down" in url:
            raise OSError
        return (404, "Disallow: /", url) if "none" in url else (200, "User-agent: *\nDisallow: /p", url)

    gate = RobotsGate(get, ttl=10)
    assert gate("https://a.example/x", 0) and not gate("https://a.example/p", 5) and len(calls) == 1
    assert gate("https://a.example/x", 20) and len(calls) == 2
    assert gate("https://none.example/p", 0) and gate("https://down.example/p", 0) and not gate("nonsense", 0)
