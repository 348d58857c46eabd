import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from feedmill.functions import enrich, html, rules, text, url
from feedmill.sources import robots


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


URLS = [
    ("HTTPS://OpenSite.com/News#section", "https://opensite.com/News"),
    ("https://x.com/p?utm_source=tw&b=2&a=1&fbclid=zzz", "https://x.com/p?a=1&b=2"),
    ("https://x.com:443/post/", "https://x.com/post"),
    ("https://x.com/", "https://x.com/"),
    ("https://x.com", "https://x.com/"),
    ("not a url", "not a url"),
    ("  https://x.com/a/?x=1 ", "https://x.com/a/?x=1"),
    ("https://x.com/?ref=a", "https://x.com/"),
    ("https://x.com/a?b=1&a=2&b=0", "https://x.com/a?a=2&b=1&b=0"),
    ("https://x.com/a?b", "https://x.com/a?b="),
    ("http://x.com:8080/a/../b/./c", "http://x.com:8080/b/c"),
    ("https://x.com/a b?q=c d", "https://x.com/a%20b?q=c+d"),
    ("https://x.com/p?q=a~b", "https://x.com/p?q=a%7Eb"),
    ("https://bücher.example/x", "https://xn--bcher-kva.example/x"),
    ("", ""),
    (None, None),
]


def test_canonical_url(spark):
    assert [url.canonicalize(u) for u, _ in URLS] == [v for _, v in URLS]
    assert values(spark, url.canonical_url(F.col("u")), [(u,) for u, _ in URLS], "u string") == [v for _, v in URLS]


@given(st.lists(st.tuples(st.sampled_from(["a", "b", "utm_source", "ref", "c"]), st.text("xyz019-_.", max_size=4)), max_size=5), st.sampled_from(["/", "/a", "/a/b/", ""]), st.sampled_from(["", "#f"]))
@settings(max_examples=60, deadline=None)
def test_canonical_is_idempotent_and_free_of_tracking(params, path, fragment):
    address = "https://Host.example" + path + ("?" + "&".join(f"{k}={v}" for k, v in params) if params else "") + fragment
    once = url.canonicalize(address)
    assert url.canonicalize(once) == once and "utm_source" not in once and "ref=" not in once
    assert once == url.canonicalize(address + ("&" if "?" in address and not fragment else "?" if not fragment else "") + ("gclid=1" if not fragment else ""))


def test_official_domain(spark):
    cases = [
        ("https://open.com/news/x", "open.com", True), ("https://www.open.com/news", "open.com", True), ("https://help.open.com/x", "open.com", True), ("https://notopen.com/x", "open.com", False),
        ("https://open.com.evil.com/x", "open.com", False), ("https://medium.com/x", "open.com", False), ("::::", "open.com", False), ("https://ai.meta.com/x", "meta.com", True), ("https://open.com", "", False),
        ("https://open.com", None, False), (None, "open.com", False), ("https://OPEN.com./x", "www.Open.com.", True),
    ]
    assert values(spark, url.on_official_domain(F.col("u"), F.col("d")), [c[:2] for c in cases], "u string, d string") == [c[2] for c in cases]


def test_resolve_and_images(spark):
    assert url.resolve("/news/x", "https://open.com/blog") == "https://open.com/news/x"
    assert url.resolve("/news/x", "nonsense") is None
    cases = [("/img/a.png?sig=abc", "https://cdn.test/img/a.png?sig=abc"), ("data:image/png;base64,AA", None), ("ftp://x.y/a.png", None), ("", None), (None, None), ("https://cdn.test/i.png", "https://cdn.test/i.png")]
    assert [url.clean_image(a, "https://cdn.test/post") for a, _ in cases] == [b for _, b in cases]
    assert values(spark, url.clean_image_url(F.col("a"), F.lit("https://cdn.test/post")), [(a,) for a, _ in cases], "a string") == [b for _, b in cases]


def test_text_functions(spark):
    rows = [("  New\n  Model   Released ", "New Model Released"), (" a ", "a"), ("a\r\nb", "a b"), ("", ""), (None, None)]
    assert values(spark, text.normalize_title(F.col("t")), [(a,) for a, _ in rows], "t string") == [b for _, b in rows]
    assert values(spark, text.truncate(F.col("t"), 15), [("one two three four five six seven",), ("short",), ("x" * 20,), (None,), ("",)], "t string") == ["one two three…", "short", "x" * 15 + "…", None, ""]
    assert values(spark, text.detect_language(F.col("t")), [("نموذج جديد للغة",), ("a new model",), ("",), ("اa",)], "t string") == ["ar", "en", "en", "en"]
    assert values(spark, text.source_name(F.col("a"), F.col("b")), [("A", "B"), ("A", ""), ("A", None)], "a string, b string") == ["A · B", "A", "A"]
    bodies = [("", True), ("v0.111.0", True), ("Full Changelog: https://x.y/compare/1", True), ("Real notes about a new feature that people want to read.", False), (None, True)]
    assert values(spark, text.contentless_body(F.col("t")), [(a,) for a, _ in bodies], "t string") == [b for _, b in bodies]


def test_content_hash(spark):
    h = text.content_hash(url.canonical_url(F.col("u")), F.col("t"), F.col("b"))
    base, tracked, spaced, other, moved = values(spark, h, [("https://x.com/a", "T", "body"), ("https://x.com/a/?utm_source=q", "T", "body"), ("https://x.com/a", " t ", "BODY "), ("https://x.com/a", "T", "body!"), ("https://x.com/b", "T", "body")], "u string, t string, b string")
    assert base == tracked == spaced and len({base, other, moved}) == 3 and len(base) == 64


def test_html_to_text():
    assert html.text_of("<div><h1>Title</h1><script>evil()</script><p>Hello <b>world</b></p></div>") == "Title\nHello world"
    assert html.text_of("plain  text") == "plain text"
    assert html.text_of("") == "" and html.text_of(None) is None
    assert html.text_of("<p>a<p>b") == "a\nb"
    assert html.text_of("<ul><li>a<li>b</ul>") == "a\nb"
    assert html.text_of("a &amp; b &eacute; <br>c") == "a & b é\nc"
    assert html.text_of("<title>A</title><ul><li>B</li></ul>") == "AB"


def test_rules(spark):
    cases = [("CVE patched", "security"), ("New pricing tiers", "pricing"), ("We will sunset v1", "deprecation"), ("Claude model", "model"), ("SDK update", "sdk"), ("nothing here", "product"), ("éapi news", "api"), ("rapid", "product")]
    assert values(spark, rules.category(F.col("t")), [(a,) for a, _ in cases], "t string") == [b for _, b in cases]
    cases = [("zero-day exploit", "critical"), ("now GA", "high"), ("deprecating x", "high"), ("new feature", "medium"), ("office note", "low")]
    assert values(spark, rules.impact(F.col("t")), [(a,) for a, _ in cases], "t string") == [b for _, b in cases]
    got = values(spark, rules.tags(F.col("t")), [("Claude and GPT-5 now support the new API and SDK",), ("the and of",), ("zeta zeta alpha beta2 zeta alpha",), ("",)], "t string")
    assert got[0][:4] == ["gpt-5", "gpt", "claude", "api"] and len(got[0]) <= 6
    assert got[1] == [] and got[2] == ["beta", "zeta", "alpha", "beta2"] and got[3] == []


VERSIONS = ["v0.111.0", "b9724", "0.142.0-alpha.4", "2025-11-25-RC", "@ai-sdk/vue@4.0.0-beta.182", "sdk: v0.105.0", "aws-sdk: v0.5.0", "Release 2026.1.26", "CLI v3.0.26", "Release v0.48.0-preview.0"]
HEADLINES = ["Introducing Forge", "GLM-5.2: Built for Long-Horizon Tasks", "", None, "one two three four five 1.0", "release notes"]


def test_version_titles(spark):
    got = values(spark, rules.is_version_title(F.col("t")), [(t,) for t in VERSIONS + HEADLINES], "t string")
    assert got == [True] * len(VERSIONS) + [False] * len(HEADLINES)


def test_model_answers(spark):
    fb = F.struct(F.lit("tool").alias("category"), F.array(F.lit("x")).alias("tags"), F.lit("low").alias("impact"), *[F.lit("f").alias(c) for c in ("title_ar", "summary_ar", "title_en", "summary_en")], F.lit(0.2).alias("confidence"))
    four = '"title_ar":"a","summary_ar":"b","title_en":"c","summary_en":"d"'
    rows = [
        ('```json\n{"category":" Security","impact":"HIGH ","tags":["A",""," b "],' + four + ',"confidence":5}\n```', ("security", ["a", "b"], "high", "a", 1.0)),
        ('{"category":"nope","confidence":"nope",' + four + "}", ("tool", ["x"], "low", "a", 0.6)),
        ('{"category":"api","confidence":0.9,"title_ar":"a"}', ("api", ["x"], "low", "f", 0.3)),
        ('{"category":"api","confidence":-2,' + four + "}", ("api", ["x"], "low", "a", 0.0)),
        ('{"category":"api","confidence":null,' + four + "}", ("api", ["x"], "low", "a", 0.0)),
        ("no json", ("tool", ["x"], "low", "f", 0.2)),
        (None, ("tool", ["x"], "low", "f", 0.2)),
    ]
    got = values(spark, enrich.normalized(enrich.extract_json(F.col("t")), fb), [(a,) for a, _ in rows], "t string")
    assert [(g["category"], g["tags"], g["impact"], g["title_ar"], g["confidence"]) for g in got] == [b for _, b in rows]
    gate = [(True, 0.8, 0.9, "published"), (True, 0.3, 0.35, "published"), (True, 0.8, 0.1, "needs_review"), (False, 0.9, 0.9, "needs_review")]
    assert values(spark, enrich.status(F.col("v"), F.col("c"), F.col("s")), [g[:3] for g in gate], "v boolean, c double, s double") == [g[3] for g in gate]


def test_robots(spark):
    longest = "User-agent: *\nDisallow: /a\nAllow: /a/b\n"
    cases = [
        ("", "/x", True), ("User-agent: *\nDisallow: /private", "/private/x", False), ("User-agent: *\nDisallow: /private", "/open", True), ("User-agent: *\nDisallow:", "/x", True), (longest, "/a/b/c", True), (longest, "/a/c", False),
        ("User-agent: *\nDisallow: /\nUser-agent: feedmill\nAllow: /", "/x", True), ("User-agent: *\nDisallow: /*.pdf$", "/a.pdf", False), ("User-agent: *\nDisallow: /*.pdf$", "/a.pdf.pdf", True),
        ("# c\nUser-agent: * # all\nDisallow: /x # y", "/x", False), (None, "/x", True), ("Disallow: /q", "/q", False),
    ]
    assert [robots.allowed(t, p, "feedmill/1.0") for t, p, _ in cases] == [x for *_, x in cases]
    assert values(spark, robots.is_allowed("feedmill/1.0")(F.col("t"), F.col("p")), [c[:2] for c in cases], "t string, p string") == [x for *_, x in cases]


@pytest.mark.parametrize("selector, n", [("article", 2), (".post", 1), ("article h2 a", 2), ("a[href*='x']", 1), ("article > h2", 2), ("nav, article", 3), ("h2.big a", 1)])
def test_selectors(selector, n):
    page = "<nav><a href='/n'>n</a></nav><article class='post new'><h2 class=big><a href='/x'>X</a></h2></article><article><h2><a href='/y'>Y</a></h2></article>"
    assert len(html.select(html.parse(page), selector)) == n
