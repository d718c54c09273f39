"""Rules with given values, and pages, feeds and lists written by hand."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pressroom.functions import articles, links, markup, urls
from pressroom.operators import discovery, listings, pages, sources
from pressroom.sources import sites
from pressroom.streaming.streams import next_state

NOW = datetime(2024, 1, 8)




@pytest.mark.parametrize(
    ("domain", "country", "language", "name"),
    [
        ("motor1.com", "US", "en", "Motor1"), ("caranddriver.com", "US", "ar", "Caranddriver"), ("thedrive.com", "US", "th", "Thedrive"), ("oto.detik.com", "US", "de", "Oto"),
        ("carexpert.com.au", "AU", "ar", "Carexpert"), ("car1.hk", "HK", "ar", "Car1"),
    ],
)
def test_site_rules(spark, domain, country, language, name):
    found = discovery.sites_of_lines(spark.createDataFrame([(1, f"https://{domain}")], "position long, line string")).first()
    assert (found.country, found.language, found.name) == (country, language, name)


def test_site_list(spark, tmp_path):
    (tmp_path / "list").write_text("# no\n\n是否 x\nhttps://www.a.com/news\na.com\n  b.de  \nnot a site\nhttps://B.de/x\n")
    found = {r.domain: r.url for r in sites.read_site_list(spark, str(tmp_path / "list")).collect()}
    assert found == {"a.com": "https://www.a.com/news", "b.de": "https://b.de", "B.de": "https://B.de/x"}


def test_normalized_path_parameters():
    assert urls.normalized("http://a.com/a/;x=1") == "http://a.com/a;x=1"
    assert urls.normalized("http://a.com/a;b/c/") == "http://a.com/a;b/c"
    assert urls.normalized("http://a.com/a/;") == "http://a.com/a"


HOURS, DAYS = {9: 10, 10: 15, 14: 8, 20: 2}, {0: 20, 1: 25, 2: 22, 3: 18, 4: 15, 5: 5, 6: 3}


@pytest.mark.parametrize(
    ("hours", "days", "hour", "day", "expected"),
    [
        (HOURS, DAYS, 9, 1, (True, "normal_activity")), (HOURS, DAYS, 3, 1, (False, "low_activity_hour")), (HOURS, DAYS, 9, 6, (False, "low_weekend_activity")),
        ({}, {}, 9, 1, (True, "no_pattern_data")), ({9: 0}, DAYS, 9, 1, (True, "no_articles")), ({9: 1, 10: 99}, DAYS, 9, 1, (False, "very_low_activity_hour")),
    ],
)
def test_should_crawl_now(spark, hours, days, hour, day, expected):
    df = spark.createDataFrame([(hours, days, hour, day)], "h map<int,bigint>, w map<int,bigint>, hour int, day int")
    assert tuple(df.select(sources.should_crawl_now(F.col("h"), F.col("w"), F.col("hour"), F.col("day")).alias("x")).first().x) == expected


@pytest.mark.parametrize(("hours", "hour", "expected"), [({9: 10, 10: 15, 14: 8}, 10, 120), ({9: 10, 10: 15, 14: 8}, 3, 480), ({}, 3, 240), ({1: 5, 2: 5, 3: 5, 4: 5}, 4, 240)])
def test_optimized_interval(spark, hours, hour, expected):
    df = spark.createDataFrame([(hours, hour)], "h map<int,bigint>, hour int")
    assert df.select(sources.optimized_interval(F.lit(240), F.col("h"), F.col("hour")).alias("x")).first().x == expected


def test_back_off(spark):
    base = F.lit(NOW)
    hours = lambda errors: spark.range(1).select(sources.next_crawl_at(base, F.lit(240), F.lit(errors)).alias("x")).first().x - NOW
    assert [hours(e).total_seconds() / 60 for e in (0, 3, 10, 11)] == [240, 1920, 245760, 245760]


def test_health_times_and_parts(spark, monkeypatch):
    rows = [(1, k, "error", 0) for k in range(20)] + [(2, k, "success" if k == 7 else "error", k) for k in range(12)]
    logs = spark.createDataFrame(rows, "source_id int, id int, status string, articles_new int").withColumn("started_at", F.timestamp_seconds("id"))
    whole = sorted(map(tuple, sources.health(logs).collect()))
    assert whole[0][:4] == (1, "paused", 20, 20) and (whole[0][4].second, whole[0][5].second) == (4, 14)
    assert whole[1][:4] == (2, "active", 4, 4) and whole[1][4].second == 4 and whole[1][5] is None
    monkeypatch.setattr(sources, "STRETCH", 3)
    assert sorted(map(tuple, sources.health(logs).collect())) == whole


def _replayed(logs):
    """Health and frequency of each source, one log after the other, by the rules that the streams use; times of the last changes too."""
    out = {}
    for r in logs:
        state, degraded, paused = out.get(r[0], (("active", 0, 0, 240, 0.0, 0), None, None))
        after = next_state(state, *r[3:])
        degraded = r[2] if state[0] == "active" and after[0] == "degraded" else degraded
        paused = r[2] if state[0] == "degraded" and after[0] == "paused" else paused
        out[r[0]] = after, degraded, paused
    return out


def _folded(logs):
    healths = {r.source_id: r for r in logs.transform(sources.health).withColumns({c: F.unix_seconds(c) for c in ("degraded_at", "paused_at")}).collect()}
    rates = {r.source_id: (r.interval_minutes, r.average_new, r.crawl_count) for r in sources.frequency(logs).collect()}
    return {k: ((h.status, h.consecutive_errors, h.days_without_new, *rates.get(k, (240, 0.0, 0))), h.degraded_at, h.paused_at) for k, h in healths.items()}


LOG = "source_id long, id long, at long, status string, articles_new int, articles_found int"


@pytest.mark.parametrize("stretch", [1, 2, 7, 10_000])
def test_folds_of_any_stretches(spark, monkeypatch, stretch):
    """Runs of errors across stretches and parts, sources of one to some hundred logs."""
    monkeypatch.setattr(sources, "STRETCH", stretch)
    rng = random.Random(stretch)
    rows = []
    for source, (n, bad) in enumerate([(1, 0), (1, 1), (2, 0.5), (300, 0.9), (300, 0.97), (200, 0.1), (40, 0), (40, 1), (500, 0.5)]):
        for k in range(n):
            found = rng.choice([0, 1, 5, 40])
            rows.append((source, k, k // 3, "error" if rng.random() < bad else "success", rng.randint(0, found), found))
    logs = spark.createDataFrame(rows, LOG).withColumn("started_at", F.timestamp_seconds("at"))
    found = _folded(logs.repartition(5))
    wanted = _replayed(rows)
    assert found.keys() == wanted.keys()
    for k, (state, *times) in wanted.items():
        assert (*found[k][0][:4], found[k][0][5], *found[k][1:]) == (*state[:4], state[5], *times)
        assert found[k][0][4] == pytest.approx(state[4])


def test_fold_of_a_source_with_a_million_logs(spark):
    """Spread over all partitions, none of which holds it whole, and folded in three rounds."""
    n = 1_000_000
    kind = F.when(F.xxhash64("id") % 10 < 8, "error").otherwise("success")
    found = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(30)).cast("int")
    logs = spark.range(n).select(F.lit(7).cast("long").alias("source_id"), "id", F.col("id").alias("at"), kind.alias("status"), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)) * found / 1500).cast("int").alias("articles_new"), found.alias("articles_found"))
    sizes = [r["count"] for r in sources._stretches(logs.withColumn("started_at", F.timestamp_seconds("at")), "status").groupBy("part").agg(F.sum(F.size("log")).alias("count")).collect()]
    assert sum(sizes) == n and max(sizes) < 0.6 * n
    folded = _folded(logs.withColumn("started_at", F.timestamp_seconds("at")))
    wanted = _replayed(map(tuple, logs.toPandas().itertuples(index=False)))
    (state, *times), (mine, *my_times) = wanted[7], folded[7]
    assert (*mine[:4], mine[5], *my_times) == (*state[:4], state[5], *times) and mine[4] == pytest.approx(state[4])


def test_folds_of_nothing(spark):
    none = spark.createDataFrame([], LOG).withColumn("started_at", F.timestamp_seconds("at"))
    assert sources.health(none).count() == sources.frequency(none).count() == 0
    with pytest.raises(ValueError):
        sources.frequency(none, 10)


def test_daily_rules(spark):
    rows = [(1, "active", "high", 30), (2, "active", "high", 90), (3, "degraded", "high", 90), (4, "paused", "high", 99), (5, "active", "high", 29)]
    df = spark.createDataFrame(rows, "id int, status string, priority string, days_without_new int")
    found = {r.id: (r.status, r.priority) for r in sources.daily_health_rules(df, F.lit(NOW)).collect()}
    assert found == {1: ("active", "low"), 2: ("archived", "low"), 3: ("archived", "high"), 4: ("paused", "high"), 5: ("active", "high")}


def test_three_times(spark):
    rows = [("US", None), ("CN", None), ("??", None), (None, "Asia/Tokyo"), ("DE", None)]
    df = spark.createDataFrame(rows, "country string, zone string").select("country", "zone", F.to_timestamp_ntz(F.lit("2026-03-29 02:30:00")).alias("t"))
    found = [r.x for r in df.select(articles.three_times(F.col("t"), F.col("country"), F.col("zone")).alias("x")).collect()]
    assert [x.utc.strftime("%d %H:%M") for x in found] == ["29 06:30", "28 18:30", "29 02:30", "28 17:30", "29 01:30"]
    assert [x.beijing.strftime("%d %H:%M") for x in found] == ["29 14:30", "29 02:30", "29 10:30", "29 01:30", "29 09:30"]


def test_times_that_clocks_show_twice(spark):
    """They stand for the second time, also where clocks are put back by half an hour or a whole day; beside them nothing changes."""
    rows = [
        ("Australia/Sydney", "2024-04-07 01:59:59", "2024-04-06 14:59:59"), ("Australia/Sydney", "2024-04-07 02:00:00", "2024-04-06 16:00:00"),
        ("Australia/Sydney", "2024-04-07 02:40:00", "2024-04-06 16:40:00"), ("Australia/Sydney", "2024-04-07 03:00:00", "2024-04-06 17:00:00"),
        ("Europe/London", "2024-10-27 01:30:00", "2024-10-27 01:30:00"), ("America/New_York", "2024-11-03 01:00:00", "2024-11-03 06:00:00"),
        ("Australia/Lord_Howe", "2024-04-07 01:45:00", "2024-04-06 15:15:00"), ("Pacific/Kwajalein", "1969-09-30 12:00:00", "1969-10-01 00:00:00"), (None, "2024-04-07 02:40:00", "2024-04-07 02:40:00"),
    ]
    df = spark.createDataFrame(rows, "zone string, t string, e string").withColumn("t", F.to_timestamp_ntz("t"))
    found = df.select("e", articles.three_times(F.col("t"), F.lit(None).cast("string"), F.col("zone"))["utc"].cast("string").alias("utc"))
    assert [r.utc for r in found.collect()] == [r[2] for r in rows]


@pytest.mark.parametrize(
    ("said", "expected"),
    [
        ("2026-04-15T10:00:00Z", "2026-04-15 10:00"), ("2026-04-15T10:00:00+02:00", "2026-04-15 08:00"), ("Wed, 15 Apr 2026 10:00:00 +0000", "2026-04-15 10:00"),
        ("Wed, 15 Apr 2026 10:00:00 GMT", "2026-04-15 10:00"), ("April 15, 2026", "2026-04-15 00:00"), ("2026/04/15", "2026-04-15 00:00"), ("yesterday", None), (None, None),
    ],
)
def test_publish_dates(spark, said, expected):
    found = spark.createDataFrame([(said,)], "s string").select(articles.parse_publish_date(F.col("s")).alias("x")).first().x
    assert (found and found.strftime("%Y-%m-%d %H:%M")) == expected


def test_news_articles(spark):
    body = "word " * 60
    menu = "Home News Sports Entertainment Business " + "x " * 60
    rows = [
        ("http://a.com/x/privacy/", "t", body, False), ("http://a.com/privacy/x", "t", body, True), ("http://a.com/x", "Our Cookie Policy", body, False), ("http://a.com/x", None, None, True),
        ("http://a.com/x", "t", "short", False), ("http://a.com/x", "t", menu, False), ("http://a.com/x", "t", menu + "y" * 400, True), ("http://a.com/x", "t", "", True),
    ]
    df = spark.createDataFrame(rows, "url string, title string, content string, e boolean")
    assert df.where(articles.is_news_article(F.col("url"), F.col("title"), F.col("content")) != F.col("e")).count() == 0


def test_blacklists_and_topics(spark):
    rows = [("facebook.com", True), ("m.facebook.com", True), ("notfacebook.com", False), ("motor1.com", False), ("cloud.google.com", True), (None, None)]
    df = spark.createDataFrame(rows, "d string, e boolean")
    assert df.where(~links.is_blacklisted(F.col("d")).eqNullSafe(F.col("e"))).count() == 0
    said = '{"is_automotive": true, "confidence": 0.5, "reason": "{x}"}'
    found = spark.createDataFrame([(f"So {said} ok",), ("none",), ("{broken",)], "s string").select(links.parse_analysis_json(F.col("s")).alias("x")).collect()
    assert found[0].x.confidence == 0.5 and found[1].x is None and found[2].x is None


PAGE = """<html lang="en-GB"><head><title>T &amp; more</title><meta property="og:image" content="/lead.jpg"><meta name="author" content="Ann">
<link rel="alternate" type="application/rss+xml" href="/feed.xml"></head><body><nav><p>menu</p><a href="/2024/05/own">x</a></nav>
<article><h1>Head <b>line</b></h1><time datetime="2024-05-01T08:00:00Z"></time><p>First<br>part</p><p>Second &lt;x&gt; part</p><script>var a = "<p>no</p>";</script>
<img src="a.png"><img data-src="/b.png"><img src="a.png"><img></article><p>outside</p><a href="https://www.facebook.com/a">f</a><a href="mailto:x@y.z">m</a>
<a href="https://news.other.org/story">o</a><a href="https://news.other.org/story">o</a><a href="https://other.org/tag/x">t</a><a href="http://www.site.com/about/12345">a</a></body></html>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, "http://www.site.com/en/page", PAGE), (2, "http://b.com/", None), (3, None, "<p>x"), (4, "http://c.com/", "<![broken")], "id long, url string, html string")
    found = {r.id: r for r in pages.extract_pages(df).collect()}
    page = found[1]
    assert (page.title, page.content, page.author, page.language) == ("Head line", "First part\nSecond <x> part", "Ann", "en-GB")
    assert page.published_at == datetime(2024, 5, 1, 8) and page.image_url == "http://www.site.com/lead.jpg"
    assert page.image_urls == ["http://www.site.com/en/a.png", "http://www.site.com/b.png"]
    assert page.external_links == ["https://news.other.org/story"]
    assert (found[2].title, found[2].content, found[2].success) == (None, None, False) and found[4].success is False
    assert found[3].content == "x"
    assert [(r.id, r.position, r.link) for r in pages.article_links(df).collect()] == [(1, 0, "http://www.site.com/2024/05/own")]
    assert df.select(links.feed_link(F.col("html")).alias("x")).first().x == "/feed.xml"
    assert df.select(markup.html_text(F.col("html")).alias("x")).first().x.startswith("T & more menu x Head line First part Second <x> part")


LIST_PAGE = """<body><div id="menu"><ul><li><a href="/a">A long entry of the menu with many words in it that lead to other pages</a></li><li><a href="/b">Another one</a></li></ul></div>
<div id="wrap"><div id="side"><p>Short note.</p><p><a href="/c">Read the whole story of this and that here</a></p></div>
<section><p>First paragraph of the story, which is of some length, as stories have it.</p><div><p>A box within the story, of a few words.</p></div>
<p>Second paragraph with <a href="/d">a link</a> in it, and more words after that.</p><ul><li><a href="/e">See also: everything else</a></li></ul></section></div><p>Imprint</p></body>"""


def test_bodies_without_article(spark):
    """The element with most text of its own wins, boxes within it included, menus not; of several articles the one with most text."""
    two = "<article><p>Teaser of one.</p></article><article><p>The story itself,</p><div><p>longer than its teaser.</p></div></article><article><p>x</p></article>"
    rows = [(1, LIST_PAGE), (2, two), (3, "<div><p><a href='/x'>only a link</a></p></div>"), (4, "<p>loose</p></div></section><p>blocks"), (5, "<div>no block</div>")]
    df = spark.createDataFrame(rows, "id long, html string").withColumn("url", F.lit("http://a.com/x"))
    found = {r.id: r.content for r in pages.extract_pages(df).collect()}
    story = "First paragraph of the story, which is of some length, as stories have it.\nA box within the story, of a few words.\nSecond paragraph with a link in it, and more words after that."
    assert found == {1: story, 2: "The story itself,\nlonger than its teaser.", 3: None, 4: "loose\nblocks", 5: None}


def test_text_of_odd_pages(spark):
    rows = [
        ("a&#8211;b &#x41;&eacute;&hellip; &bogus; &amp;amp;", "a–b Aé… &bogus; &amp;"), ("<p title='a > b'>x</p>y<br/>z", "x y z"), ("<script>if (a < b) { x('</p>') }</script>ok<style>p > a {}</style>", "ok"),
        ("a<!-- <p>no</p> -->b", "a b"), ("<p>open", "open"), (" \n ", ""), (None, None), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ]
    df = spark.createDataFrame(rows, "html string, e string")
    assert df.where(~markup.html_text(F.col("html")).eqNullSafe(F.col("e"))).collect() == []
    assert df.select(markup.html_text(F.lit("abc def"), 5).alias("x")).first().x == "abc d"


def test_references_without_semicolon_stay(spark):
    """What a cut leaves of a reference, names that only begin like one, and the & of a link."""
    rows = [("<b>a&amp;&amp</b> b&quo", "a&&amp b&quo"), ("&copy &copy; &notit; &#65 &#65; &#x42 & &&lt;", "&copy © &notit; &#65 A &#x42 & &<"), ("x&ampy;&amp;lt;", "x&ampy;&lt;")]
    df = spark.createDataFrame(rows, "html string, e string")
    assert df.where(~markup.html_text(F.col("html")).eqNullSafe(F.col("e"))).collect() == []
    page = """<title>T&amp</title><article><h1>Cut &amp; cut&amp</h1><p>Body&quo &lt;x&gt;</p></article><a href="/x?a=1&amp;b=2&copy=3&lt">l&amp</a>"""
    df = spark.createDataFrame([(1, "http://s.com/", page)], "id long, url string, html string")
    assert [(r.href, r.anchor) for r in markup.page_links(df).collect()] == [("/x?a=1&b=2&copy=3&lt", "l&amp")]
    found = pages.extract_pages(df).first()
    assert (found.title, found.content) == ("Cut & cut&amp", "Body&quo <x>")


def test_links_as_rows(spark):
    page = """<a href="/x?a=1&amp;b=2"> One <b>bold</b>\n word</a><a name="none">no</a><a href=" http://[bad ">two<a href="#top">three</a> <a href='mailto:x@y.z'></a>"""
    df = spark.createDataFrame([(1, "https://s.com/p/q", page), (2, None, '<a href="r">x</a>'), (3, "http://s.com", None), (4, "http://s.com", "<![broken")], "id long, url string, html string")
    found = {(r.id, r.position): (r.href, r.link, r.anchor) for r in markup.page_links(df).collect()}
    assert found == {
        (1, 0): ("/x?a=1&b=2", "https://s.com/x?a=1&b=2", "One bold word"), (1, 1): ("http://[bad", None, "two"), (1, 2): ("#top", "https://s.com/p/q#top", "three"),
        (1, 3): ("mailto:x@y.z", "mailto:x@y.z", ""), (2, 0): ("r", "r", "x"),
    }
    markup.register(spark)
    said = spark.sql("SELECT p.id, l.anchor FROM {p} p, LATERAL html_links(p.html, p.url) l WHERE l.link LIKE 'https://%'", p=df)
    assert sorted(map(tuple, said.collect())) == [(1, "One bold word"), (1, "three")]


def test_stored_logs_are_pruned_by_folder(spark, tmp_path):
    path = f"file://{tmp_path}/logs"
    assert sites.prune_stored_logs(spark, path, NOW) == 0
    logs = spark.range(24 * 40).select("id", (F.lit(datetime(2023, 12, 1)).cast("timestamp") + F.make_dt_interval(hours="id")).alias("started_at"))
    sites.append_crawl_logs(logs, path)
    before = {f.name: sorted(x.name for x in f.iterdir()) for f in (tmp_path / "logs").glob("log_date=*")}
    now = datetime(2024, 1, 8, 6, 30)
    assert [sites.prune_stored_logs(spark, path, now, 10) for _ in range(2)] == [28, 0]
    kept = sorted(r.started_at for r in spark.read.parquet(path).collect())
    assert kept == sorted(r.started_at for r in sites.prune_logs(logs, F.lit(now), 10).collect()) and kept[0] == datetime(2023, 12, 29, 7)
    after = {f.name: sorted(x.name for x in f.iterdir()) for f in (tmp_path / "logs").glob("log_date=*")}
    assert all(after[day] == before[day] for day in after if day > "log_date=2023-12-29")
    sites.prune_stored_logs(spark, path, datetime(2024, 1, 8, 23, 30), 10)
    assert spark.read.parquet(path).where("log_date = '2023-12-29'").count() == 0


FEED = """<rss><channel><title>feed</title><item><title>Old &amp; new</title><link>https://a.com/1</link><pubDate>Wed, 01 May 2024 10:00:00 +0000</pubDate><description>d1</description></item>
<item><link>https://a.com/2</link></item><item><title><![CDATA[Later <b>]]></title><link>https://a.com/3</link><pubDate>Thu, 02 May 2024 10:00:00 +0000</pubDate><dc:creator>Bo</dc:creator></item></channel></rss>"""
ATOM = """<feed><entry><title>E</title><link rel="alternate" href="https://b.com/1"/><updated>2024-05-03T00:00:00Z</updated><author><name>Cy</name></author><summary>s</summary></entry></feed>"""


def test_feeds(spark):
    long_feed = "<rss>" + "".join(f"<item><title>{k}</title></item>" for k in range(51)) + "</rss>"
    df = spark.createDataFrame([(1, FEED), (2, ATOM), (3, long_feed), (4, "broken"), (5, None)], "source_id long, xml string")
    found = sites.read_feed(df).orderBy("source_id", "position").collect()
    rss = [(r.title, r.url, r.author, r.summary) for r in found if r.source_id == 1]
    assert rss == [("Later <b>", "https://a.com/3", "Bo", None), ("Old & new", "https://a.com/1", None, "d1"), ("Untitled", "https://a.com/2", None, None)]
    assert [(r.title, r.url, r.published_at, r.author, r.summary) for r in found if r.source_id == 2] == [("E", "https://b.com/1", datetime(2024, 5, 3), "Cy", "s")]
    assert [r.source_id for r in found].count(3) == 50 and not {4, 5} & {r.source_id for r in found}


WILD = """<?xml version="1.0"?><!DOCTYPE rss><rss xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:media="http://m" xmlns:atom="http://a"><channel><atom:link href="https://self"/>
<item><media:title>no</media:title><media:content url="x > y"><media:credit>no</media:credit></media:content><title type="html">A &#8211; B &amp;amp; C&#x2026;</title><atom:link href="https://no"/>
<link>https://a.com/1?x=1&amp;y=2</link><dc:creator>Ann</dc:creator><dc:creator>Bo</dc:creator><description><![CDATA[<p>x &amp; y</p> ]]]]><![CDATA[> z]]></description><pubDate>Wed, 01 May 2024 10:00:00 GMT</pubDate></item>
<item><title>un<![CDATA[ded & more]]></title></item></channel></rss>"""
RDF = """<rdf:RDF xmlns:rdf="http://r" xmlns:dc="http://d"><channel><title>c</title></channel><item><title>beside</title><link>https://r.com/1</link><dc:date>2024-05-01T00:00:00Z</dc:date></item></rdf:RDF>"""
LINKED = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>t</title><link rel="self" href="https://s"/><link href="https://page"/><summary type="xhtml"><div>s <b>t</b></div></summary></entry></feed>"""


def test_feeds_in_the_wild(spark):
    """Elements of other name spaces, several links and authors, CDATA in pieces, character references; and one that is not well-formed."""
    broken = "<rss><channel><item><title>R&nbsp;1 &amp; 2</title><link>https://x.com/1</link></item><item><title>2</title></item>"
    df = spark.createDataFrame([(1, WILD), (2, RDF), (3, LINKED), (4, broken)], "source_id long, xml string")
    found = {(r.source_id, r.position): (r.title, r.url, r.author, r.summary) for r in sites.read_feed(df).collect()}
    assert found == {
        (1, 1): ("A – B &amp; C…", "https://a.com/1?x=1&y=2", "Ann", "<p>x &amp; y</p> ]]> z"), (1, 2): ("unded & more", "", None, None), (2, 1): ("beside", "https://r.com/1", None, None),
        (3, 1): ("t", "https://page", None, "<div>s <b>t</b></div>"), (4, 1): ("R&nbsp;1 & 2", "https://x.com/1", None, None), (4, 2): ("2", "", None, None),
    }


def test_patches(spark):
    rows = [(1, "active", "low", 1, 240), (2, "active", "low", 1, 240)]
    kinds = "id long, status string, priority string, tier int, crawl_interval_minutes int"
    patches = spark.createDataFrame([(1, "paused", None, 2, None), (2, "gone", "high", None, None), (9, "paused", None, None, None)], kinds)
    out, rejected = listings.patch_sources(spark.createDataFrame(rows, kinds), patches)
    assert sorted(map(tuple, out.collect())) == [(1, "paused", "low", 2, 240), (2, "active", "low", 1, 240)]
    assert sorted(r.id for r in rejected.collect()) == [2, 9]


def test_mining_and_merging(spark):
    now = F.lit(NOW)
    link = "article_id long, article_title string, crawled_at timestamp, url string"
    rows = [(k, "t", datetime(2024, 1, 7, 12), "https://www.carnews.org/a") for k in (1, 1, 2, 3, 4)]
    rows += [(5, "t", datetime(2024, 1, 7, 12), "https://facebook.com/car"), (6, "t", datetime(2024, 1, 7, 12), "https://plain.org/"), (7, "t", datetime(2024, 1, 1), "https://oldcar.org/"), (8, "t", NOW, None)]
    df = spark.createDataFrame(rows, link)
    mined = discovery.mine_link_candidates(df, now)
    assert [(r.domain, r.mentions, [d.article_id for d in r.discovered_from]) for r in mined.collect()] == [("carnews.org", 5, [1, 2, 3, 4])]
    assert tuple(discovery.mining_stats(df, now).first()) == (8, 5, 3, 1)
    kinds = (
        "domain string, url string, mention_count long, first_seen_at timestamp, "
        f"last_seen_at timestamp, auto_analysis struct<{', '.join(':'.join(c.split()) for c in links.ANALYSIS.split(', '))}>, status string"
    )
    known = spark.createDataFrame([("carnews.org", "u", 3, NOW, NOW, None, "new"), ("other.org", "u", 9, NOW, NOW, None, "rejected")], kinds)
    before = spark.createDataFrame([("carnews.org", 2, "t", "u")], "domain string, article_id long, article_title string, url string")
    none, found = spark.createDataFrame([], "domain string"), discovery.link_mentions(df, now)
    out, added = discovery.merge_candidates(known, before, found, none, now)
    assert sorted(r.article_id for r in added.collect()) == [1, 3, 4]
    merged = {r.domain: r for r in discovery.with_mentions(out, before.unionByName(added), 3).collect()}
    assert (merged["carnews.org"].mention_count, merged["carnews.org"].status, merged["carnews.org"].articles) == (4, "new", 4)
    assert [d.article_id for d in merged["carnews.org"].discovered_from] == [1, 2, 3]
    assert (merged["other.org"].status, merged["other.org"].articles, merged["other.org"].discovered_from) == ("rejected", 0, None)
    fresh = discovery.merge_candidates(known.where("false"), before.where("false"), found, none, now)[0].first()
    assert (fresh.mention_count, fresh.status) == (5, "pending_analysis")
    assert discovery.merge_candidates(known.where("false"), before, found, mined.select("domain"), now)[0].count() == 0


def test_a_domain_of_very_many_mentions(spark):
    """Shuffled by domain are counts and a few shown mentions of each part, not the mentions."""
    mentions = spark.range(200_000).select(F.lit("hot.org").alias("domain"), F.col("id").alias("article_id"), F.lit("t").alias("article_title"), F.lit("u").alias("url"))
    row = discovery.with_mentions(mentions.select("domain").distinct(), mentions, 5).first()
    assert row.articles == 200_000 and [d.article_id for d in row.discovered_from] == [0, 1, 2, 3, 4]
