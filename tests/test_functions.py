import random

import pytest
from pyspark.sql import functions as F

from pressroom.functions import text, urls
from pressroom.operators import dedup, sources


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://www.example.com/page/?utm_source=google&id=123", "https://example.com/page?id=123"),
        ("https://example.com/page/#section", "https://example.com/page"),
        ("HTTPS://WWW.Example.COM/Path/", "https://example.com/Path"),
        ("https://example.com/", "https://example.com/"),
        ("http://a.com/x?b=2&a=1&b=3", "http://a.com/x?b=2&b=3&a=1"),
        ("http://a.com/x?q=a%20b", "http://a.com/x?q=a+b"),
        ("https://example.com/p?REF=1&Source=z", "https://example.com/p"),
        ("http://www.www.a.com:8080/x//", "http://www.a.com:8080/x/"),
    ],
)
def test_normalized(url, expected):
    assert urls.normalized(url) == expected


def test_simhash_distances(spark):
    titles = ["Toyota announces new electric SUV for 2027", "Toyota announces new electric SUV for 2027 model year", "BMW reveals next-generation 3 Series sedan", ""]
    df = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    hashes = [r[0] for r in df.orderBy("id").select(text.simhash64(text.title_tokens(F.col("title"), F.lit("en")))).collect()]
    assert [bin(hashes[0] ^ h).count("1") for h in hashes[1:3]] == [3, 32]
    assert hashes[3] == 0


def test_intervals(spark):
    cases = [(240, 0.6, 168), (240, 0.5, 240), (240, 0.1, 360), (240, 0.05, 360), (240, 0.0, 480), (30, 0.9, 30), (90, 0.9, 62), (1000, 0.0, 1440)]
    df = spark.createDataFrame(cases, "m int, r double, e int")
    assert df.where(sources.next_interval(F.col("m"), F.col("r")) != F.col("e")).count() == 0


@pytest.mark.parametrize(("failures", "status"), [(4, "active"), (5, "degraded"), (14, "degraded"), (15, "paused")])
def test_health(spark, failures, status):
    rows = [(1, i, "error", 0) for i in range(failures)]
    logs = spark.createDataFrame(rows, "source_id int, id int, status string, articles_new int").withColumn("started_at", F.timestamp_seconds("id"))
    assert sources.health(logs).first()["status"] == status


def test_near_titles_window(spark):
    rows = [(1, "Same title here", "en", 0), (2, "same TITLE here!", "en", 6), (3, "Same title here", "de", 6), (4, "Same title here", "en", 8)]
    df = spark.createDataFrame(rows, "id long, title string, language string, day int").withColumn("crawled_at", F.timestamp_seconds(F.col("day") * 86400))
    assert {(r.id, r.duplicate_of) for r in dedup.near_titles(df).collect()} == {(2, 1), (4, 2)}


def test_plain_addresses_are_normalized_alike(spark):
    """Expressions give what the parser gives, or leave an address to it."""
    rng = random.Random(6)
    parts = ["http", "HTTPS", "://", "://", "www.", "WWW.", "Example.com", ":80", "/", "/", "a", "b.html", ";x", "?", "?", "&", "&", "=", "=", "id", "utm_source", "REF", "1", "%20", "+", "#", "é", "~", "[", "@", " "]
    rows = [("".join(rng.choices(["http://", "HTTPS://www.", "ftp://", ""], [5, 5, 1, 1])[0:1] + rng.choices(parts, k=rng.randrange(1, 14))),) for _ in range(20_000)]
    rows += [(f"http://a.com/x?{'&'.join(f'{rng.choice("abcREF")}={rng.choice(["", "1", "2"])}' for _ in range(rng.randrange(5)))}",) for _ in range(2_000)]
    df = spark.createDataFrame([*rows, (None,)], "url string")
    found = df.select("url", urls._normalize_plain(F.col("url")).alias("plain"), urls.normalize_url("url").alias("normal")).collect()
    assert all(r.normal == (r.url if r.url is None else urls.normalized(r.url)) for r in found)
    assert sum(r.plain is not None for r in found) > 4_000
