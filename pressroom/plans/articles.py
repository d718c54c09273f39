"""Expressions over articles and pages, page jobs, lists, and streams over the given tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from pressroom import constants as C
from pressroom import views
from pressroom.functions import articles as AF
from pressroom.functions import links as LF
from pressroom.functions import markup, text
from pressroom.functions.urls import url_domain
from pressroom.lineage import shared_dir
from pressroom.operators import entities, listings, pages
from pressroom.plans.common import AS, HOST, LATER, NOW, PATH, A, L, matching, now, of_articles, of_logs, of_pages
from pressroom.plans.dedup import COSINE
from pressroom.sources import sites
from pressroom.streaming import streams


def _vectors(spark, d, dims=None):
    """Vectors compared with the first of their label."""
    v = views.table(spark, d, "embeddings")
    heads = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("head"))
    cut = (lambda c: F.col(c)) if dims is None else (lambda c: AF.truncate_dims(F.col(c), dims))
    return v.join(heads, "label").select("vec_id", F.round(text.cosine(cut("embedding"), cut("head")), 5).alias("cosine"))


def _search(spark, d):
    rows, _ = listings.search_articles(
        views.articles(spark, d), views.sources(spark, d), language="en", title="the", first_day="2024-01-03", last_day="2024-01-09", sort="published_at", size=25, page=2
    )
    return rows.select("id", "title", "source_name")


def _search_total(spark, d):
    return listings.search_articles(views.articles(spark, d), views.sources(spark, d), country="GB", is_duplicate=None, size=20, page=3)[1]


def _named(spark, d):
    return listings.with_source_name(views.articles(spark, d), views.sources(spark, d)).select("id", "source_name")


def _quality(articles):
    score = AF.quality_score(F.col("title"), F.col("content"), F.when(F.col("id") % 3 != 0, F.col("published_at")), AF.tag_share(F.concat(F.lit("<p>"), "content", F.lit("</p>"))), F.col("id") % 2 == 0)
    return articles.select("id", F.round(score, 6).alias("quality"), (score >= AF.SUCCESS).alias("success"))


def _news(articles):
    """Every tenth article at an address that is none, every seventh with a title that is none."""
    url = F.concat(F.lit("https://example.com/"), F.when(F.col("id") % 10 == 0, "Privacy-Policy/").otherwise("story/"))
    title = F.when(F.col("id") % 7 == 0, F.concat(F.col("title"), F.lit(" - Sign In"))).otherwise(F.col("title"))
    return articles.select("id", AF.is_news_article(url, title, F.col("content")).alias("is_news"))


def _analysis(articles):
    said = F.concat(F.lit('So: {"is_automotive": true, "confidence": 0.'), F.col("id") % 10, F.lit(', "language": "'), F.coalesce("language", F.lit("")), F.lit('", "reason": "r"} and on.'))
    found = LF.parse_analysis_json(F.when(F.col("id") % 4 == 0, "none").otherwise(said))
    return articles.select("id", found["confidence"].alias("confidence"), found["language"].alias("language"))


def _topics(articles):
    found = LF.keyword_topic_score(F.col("content"))
    return articles.select("id", found["n"].alias("n"), found["is_automotive"].alias("is_automotive"), F.round(found["confidence"], 6).alias("confidence"))


def _times(articles):
    found = AF.three_times(F.col("published_at").cast("timestamp_ntz"), F.col("country"))
    return articles.select("id", found["utc"].alias("utc"), found["beijing"].alias("beijing"))


def _dates(articles):
    """Dates written in several formats, read back."""
    p = F.col("published_at")
    formats = ("EEE, dd MMM yyyy HH:mm:ss '+0000'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "dd MMM yyyy")
    said = F.element_at(F.array(*(F.date_format(p, f) for f in formats), F.lit("yesterday")), (F.col("id") % 5 + 1).cast("int"))
    return articles.select("id", AF.parse_publish_date(said).alias("published_at"))


def _backlog(articles):
    titled = articles.withColumn("title_en", F.when(F.col("language") == "en", F.col("title")))
    return listings.translation_backlog(titled, "en").select("id", F.length("content").alias("chars"))


def _feed_links(spark, d):
    """Pages with the tag of a feed put into every third."""
    p = views.pages(spark, d)
    tag = F.concat(F.lit('<link type="application/rss+xml" title="x" rel=\'alternate\' href="/feed/'), "id", F.lit('.xml">'))
    html = F.when(F.col("id") % 3 == 0, F.replace("html", F.lit("</head>"), F.concat(tag, F.lit("</head>")))).otherwise(F.col("html"))
    return p.select("id", LF.feed_link(html).alias("feed"))


def _linked(spark, d):
    """Pages with links and images put in front of their body: to other sites, to articles of their own, to what is none."""
    p = views.pages(spark, d)
    own = F.concat(F.regexp_extract("url", "^(https?://[^/?#]*)", 1), F.lit("/en/2024/05/"), "id")
    links = [
        F.lit("https://other.example.org/story?id=1"), own, F.lit("/story-of/the-day"), F.lit("https://www.facebook.com/x"), F.lit("https://news.example.org/tag/a"),
        F.lit("mailto:a@b.c"), F.lit("https://other.example.org/story?id=1"), F.lit("/tag/the-day"), F.lit("/"), F.lit("/12345"),
    ]
    anchors = [F.concat(F.lit('<a href="'), link, F.lit('">x</a>')) for link in links]
    images = F.lit('<img src="/i/1.png"><img data-src="https://cdn.example.org/2.png"><img src="/i/1.png">')
    author = [F.lit('<html><head><meta name="author" content="Writer '), "id", F.lit('"></head><body><time datetime="2024-03-01T10:00:00Z"></time>')]
    return p.withColumn("html", F.concat(*author, *anchors, images, F.regexp_extract("html", "(?s)<body>(.*)$", 1)))


def _extracted(spark, d):
    out = pages.extract_pages(_linked(spark, d))
    return out.select(
        "id", "title", "language", "published_at", "image_url", "content", "content_length", "author", "excerpt", F.round("quality", 6).alias("quality"), "success", F.array_join("external_links", " ").alias("external_links")
    )


def _html_links(spark, d):
    """The links that the given pages have, by the table function in SQL."""
    markup.register(spark)
    return spark.sql("SELECT p.id, l.* FROM {pages} p, LATERAL html_links(p.html, p.url) l", pages=views.pages(spark, d))


def _anchors(spark, d):
    """How often each text stands for a link of the given pages, and on how many of them."""
    found = markup.page_links(views.pages(spark, d)).where("anchor <> ''")
    return found.groupBy("anchor").agg(F.count("*").alias("links"), F.count_distinct("id").alias("pages"), F.min("link").alias("first_link"))


def _pruned_logs(spark, d):
    """Logs written by day, those older than ten days deleted, twice; read back."""
    folder = shared_dir(spark)
    sites.append_crawl_logs(views.crawl_logs(spark, d), folder)
    for _ in range(2):
        sites.prune_stored_logs(spark, folder, datetime.fromisoformat(f"{LATER[:10]}T12:30:00"), 10)
    return spark.read.parquet(folder).select("id", "source_id", "log_date")


def _images(spark, d):
    lead, images = pages.page_images(F.col("lead_image"), F.col("images"))
    return pages.parsed(_linked(spark, d)).select("id", lead, F.size(images).alias("n"))


def _external(spark, d):
    found = pages.external_links(F.col("url"), F.col("hrefs"))
    return pages.parsed(_linked(spark, d)).select("id", F.array_join(found, " ").alias("links"), F.size("hrefs").alias("n_hrefs"), F.array_join(F.slice("hrefs", 11, 3), " ").alias("first_own"))


def _own_links(spark, d):
    return pages.article_links(_linked(spark, d))


def _routed(spark, d):
    p = views.pages(spark, d)
    hosts = p.select(F.regexp_replace(F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)), r"^www\.", "").alias("domain")).distinct()
    tiers = hosts.withColumn("tier", (F.length("domain") % 3 + 1).cast("int"))
    adapted = p.select("id", F.when(F.col("id") % 4 != 0, F.concat(F.lit("Title "), "id")).alias("title"), F.lit(None).cast("string").alias("content"), now().alias("published_at"))
    return pages.tier_route(p, tiers, adapted).select("id", "route", F.when(F.col("route") == "adapter", F.col("title")).alias("adapter_title"))


def _adapters(spark, d):
    p = views.pages(spark, d).select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("domain"), F.col("id").alias("position"), F.length("html").alias("n"))
    return pages.adapter_quality(p.select("domain", "position", (F.col("position") % 4 != 0).alias("success"), (F.col("n") % 400).alias("content_length")))


def _distinct_words(articles):
    words = F.array_distinct(F.array_remove(F.split(F.lower("title"), " "), ""))
    return articles.select("id", F.array_join(words, " ").alias("words"))


def _difference(spark, d):
    a = views.articles(spark, d).select("source_id").distinct()
    return a.join(views.sources(spark, d).where("id % 2 = 0").select(F.col("id").alias("source_id")), "source_id", "left_anti").where("source_id IS NOT NULL")


def _stored_articles(spark, d):
    """Written by day, read back from a day on."""
    folder = shared_dir(spark)
    sites.write_articles(views.articles(spark, d).select("id", "title", "crawled_at"), folder)
    return sites.read_articles(spark, folder, "2024-01-03").select("id", "title", "crawl_date")


def _stored_logs(spark, d):
    folder = shared_dir(spark)
    logs = views.crawl_logs(spark, d)
    sites.append_crawl_logs(logs.where("id % 2 = 0"), folder)
    sites.append_crawl_logs(logs.where("id % 2 = 1"), folder)
    return spark.read.parquet(folder).groupBy("log_date").agg(F.count("*").alias("logs"))


def _log_stream(spark, d):
    raw = streams.read_stream(spark, f"{d}/events.parquet*", views.table(spark, d, "events").schema)
    return views.logs_of_events(raw)


def _streamed(spark, d, job):
    folder = shared_dir(spark)
    streams.run_once(job(_log_stream(spark, d)), f"{folder}/checkpoint", path=f"{folder}/out")
    return spark.read.parquet(f"{folder}/out")


def _ingested(spark, d):
    return _streamed(spark, d, lambda logs: logs.select("id", "source_id", "status"))


def _closed_days(spark, d):
    return _streamed(spark, d, streams.daily_counts)


def _closed_spans(spark, d):
    return _streamed(spark, d, lambda logs: streams.last_day_counts(logs.withColumnRenamed("started_at", "crawled_at")))


def _states(spark, d):
    """The state of every source after its logs, kept by the stream."""
    folder = shared_dir(spark)
    streams.run_keyed(streams.source_states(_log_stream(spark, d)), f"{folder}/checkpoint", lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), mode="update")
    out = spark.read.parquet(f"{folder}/out")
    last = out.groupBy("source_id").agg(F.max_by(F.struct(*[c for c in out.columns if c not in ("source_id", "batch")]), "batch").alias("s"))
    return last.select("source_id", "s.*").withColumn("average_new", F.round("average_new", 6))


def _page_stream(spark, d):
    raw = streams.read_stream(spark, f"{d}/pages.parquet*", views.table(spark, d, "pages").schema)
    return raw.select(F.col("page_id").alias("id"), "url", F.timestamp_add("MINUTE", F.col("page_id").cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("crawled_at"))


def _stream_exact(spark, d):
    folder = shared_dir(spark)
    streams.run_keyed(streams.exact_url_stream(_page_stream(spark, d)), f"{folder}/checkpoint", path=f"{folder}/out")
    return spark.read.parquet(f"{folder}/out")


def _stream_within(spark, d):
    folder = shared_dir(spark)
    streams.run_once(streams.exact_url_within(_page_stream(spark, d)).select("url_hash"), f"{folder}/checkpoint", path=f"{folder}/out")
    return spark.read.parquet(f"{folder}/out").select("url_hash")


def _stream_cascade(spark, d):
    """Articles with entities and vectors through levels 2 to 4, as they arrive."""
    folder = shared_dir(spark)
    raw = streams.read_stream(spark, f"{d}/documents.parquet*", views.table(spark, d, "documents").schema)
    named = entities.extract_entities(views.articles_of_documents(raw), views.dictionary(spark))
    vectors = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    # A batch is computed with all columns of its stream.
    named = named.select("id", "crawled_at", "language", "title", entities.entity_set(F.col("entities")).alias("entities"))
    given = named.join(vectors, "id", "left")
    streams.run_once(given, f"{folder}/checkpoint", streams.cascade_batches(f"{folder}/out", cosine=COSINE))
    return spark.read.parquet(f"{folder}/out").select("id", "dedup_level", "duplicate_of")


def _on_time(spark, d):
    """Logs as items that may be late, in a stream joined with the sources."""
    folder = shared_dir(spark)
    known = views.sources(spark, d).select("id", F.when(F.col("id") % 3 != 0, now("2024-01-20")).alias("last_crawl_at"))
    items = _log_stream(spark, d).select("id", "source_id", F.when(F.col("id") % 9 != 0, F.col("started_at")).alias("published_at"))
    streams.run_once(streams.on_time(items, known, now(LATER)).select("id"), f"{folder}/checkpoint", path=f"{folder}/out")
    return spark.read.parquet(f"{folder}/out").select("id")


QUERIES = {
    "f3_url_domain": of_pages(lambda p: p.select("id", url_domain(F.col("url")).alias("domain"))),
    "f4_preprocess_title": of_articles(lambda a: a.select("id", text.preprocess_title(F.col("title")).alias("title"))),
    "f5_title_tokens": of_articles(lambda a: a.select("id", F.array_join(text.title_tokens(F.col("title"), F.when(F.col("id") % 3 == 0, "zh-TW").otherwise(F.col("language"))), "|").alias("tokens"))),
    "f8_excerpt": of_articles(lambda a: a.select("id", text.excerpt(F.col("content")).alias("excerpt"))),
    "f9_quality_score": of_articles(_quality),
    "f10_is_news_article": of_articles(_news),
    "f11_is_article_url": of_pages(lambda p: p.select("id", text.is_article_url(F.try_parse_url(F.col("url"), F.lit("PATH"))).alias("is_article"))),
    "f14_topic_score": of_articles(_topics),
    "f15_analysis_json": of_articles(_analysis),
    "f16_three_times": of_articles(_times),
    "f18_cosine": _vectors,
    "f18_cosine_of_32_dims": lambda spark, d: _vectors(spark, d, 32),
    "f19_publish_date": of_articles(_dates),
    "f20_html_text": of_pages(lambda p: p.select("id", markup.html_text(F.col("html")).alias("text"))),
    "p1_extract_pages": _extracted,
    "p2_page_images": _images,
    "p3_external_links": _external,
    "p3_html_links": _html_links,
    "p3_anchor_texts": _anchors,
    "p4_article_links": _own_links,
    "p7_tier_route": _routed,
    "p8_feed_link": _feed_links,
    "p9_adapter_quality": _adapters,
    "a6_stored_articles": _stored_articles,
    "a7_stored_logs": _stored_logs,
    "a8_pruned_folders": _pruned_logs,
    "w2_search_articles": _search,
    "w2_search_total": _search_total,
    "j1_source_names": _named,
    "t16_translation_backlog": of_articles(_backlog),
    "g11_facets": of_articles(lambda a: a.select("language", "country").distinct()),
    "u2_ordered_distinct": of_articles(_distinct_words),
    "u3_difference": _difference,
    "x1_micro_batches": _ingested,
    "x2_stream_exact_url": _stream_exact,
    "x2_stream_within_watermark": _stream_within,
    "x3_stream_cascade": _stream_cascade,
    "x4_stream_states": _states,
    "x5_closed_days": _closed_days,
    "x5_last_day_counts": _closed_spans,
    "x6_on_time": _on_time,
}

_CLEAN = r"trim(regexp_replace(translate(regexp_replace(title, '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\s+', ' ', 'g'))"
_COSINE = """SELECT vec_id, round(list_cosine_similarity((e.embedding::DOUBLE[]){cut}, (h.head::DOUBLE[]){cut}), 5) AS cosine
  FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS head FROM embeddings GROUP BY label) h USING (label)"""
_REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
_TEXT = "html"
for _pattern in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
    _TEXT = f"regexp_replace({_TEXT}, '{_pattern}', ' ', 'g')"
for _name, _character in _REFERENCES:
    _TEXT = f"replace({_TEXT}, '{_name}', '{_character.replace(chr(39), chr(39) * 2)}')"
_HEAD = "regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')"
for _name, _character in _REFERENCES:
    _HEAD = f"replace({_HEAD}, '{_name}', '{_character.replace(chr(39), chr(39) * 2)}')"
_ZONES = "CASE country " + " ".join(f"WHEN '{c}' THEN '{z}'" for c, z in C.ZONES.items()) + " ELSE 'UTC' END"
_MENU = " + ".join(f"CAST(contains(lower(content), '{w}') AS INT)" for w in C.MENU_WORDS)
_TOPIC = " + ".join(f"CAST(contains(lower(content), '{w}') AS INT)" for w in C.TOPIC_IN_TEXT)
_OWN = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"


def _resolved(text: str) -> str:
    for name, character in _REFERENCES:
        text = f"replace({text}, '{name}', '{character.replace(chr(39), chr(39) * 2)}')"
    return text


_PLANTED = "".join(f"""'<a href="' || {link} || '">x</a>' || """ for link in (
    "'https://other.example.org/story?id=1'", f"{_OWN} || '/en/2024/05/' || page_id", "'/story-of/the-day'", "'https://www.facebook.com/x'", "'https://news.example.org/tag/a'",
    "'mailto:a@b.c'", "'https://other.example.org/story?id=1'", "'/tag/the-day'", "'/'", "'/12345'",
))
#: Pages with what the query plants, and the paragraphs of their articles.
_LINKED_SQL = f"""linked AS (SELECT page_id, url, html, '<html><head><meta name="author" content="Writer ' || page_id || '"></head><body><time datetime="2024-03-01T10:00:00Z"></time>' || {_PLANTED}
      '<img src="/i/1.png"><img data-src="https://cdn.example.org/2.png"><img src="/i/1.png">' || regexp_extract(html, '(?s)<body>(.*)$', 1) AS page FROM pages),
  bodies AS (SELECT *, nullif(array_to_string(list_filter(list_transform(string_split(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p>')[2:],
      lambda b: trim(regexp_replace({_resolved("regexp_replace(replace(regexp_replace(b, '(?s)</p>.*$', ''), '<br>', ' '), '<[^>]*>', '', 'g')")}, '\\s+', ' ', 'g'))), lambda b: b <> ''), chr(10)), '') AS content FROM linked),
  extracted AS (SELECT *, nullif(trim(regexp_replace({_HEAD}, '\\s+', ' ', 'g')), '') AS title, len(regexp_extract_all(page, '<[^>]+>'))::DOUBLE / length(page) AS tags FROM bodies),
  scored AS (SELECT *, CASE WHEN title IS NOT NULL THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN length(content) >= 200 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN length(content) >= 500 THEN 0.15::DOUBLE ELSE 0 END + 0.15::DOUBLE
      + CASE WHEN length(content) > 0 AND tags < 0.03 THEN 0.1::DOUBLE ELSE 0 END + 0.1::DOUBLE AS q FROM extracted)"""
_HTML_LINKS = f"""anchors AS (SELECT page_id, url, unnest(found) AS a, generate_subscripts(found, 1) AS n FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS found FROM pages)),
  page_links AS (SELECT page_id AS id, CAST(n - 1 AS INT) AS position, href, {_OWN} || href AS link, anchor FROM (
    SELECT page_id, url, n, {_resolved("regexp_extract(a, '<a href=\"([^\"]*)\"', 1)")} AS href, trim(regexp_replace({_resolved("regexp_extract(a, '>([^<]*)<', 1)")}, '\\s+', ' ', 'g')) AS anchor FROM anchors))"""

ORACLE_SQL = {
    "f3_url_domain": f"SELECT page_id AS id, {HOST} AS domain FROM pages",
    "f4_preprocess_title": f"{A}SELECT id, {_CLEAN} AS title FROM articles",
    "f5_title_tokens": f"""{A}SELECT id, CASE WHEN id % 3 = 0 OR split_part(lower(language), '-', 1) IN ('zh', 'ja', 'ko') THEN array_to_string(list_transform(range(1, length(title)), lambda i: substr(title, i, 2)), '|')
      ELSE array_to_string(list_filter(regexp_split_to_array(title, '\\s+'), lambda x: x <> ''), '|') END AS tokens FROM articles""",
    "f8_excerpt": A
    + r"""SELECT id, CASE WHEN length(content) <= 300 THEN content WHEN length(regexp_extract(left(content, 300), '(?s)^(.*[。！？.!?])', 1)) > 151
      THEN regexp_extract(left(content, 300), '(?s)^(.*[。！？.!?])', 1) ELSE rtrim(left(content, 300)) || '...' END AS excerpt FROM articles""",
    "f9_quality_score": f"""{A}, scored AS (SELECT id, least(1.0::DOUBLE, CASE WHEN trim(coalesce(title, '')) <> '' THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN length(content) >= 200 THEN 0.25::DOUBLE ELSE 0 END
        + CASE WHEN length(content) >= 500 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN id % 3 <> 0 AND published_at IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END
        + CASE WHEN length(content) > 0 AND len(regexp_extract_all('<p>' || content || '</p>', '<[^>]+>'))::DOUBLE / length('<p>' || content || '</p>') < 0.03 THEN 0.1::DOUBLE ELSE 0 END
        + CASE WHEN id % 2 = 0 THEN 0.1::DOUBLE ELSE 0 END) AS q FROM articles) SELECT id, round(q, 6) AS quality, q >= 0.5 AS success FROM scored""".replace("\n, scored", ", scored"),
    "f10_is_news_article": f"""{A}SELECT id, NOT (id % 10 = 0 OR regexp_matches(lower(CASE WHEN id % 7 = 0 THEN coalesce(title || ' - Sign In', '') ELSE coalesce(title, '') END), '{matching(C.NO_NEWS_TITLE)}')
      OR (content IS NOT NULL AND length(content) > 0 AND (length(content) < 100 OR (({_MENU}) >= 5 AND length(content) < 500)))) AS is_news FROM articles""",
    "f11_is_article_url": rf"""SELECT id, regexp_matches(path, '/\d{{4}}/\d{{2}}/|/\d{{4}}-\d{{2}}-\d{{2}}/|/\d{{4,}}') OR (len(parts) >= 2 AND regexp_matches(parts[-1], '[-_]')) AS is_article
      FROM (SELECT page_id AS id, {PATH} AS path, list_filter(string_split({PATH}, '/'), lambda x: x <> '') AS parts FROM pages)""",
    "f14_topic_score": f"{A}SELECT id, n, n >= 3 AS is_automotive, round(least(0.5::DOUBLE + n * 0.1::DOUBLE, 0.95::DOUBLE), 6) AS confidence FROM (SELECT id, CAST({_TOPIC} AS INT) AS n FROM articles)",
    "f15_analysis_json": f"{A}SELECT id, CASE WHEN id % 4 <> 0 THEN (id % 10) / 10::DOUBLE END AS confidence, CASE WHEN id % 4 <> 0 THEN coalesce(language, '') END AS language FROM articles",
    "f16_three_times": f"""{A}SELECT id, timezone({_ZONES}, published_at) AT TIME ZONE 'UTC' AS utc, (timezone({_ZONES}, published_at) AT TIME ZONE 'UTC') + INTERVAL 8 HOURS AS beijing FROM articles""",
    "f18_cosine": _COSINE.format(cut=""),
    "f18_cosine_of_32_dims": _COSINE.format(cut="[1:32]"),
    "f19_publish_date": f"{A}SELECT id, CASE id % 5 WHEN 4 THEN NULL WHEN 3 THEN date_trunc('day', published_at) ELSE date_trunc('second', published_at) END AS published_at FROM articles",
    "f20_html_text": rf"SELECT page_id AS id, left(trim(regexp_replace({_TEXT}, '\s+', ' ', 'g')), 2000) AS text FROM pages",
    "p1_extract_pages": f"""WITH {_LINKED_SQL} SELECT page_id AS id, title, NULL::VARCHAR AS language, TIMESTAMP '2024-03-01 10:00:00' AS published_at, {_OWN} || '/i/1.png' AS image_url, content,
      CAST(coalesce(length(content), 0) AS INT) AS content_length, 'Writer ' || page_id AS author, round(least(1.0::DOUBLE, q), 6) AS quality, q >= 0.5 AS success, 'https://other.example.org/story?id=1' AS external_links,
      CASE WHEN length(content) <= 300 THEN content WHEN length(regexp_extract(left(content, 300), '(?s)^(.*[。！？.!?])', 1)) > 151
        THEN regexp_extract(left(content, 300), '(?s)^(.*[。！？.!?])', 1) ELSE rtrim(left(content, 300)) || '...' END AS excerpt FROM scored""",
    "p3_html_links": f"WITH {_HTML_LINKS} SELECT * FROM page_links",
    "p3_anchor_texts": f"WITH {_HTML_LINKS} SELECT anchor, count(*) AS links, count(DISTINCT id) AS pages, min(link) AS first_link FROM page_links WHERE anchor <> '' GROUP BY 1",
    "p2_page_images": f"SELECT page_id AS id, {_OWN} || '/i/1.png' AS image_url, 2::INT AS n FROM pages",
    "p3_external_links": f"""WITH {_HTML_LINKS} SELECT page_id AS id, 'https://other.example.org/story?id=1' AS links, CAST(10 + count(l.id) AS INT) AS n_hrefs,
      coalesce(string_agg(href, ' ' ORDER BY position) FILTER (position < 3), '') AS first_own FROM pages LEFT JOIN page_links l ON l.id = page_id GROUP BY 1""",
    "p4_article_links": f"""SELECT page_id AS id, CAST(position AS INT) AS position, {_OWN} || path AS link FROM pages,
      LATERAL (VALUES (0, '/en/2024/05/' || page_id), (1, '/story-of/the-day'), (2, '/12345')) AS v(position, path)""",
    "p7_tier_route": f"""SELECT page_id AS id, CASE WHEN tier2 THEN 'adapter' ELSE 'generic' END AS route, CASE WHEN tier2 THEN 'Title ' || page_id END AS adapter_title
      FROM (SELECT page_id, length({HOST}) % 3 = 1 AND page_id % 4 <> 0 AS tier2 FROM pages)""",
    "p8_feed_link": "SELECT page_id AS id, CASE WHEN page_id % 3 = 0 AND contains(html, '</head>') THEN '/feed/' || page_id || '.xml' END AS feed FROM pages",
    "p9_adapter_quality": """SELECT domain, count(*) FILTER (ok) AS good, count(*) FILTER (ok) >= 2 AS passes FROM (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS domain, page_id % 4 <> 0 AND length(html) % 400 > 200 AS ok,
      row_number() OVER (PARTITION BY regexp_extract(url, '://([^/?#]*)', 1) ORDER BY page_id) AS n FROM pages) WHERE n <= 3 GROUP BY 1""",
    "a6_stored_articles": f"{A}SELECT id, title, CAST(crawled_at AS DATE) AS crawl_date FROM articles WHERE CAST(crawled_at AS DATE) >= DATE '2024-01-03'",
    "a8_pruned_folders": f"{L}SELECT id, source_id, CAST(started_at AS DATE) AS log_date FROM crawl_logs WHERE started_at >= TIMESTAMP '{LATER[:10]} 12:30:00' - INTERVAL 10 DAYS",
    "a7_stored_logs": f"{L}SELECT CAST(started_at AS DATE) AS log_date, count(*) AS logs FROM crawl_logs GROUP BY 1",
    "w2_search_articles": f"""{AS}SELECT a.id, title, s.name AS source_name FROM articles a JOIN sources s ON s.id = a.source_id WHERE a.language = 'en' AND title ILIKE '%the%' AND NOT is_duplicate
      AND CAST(published_at AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-09' ORDER BY published_at DESC NULLS FIRST, a.id DESC LIMIT 25 OFFSET 25""",
    "w2_search_total": f"{AS}SELECT count(*) AS total, count(*) > 60 AS has_more FROM articles a JOIN sources s ON s.id = a.source_id WHERE a.country = 'GB'",
    "j1_source_names": f"{AS}SELECT a.id, s.name AS source_name FROM articles a JOIN sources s ON s.id = a.source_id",
    "t16_translation_backlog": f"{A}SELECT id, CAST(least(length(content), 2000) AS INT) AS chars FROM articles WHERE language IS DISTINCT FROM 'en' OR title IS NULL",
    "g11_facets": f"{A}SELECT DISTINCT language, country FROM articles",
    "u2_ordered_distinct": f"""{A}SELECT id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS words FROM (SELECT id, list_filter(string_split(lower(title), ' '), lambda x: x <> '') AS w FROM articles)""",
    "u3_difference": f"{AS}SELECT DISTINCT source_id FROM articles WHERE source_id NOT IN (SELECT id FROM sources WHERE id % 2 = 0)",
    "x1_micro_batches": f"{L}SELECT id, source_id, status FROM crawl_logs",
    "x5_closed_days": f"""{L}SELECT CAST(started_at AS DATE) AS day, count(*) AS crawls, CAST(sum(articles_new) AS BIGINT) AS new, round(avg(response_time_ms), 4) AS avg_ms FROM crawl_logs
      GROUP BY 1 HAVING CAST(started_at AS DATE) + INTERVAL 1 DAY <= (SELECT max(started_at) - INTERVAL 1 HOUR FROM crawl_logs)""",
    "x5_last_day_counts": f"""{L}, ends AS (SELECT started_at, date_trunc('hour', started_at) + to_hours(k + 1) AS until FROM crawl_logs, range(24) AS r(k))
      SELECT until, count(*) AS articles FROM ends GROUP BY 1 HAVING until <= (SELECT max(started_at) - INTERVAL 1 HOUR FROM crawl_logs)""".replace("\n, ends", ", ends"),
    "x6_on_time": f"""WITH {views.LOGS_SQL}, {views.SOURCES_SQL} SELECT l.id FROM crawl_logs l JOIN sources s ON s.id = l.source_id
      WHERE l.id % 9 = 0 OR l.started_at >= CASE WHEN s.id % 3 <> 0 THEN TIMESTAMP '2024-01-20' - INTERVAL 1 HOUR ELSE TIMESTAMP '{LATER}' - INTERVAL 30 DAYS END""",
}
