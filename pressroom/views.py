"""The driver's tables in the shape of the library's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawled = F.timestamp_add("MINUTE", F.col("page_id").cast("int"), F.lit("2024-01-01").cast("timestamp"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", "html", crawled.alias("crawled_at"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles_of_documents(table(spark, sf_dir, "documents"))


def articles_of_documents(docs: DataFrame) -> DataFrame:
    """Works on streams too."""
    crawled = F.timestamp_add("MINUTE", (F.col("doc_id") * 20).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    country = F.when(F.col("lang") == "en", F.element_at(F.array(F.lit("US"), F.lit("GB"), F.lit("AU")), (F.col("doc_id") % 3 + 1).cast("int")))
    for lang, name in (("fr", "FR"), ("de", "DE"), ("es", "ES")):
        country = country.when(F.col("lang") == lang, name)
    return docs.select(
        F.col("doc_id").alias("id"),
        F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 80).alias("title"),
        F.col("text").alias("content"),
        F.col("lang").alias("language"),
        country.alias("country"),
        F.regexp_extract("source", "[0-9]+", 0).try_cast("long").alias("source_id"),
        crawled.alias("crawled_at"),
        F.timestamp_add("HOUR", (-(F.col("doc_id") % 7)).cast("int"), crawled).alias("published_at"),
        # Chains of up to three duplicates behind an original.
        F.when(F.col("doc_id") % 7 > 3, F.col("doc_id") - 1).alias("duplicate_of"),
        (F.col("doc_id") % 7 > 3).alias("is_duplicate"),
    )


ARTICLES_SQL = """articles AS (
  SELECT doc_id AS id, substr(split_part(text, chr(10), 1), 1, 80) AS title, text AS content, lang AS language,
    CASE lang WHEN 'en' THEN ['US', 'GB', 'AU'][doc_id % 3 + 1] WHEN 'fr' THEN 'FR' WHEN 'de' THEN 'DE' WHEN 'es' THEN 'ES' END AS country,
    TRY_CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS source_id,
    TIMESTAMP '2024-01-01' + to_minutes(doc_id * 20) AS crawled_at,
    TIMESTAMP '2024-01-01' + to_minutes(doc_id * 20) - to_hours(doc_id % 7) AS published_at,
    CASE WHEN doc_id % 7 > 3 THEN doc_id - 1 END AS duplicate_of, doc_id % 7 > 3 AS is_duplicate
  FROM documents)"""


def crawl_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_of_events(table(spark, sf_dir, "events"))


def logs_of_events(events: DataFrame) -> DataFrame:
    """Works on streams too."""
    found = F.coalesce(F.regexp_extract("props", "[0-9]+", 0).try_cast("int"), F.lit(0))
    failed = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("source_id"),
        F.col("ts").cast("timestamp").alias("started_at"),
        F.when(failed, "error").otherwise("success").alias("status"),
        found.alias("articles_found"),
        F.when(failed, 0).otherwise(F.col("event_id") % (found + 1)).cast("int").alias("articles_new"),
        F.floor(F.col("value") * 10).cast("int").alias("response_time_ms"),
    )


LOGS_SQL = """crawl_logs AS (
  SELECT event_id AS id, user_id AS source_id, ts AS started_at,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, found AS articles_found,
    CAST(CASE WHEN event_type = 'error' THEN 0 ELSE event_id % (found + 1) END AS INT) AS articles_new,
    CAST(floor(value * 10) AS INT) AS response_time_ms
  FROM (SELECT *, coalesce(TRY_CAST(regexp_extract(props, '[0-9]+') AS INT), 0) AS found FROM events))"""


#: Words that stand for brands and models in the corpus: kind, canonical name, alias.
DICTIONARY = [
    ("brand", "Attion", "attion"), ("brand", "Thanedble", "thanedble"), ("brand", "Anea", "anea."), ("brand", "Eriner", "eriner"),
    ("brand", "Orre", "orre"), ("model", "Schen", "sch en"), ("model", "Und", "und"), ("model", "Heit", "heit"), ("model", "Tion", "tion"),
    ("model", "Ment", "ment"), ("model", "Cion", "ción"), ("model", "Ed", "edly"), ("model", "Ed", "eded"),
]


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DICTIONARY, "kind string, canonical string, alias string")


DICTIONARY_SQL = "dict(kind, canonical, alias) AS (VALUES " + ", ".join(str(row) for row in DICTIONARY) + ")"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by the users of `events`: one for each, its state made from its id and its logs."""
    logs = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").cast("timestamp").alias("last_crawl_at"), F.count("*").cast("int").alias("crawl_count"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nations = nations.select((F.col("n_nationkey") % 25).alias("_n"), F.col("n_name").alias("country"), F.col("r_name").alias("region"))
    named = logs.withColumn("_n", F.col("id") % 25).join(F.broadcast(nations), "_n")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.col("id") % by + 1).cast("int"))
    return named.select(
        "id",
        F.concat(F.lit("https://site"), "id", F.lit(".example.com")).alias("url"),
        F.concat(F.lit("Site "), "id").alias("name"),
        F.concat(F.lit("site"), "id", F.lit(".example.com")).alias("domain"),
        F.when(F.col("id") % 11 != 0, F.col("country")).alias("country"),
        pick(["en", "fr", "de", "es"], 4).alias("language"),
        "region",
        (F.col("id") % 3 + 1).cast("int").alias("tier"),
        pick(["high", "medium", "low"], 3).alias("priority"),
        pick(["active", "active", "active", "degraded", "active", "paused", "active", "archived"], 8).alias("status"),
        F.lit(240).alias("crawl_interval_minutes"),
        "last_crawl_at",
        F.timestamp_add("HOUR", (F.col("id") % 48).cast("int"), F.col("last_crawl_at")).alias("next_crawl_at"),
        "crawl_count",
        (F.col("id") % 17).cast("int").alias("consecutive_errors"),
        F.when(F.col("id") % 5 == 0, "extract_empty").when(F.col("id") % 5 == 1, "timeout").alias("last_error_type"),
        (F.col("id") % 120).cast("int").alias("days_without_new"),
    )


SOURCES_SQL = """sources AS (
  SELECT id, 'https://site' || id || '.example.com' AS url, 'Site ' || id AS name, 'site' || id || '.example.com' AS domain,
    CASE WHEN id % 11 <> 0 THEN n_name END AS country, ['en', 'fr', 'de', 'es'][id % 4 + 1] AS language, r_name AS region,
    CAST(id % 3 + 1 AS INT) AS tier, ['high', 'medium', 'low'][id % 3 + 1] AS priority,
    ['active', 'active', 'active', 'degraded', 'active', 'paused', 'active', 'archived'][id % 8 + 1] AS status,
    240 AS crawl_interval_minutes, last_crawl_at, last_crawl_at + to_hours(id % 48) AS next_crawl_at, crawl_count,
    CAST(id % 17 AS INT) AS consecutive_errors,
    CASE id % 5 WHEN 0 THEN 'extract_empty' WHEN 1 THEN 'timeout' END AS last_error_type, CAST(id % 120 AS INT) AS days_without_new
  FROM (SELECT user_id AS id, max(ts) AS last_crawl_at, CAST(count(*) AS INT) AS crawl_count FROM events GROUP BY 1)
  JOIN nation ON id % 25 = n_nationkey % 25 JOIN region ON n_regionkey = r_regionkey)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outbound links of articles: three page addresses for each, by a fixed rule."""
    link = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "/(en|fr|de|es)/", "/news/")).otherwise(F.col("url"))
    found = table(spark, sf_dir, "pages").select("page_id", link.alias("link"))
    n = found.count()
    step = F.explode(F.array(*[((F.col("id") * 7 + j * 13) % n).alias("_") for j in range(3)])).alias("page_id")
    given = articles(spark, sf_dir).select("id", "title", "crawled_at", step)
    return given.join(found, "page_id").select(F.col("id").alias("article_id"), F.col("title").alias("article_title"), "crawled_at", F.col("link").alias("url"))


LINKS_SQL = """links AS (
  SELECT id AS article_id, title AS article_title, crawled_at, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '/(en|fr|de|es)/', '/news/', 'g') ELSE url END AS url
  FROM articles CROSS JOIN (VALUES (0), (1), (2)) AS j(j) JOIN pages ON page_id = (id * 7 + j * 13) % (SELECT count(*) FROM pages))"""
