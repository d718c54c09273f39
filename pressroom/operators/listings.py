"""Filtered, sorted and paged lists, and counts over sources and articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_ROWS = 100
STATUSES = ("active", "degraded", "paused", "archived", "pending")
PRIORITIES = ("high", "medium", "low")
SORTABLE = ("id", "name", "country", "status", "last_crawl_at", "crawl_count")


def with_source_name(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles of known sources, with source_name."""
    return articles.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id")


def search_articles(
    articles: DataFrame,
    sources: DataFrame,
    *,
    language: str | None = None,
    country: str | None = None,
    source_id: int | None = None,
    is_duplicate: bool | None = False,
    title: str | None = None,
    first_day: str | None = None,
    last_day: str | None = None,
    sort: str = "crawled_at",
    page: int = 1,
    size: int = 20,
) -> tuple[DataFrame, DataFrame]:
    """A page of the articles that meet all filters, latest first (unknown dates before all), with source_name; and total, has_more."""
    found = articles
    for name, value in (("language", language), ("country", country), ("source_id", source_id), ("is_duplicate", is_duplicate)):
        if value is not None:
            found = found.where(F.col(name) == value)
    if title is not None:
        found = found.where(F.col("title").ilike(f"%{title}%"))
    day = F.to_date("published_at")
    if first_day is not None:
        found = found.where(day >= F.lit(first_day).cast("date"))
    if last_day is not None:
        found = found.where(day <= F.lit(last_day).cast("date"))
    found = with_source_name(found, sources)
    size = min(size, MOST_ROWS)
    order = F.col(sort if sort in ("crawled_at", "published_at") else "crawled_at")
    rows = found.orderBy(order.desc_nulls_first(), F.desc("id")).offset((page - 1) * size).limit(size)
    return rows, found.agg(F.count("*").alias("total")).withColumn("has_more", F.col("total") > page * size)


def list_sources(sources: DataFrame, *, country=None, language=None, status=None, sort_by: str = "id", descending: bool = False, page: int = 1, size: int = 50) -> DataFrame:
    """A page of the sources that meet all filters; unknown sort columns mean id."""
    for name, value in (("country", country), ("language", language), ("status", status)):
        if value is not None:
            sources = sources.where(F.col(name) == value)
    order = F.col(sort_by if sort_by in SORTABLE else "id")
    order = order.desc_nulls_first() if descending else order.asc_nulls_last()
    size = min(size, MOST_ROWS)
    return sources.orderBy(order, "id").offset((page - 1) * size).limit(size)


def patch_sources(sources: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sources with valid patches (id, status, priority, tier, crawl_interval_minutes; null: unchanged) applied, and the rejects.

    A patch with a value outside its enumeration, an interval below 1 or an unknown id is rejected whole. Ids are patched once.
    """
    ok = lambda c, rule: F.col(c).isNull() | rule
    valid = (
        ok("status", F.col("status").isin(*STATUSES))
        & ok("priority", F.col("priority").isin(*PRIORITIES))
        & ok("tier", F.col("tier").isin(1, 2, 3))
        & ok("crawl_interval_minutes", F.col("crawl_interval_minutes") >= 1)
    )
    known = patches.join(sources.select("id", F.lit(True).alias("known")), "id", "left").withColumn("valid", valid & F.coalesce("known", F.lit(False)))
    changed = ["status", "priority", "tier", "crawl_interval_minutes"]
    good = known.where("valid").select("id", *(F.col(c).alias(f"_{c}") for c in changed))
    out = sources.join(good, "id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in changed}).select(sources.columns)
    return out, known.where("NOT valid").select(patches.columns)


def incremental_filter(items: DataFrame, sources: DataFrame, now: Column, most: int | None = 30) -> DataFrame:
    """Feed items newer than an hour before their source's last crawl (30 days on its first), or undated; the first `most` of each source.

    items: source_id, position, published_at, ...
    """
    after = F.coalesce(F.col("last_crawl_at") - F.expr("INTERVAL 1 HOUR"), now - F.expr("INTERVAL 30 DAYS"))
    known = sources.select(F.col("id").alias("source_id"), after.alias("_after"))
    new = items.join(known, "source_id").where(F.col("published_at").isNull() | (F.col("published_at") >= F.col("_after"))).drop("_after")
    if most is None:
        return new
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy("position"))
    return new.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def system_stats(sources: DataFrame, articles: DataFrame, now: Column) -> DataFrame:
    """One row: sources by state, articles in all and of the last 24 hours."""
    recent = F.col("crawled_at") >= now - F.expr("INTERVAL 24 HOURS")
    of_sources = sources.agg(F.count("*").alias("sources"), *(F.count_if(F.col("status") == s).alias(s) for s in ("active", "degraded", "paused")))
    of_articles = articles.agg(
        F.count("*").alias("articles"),
        F.count_if(recent).alias("last_24h"),
        F.count_if(recent & F.col("is_duplicate")).alias("duplicates_24h"),
        F.count_if(recent & ~F.col("is_duplicate")).alias("uniques_24h"),
    )
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(of_sources).join(one(of_articles), "_one").drop("_one")


def health_stats(sources: DataFrame) -> DataFrame:
    """One row: total, sources of each status, needs_repair."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return sources.agg(F.count("*").alias("total"), *counts, F.count_if(_broken()).alias("needs_repair"))


def health_matrix(sources: DataFrame) -> DataFrame:
    """country (Unknown where null), total and sources of each status."""
    return sources.groupBy(F.coalesce("country", F.lit("Unknown")).alias("country")).agg(
        F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES)
    )


def _broken() -> Column:
    return F.coalesce((F.col("last_error_type") == "extract_empty") & F.col("status").isin("active", "degraded"), F.lit(False))


def needs_repair(sources: DataFrame) -> DataFrame:
    """Sources whose pages are fetched but yield nothing, most errors first."""
    return sources.where(_broken()).orderBy(F.desc("consecutive_errors"), "id")


def due_sources(sources: DataFrame, now: Column, most: int = 20) -> DataFrame:
    """The sources to crawl next: by priority, then by how long they are due."""
    rank = F.when(F.col("priority") == "high", 1).when(F.col("priority") == "medium", 2).otherwise(3)
    due = sources.where(F.col("status").isin("active", "degraded") & (F.col("next_crawl_at") <= now))
    return due.orderBy(rank, "next_crawl_at", "id").limit(most)


def translation_backlog(articles: DataFrame, language: str) -> DataFrame:
    """Articles without a title in `language` (zh or en), with what is to be translated."""
    if language not in ("zh", "en"):
        raise ValueError("zh or en")
    return articles.where(F.col(f"title_{language}").isNull()).select("id", "title", F.substring("content", 1, 2000).alias("content"))
