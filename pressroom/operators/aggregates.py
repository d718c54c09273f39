"""Reports over articles, crawl logs and sources: each is one or two shuffles with partial aggregation before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_values(articles: DataFrame, column: str, k: int = 10) -> DataFrame:
    return articles.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(k)


def source_totals(articles: DataFrame, sources: DataFrame, now) -> DataFrame:
    """source_id, total (articles that are no duplicates), last_24h (all): of every source, 0 where it has none."""
    recent = F.col("crawled_at") >= now - F.expr("INTERVAL 24 HOURS")
    counts = articles.groupBy("source_id").agg(F.count_if(~F.col("is_duplicate")).alias("total"), F.count_if(recent).alias("last_24h"))
    return sources.select(F.col("id").alias("source_id")).join(counts, "source_id", "left").fillna(0, ["total", "last_24h"])


def daily_crawl_report(logs: DataFrame) -> DataFrame:
    return logs.groupBy(F.to_date("started_at").alias("day")).agg(
        F.count("*").alias("crawls"), F.sum("articles_new").alias("new"), F.round(F.avg("response_time_ms"), 4).alias("avg_ms")
    )


def recent_logs(logs: DataFrame, k: int = 10) -> DataFrame:
    """The latest k logs of each source; Spark limits each task to k rows a source before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("started_at"), F.desc("id")))
    return logs.withColumn("rank", rank).where(F.col("rank") <= k)


def success_rate(logs: DataFrame, sources: DataFrame, k: int = 10) -> DataFrame:
    """source_id, success_rate in percent over the latest k logs; 0 for sources without logs."""
    good = F.avg((F.col("status") == "success").cast("double"))
    rates = recent_logs(logs, k).groupBy("source_id").agg(F.round(good * 100, 2).alias("success_rate"))
    return sources.select(F.col("id").alias("source_id")).join(rates, "source_id", "left").fillna(0.0, ["success_rate"])


def publish_profile(articles: DataFrame, now, days: int = 30) -> DataFrame:
    """Per source, over its dated articles of the last `days` that are no duplicates: counts by hour (24) and weekday (7, Monday first), the three
    busiest of each (the lower among equals), weekend to weekday ratio, raw and per day, total, and articles a day."""
    hour, day = F.hour("published_at"), F.weekday("published_at")
    counted = articles.where((F.col("published_at") >= now - F.expr(f"INTERVAL {days} DAYS")) & (F.col("published_at") <= now) & ~F.col("is_duplicate"))
    out = counted.groupBy("source_id").agg(
        F.array(*(F.count_if(hour == h) for h in range(24))).alias("hours"), F.array(*(F.count_if(day == d) for d in range(7))).alias("weekdays"), F.count("*").alias("total")
    )
    busiest = lambda c: F.transform(
        F.slice(F.array_sort(F.transform(c, lambda n, k: F.struct((-n).alias("n"), k.alias("k")))), 1, 3), lambda s: s["k"]
    )
    weekend = F.get("weekdays", 5) + F.get("weekdays", 6)
    weekday = F.col("total") - weekend
    return out.withColumns(
        {
            "top_hours": busiest("hours"),
            "top_weekdays": busiest("weekdays"),
            "weekend_ratio": F.when(weekday > 0, weekend / weekday).otherwise(0.0),
            "weekend_ratio_per_day": F.when(weekday > 0, weekend / (weekday * 2 / 5)).otherwise(0.0),
            "avg_articles_per_day": F.col("total") / days,
        }
    )


def profile_maps(profile: DataFrame) -> DataFrame:
    """source_id, publish_hours, publish_weekdays: the counts of a profile as maps, without zeros."""
    as_map = lambda c: F.map_from_entries(F.filter(F.transform(c, lambda n, k: F.struct(k.alias("k"), n.alias("n"))), lambda s: s["n"] > 0))
    return profile.select("source_id", as_map("hours").alias("publish_hours"), as_map("weekdays").alias("publish_weekdays"))
