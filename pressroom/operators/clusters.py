"""Events: articles and their duplicates as clusters, their statistics and titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressroom.functions.text import importance_score
from pressroom.ordered import running
from pressroom.lineage import cut


def assign_clusters(articles: DataFrame) -> DataFrame:
    """id, cluster: the id of the original at the end of each chain of duplicates; articles: id, duplicate_of.

    Pointers are doubled: every round halves what is left of the chains. An original that is not among the articles
    counts as none.
    """
    known = articles.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    links = articles.select("id", F.col("duplicate_of").alias("parent")).join(known, "parent", "left")
    links = cut(links.select("id", F.when(F.col("there"), F.col("parent")).otherwise(F.col("id")).alias("parent")))
    while True:
        up = links.toDF("parent", "above").where("parent <> above")
        moved = links.join(up, "parent", "left").select("id", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved"))
        moved = cut(moved)
        links = moved.select("id", "parent")
        if moved.where("moved").isEmpty():
            return links.select("id", F.col("parent").alias("cluster"))


def cluster_stats(articles: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Per cluster: counts, sorted distinct non-empty languages and countries, first and last time, representative, score."""
    distinct = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit(""))))
    stats = articles.groupBy(cluster).agg(
        F.count("*").alias("article_count"),
        distinct("language").alias("languages"),
        distinct("country").alias("countries"),
        F.min("crawled_at").alias("first_seen_at"),
        F.max("crawled_at").alias("last_updated_at"),
        F.min_by("id", F.struct("crawled_at", "id")).alias("representative_id"),
    )
    stats = stats.withColumns({"language_count": F.size("languages").cast("long"), "country_count": F.size("countries").cast("long")})
    return stats.withColumn("importance_score", importance_score(F.col("article_count"), F.col("language_count"), F.col("country_count")))


def key_entities(articles: DataFrame, most: int = 5) -> DataFrame:
    """cluster, key_entities: the names that most of its articles share, the first by name among equals; articles: cluster, entities array."""
    counts = articles.select("cluster", F.explode("entities").alias("name")).groupBy("cluster", "name").count()
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("count"), "name"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= most).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("t"))
    return top.select("cluster", F.transform("t", lambda s: s["name"]).alias("key_entities"))


def display_titles(articles: DataFrame) -> DataFrame:
    """cluster, title: of its first article that is no duplicate, Chinese before English before the original."""
    title = F.coalesce("title_zh", "title_en", "title")
    first = articles.where("NOT is_duplicate").withColumn("_title", title)
    return first.groupBy("cluster").agg(F.min_by("_title", F.struct("crawled_at", "id")).alias("title"))


def mark_cluster_duplicates(articles: DataFrame) -> DataFrame:
    """id, cluster, is_duplicate: every article but the lowest id of its cluster."""
    least = articles.groupBy("cluster").agg(F.min("id").alias("least"))
    return articles.join(least, "cluster").select("id", "cluster", (F.col("id") > F.col("least")).alias("is_duplicate"))


def top_events(stats: DataFrame, n: int = 10, page: int = 1) -> DataFrame:
    """A page of clusters by score."""
    return stats.orderBy(F.desc("importance_score"), "cluster").offset((page - 1) * n).limit(n)


def with_representatives(stats: DataFrame, articles: DataFrame) -> DataFrame:
    """The clusters with title and url of their representative, empty where it is missing."""
    shown = articles.select(F.col("id").alias("representative_id"), F.col("title").alias("_title"))
    return stats.join(shown, "representative_id", "left").withColumn("title", F.coalesce("_title", F.lit(""))).drop("_title")


def cluster_articles(articles: DataFrame, k: int = 50) -> DataFrame:
    """The latest k articles of every cluster, by crawled_at, with their rank; ranked in parts before they are by cluster."""
    rank = lambda *by: F.row_number().over(Window.partitionBy("cluster", *by).orderBy(F.col("crawled_at").desc_nulls_first(), F.desc("id")))
    few = articles.withColumn("rank", rank(F.pmod(F.xxhash64("id"), F.lit(64)))).where(F.col("rank") <= k)
    return few.withColumn("rank", rank()).where(F.col("rank") <= k)


def timeline(articles: DataFrame) -> DataFrame:
    """cluster, id, at, rank: the articles of every cluster by publication (or else crawl), latest first, undated ones before them.

    Ranks are running counts over ranges, so an event of very many articles is many tasks' work.
    """
    at = F.coalesce("published_at", "crawled_at")
    rows = articles.select("cluster", "id", at.alias("at"), F.coalesce(-F.unix_micros(at), F.lit(-(2**62))).alias("back"), (-F.col("id")).alias("down"))
    placed = running(rows, ["cluster", "back", "down"], row=F.lit(1))
    first = placed.groupBy("cluster").agg(F.min("row").alias("first"))
    return placed.join(first, "cluster").select("cluster", "id", "at", (F.col("row") - F.col("first") + 1).cast("int").alias("rank"))
