"""Site lists, feeds, and the tables that are appended to."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from pressroom.functions.articles import parse_publish_date
from pressroom.lineage import cut, drop
from pressroom.operators.discovery import sites_of_lines

MOST_ITEMS = 50


def read_site_list(spark: SparkSession, path: str) -> DataFrame:
    """Sites of text files, one a line; the first line of a domain counts, files in order of their names."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_n"))
    # Within a partition ids grow with the lines; blocks of a file are told apart by where they start.
    position = F.struct("file_path", "file_block_start", "_n")
    return sites_of_lines(lines.select(position.alias("position"), F.col("value").alias("line")))


def _element(**fields: DataType) -> StructType:
    return StructType([StructField(name.replace("__", ":"), kind) for name, kind in fields.items()])


_S = StringType()
_ITEM = _element(title=_S, link=ArrayType(_S), pubDate=_S, published=_S, updated=_S, dc__date=_S, dc__creator=ArrayType(_S), author=_S, summary=_S, description=_S)
_ENTRY = _element(title=_S, link=ArrayType(_element(_href=_S, _rel=_S)), published=_S, updated=_S, author=ArrayType(_element(name=_S)), summary=_S)
#: RSS (items below the channel, or beside it in its first versions) and Atom.
_FEED = _element(channel=_element(item=ArrayType(_ITEM)), item=ArrayType(_ITEM), entry=ArrayType(_ENTRY))


def _first(*texts: Column) -> Column:
    """The first of the texts that says something, without white space around it."""
    return F.coalesce(*(F.nullif(F.trim(t), F.lit("")) for t in texts))


def _found(title: Column, link: Column, date: Column, author: Column, summary: Column) -> Column:
    return F.struct(title.alias("title"), link.alias("url"), date.alias("date"), author.alias("author"), summary.alias("summary"))


def _items(xml: Column) -> Column:
    """The entries of a well-formed document; null for any other. Elements of other name spaces, CDATA and character references are the parser's."""
    parsed = F.from_xml(xml, _FEED, {"mode": "PERMISSIVE"})
    some = lambda array: F.get(F.filter(array, lambda x: F.trim(x) != ""), 0)

    def item(i: Column) -> Column:
        return _found(_first(i["title"]), _first(some(i["link"])), _first(i["pubDate"], i["published"], i["updated"], i["dc:date"]), _first(some(i["dc:creator"]), i["author"]), _first(i["summary"], i["description"]))

    def entry(e: Column) -> Column:
        page = F.get(F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), 0)["_href"]
        return _found(_first(e["title"]), _first(page, F.get(e["link"], 0)["_href"]), _first(e["published"], e["updated"]), _first(F.get(e["author"], 0)["name"]), _first(e["summary"]))

    return F.coalesce(F.transform(parsed["channel"]["item"], item), F.transform(parsed["item"], item), F.transform(parsed["entry"], entry))


def _inner(item: Column, *names: str) -> Column:
    """The text of the first of the elements that an item holds, without CDATA marks; null where there is none."""
    found = [F.regexp_extract(item, rf"(?s)<{name}\b[^>]*>(.*?)</{name}\s*>", 1) for name in names]
    return _first(*(F.regexp_replace(f, r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", "$1") for f in found))


def unescaped(text: Column) -> Column:
    for name, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(character))
    return text


def _pieces(xml: Column) -> Column:
    """What looks like entries in a document that is not well-formed."""

    def item(i: Column) -> Column:
        link = F.coalesce(_inner(i, "link"), F.nullif(F.regexp_extract(i, r"""<link\b[^>]*href=["']([^"']*)["']""", 1), F.lit("")))
        author = F.coalesce(_inner(i, "dc:creator"), _inner(F.coalesce(_inner(i, "author"), F.lit("")), "name"), _inner(i, "author"))
        return _found(unescaped(_inner(i, "title")), unescaped(link), _inner(i, "pubDate", "published", "updated", "dc:date"), author, unescaped(_inner(i, "summary", "description")))

    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<(?:item|entry)\b[^>]*>.*?</(?:item|entry)\s*>"), 0), item)


def read_feed(feeds: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """source_id, position, title, url, published_at, author, summary of RSS and Atom documents (source_id, xml).

    The first `most` entries of a document, the newest first, undated ones last; position is their place in that order. Documents are parsed as XML; those that
    are not well-formed are read by the marks of their entries. Documents without entries give no rows.
    """
    found = feeds.select("source_id", "xml", _items(F.col("xml")).alias("_parsed"))
    items = F.when(F.col("_parsed").isNotNull(), F.col("_parsed")).otherwise(_pieces(F.col("xml")))
    item = found.select("source_id", F.posexplode(F.slice(items, 1, most)).alias("_at", "_item"))
    rows = item.select(
        "source_id",
        "_at",
        F.coalesce("_item.title", F.lit("Untitled")).alias("title"),
        F.coalesce("_item.url", F.lit("")).alias("url"),
        parse_publish_date(F.col("_item.date")).alias("published_at"),
        "_item.author",
        "_item.summary",
    )
    order = Window.partitionBy("source_id").orderBy(F.desc_nulls_last("published_at"), "_at")
    return rows.select("source_id", F.row_number().over(order).alias("position"), "title", "url", "published_at", "author", "summary")


def write_articles(articles: DataFrame, path: str, mode: str = "append") -> None:
    """One folder a day of crawl; a day's rows are dealt over several files, so a busy day is no single task."""
    dated = articles.withColumn("crawl_date", F.to_date("crawled_at"))
    dated.repartition("crawl_date", F.pmod(F.hash("id"), F.lit(8))).write.partitionBy("crawl_date").mode(mode).parquet(path)


def read_articles(spark: SparkSession, path: str, first_day: str | None = None) -> DataFrame:
    """The stored articles, from `first_day` on: earlier folders are not read."""
    rows = spark.read.parquet(path)
    return rows if first_day is None else rows.where(F.col("crawl_date") >= F.lit(first_day).cast("date"))


def append_crawl_logs(logs: DataFrame, path: str) -> None:
    """Append logs, one folder a day; a day's rows are dealt over several files."""
    dated = logs.withColumn("log_date", F.to_date("started_at"))
    dated.repartition("log_date", F.pmod(F.hash("id"), F.lit(8))).write.partitionBy("log_date").mode("append").parquet(path)


def prune_logs(logs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """The logs of the last `days`."""
    return logs.where(F.col("started_at") >= now - F.expr(f"INTERVAL {days} DAYS"))


def prune_stored_logs(spark: SparkSession, path: str, now: datetime, days: int = 30) -> int:
    """Delete from the logs below path those older than `days`; the number of day folders removed whole.

    Folders of days before the limit are removed without being read, and the limit's own day is written anew without its earlier hours; later
    days are not touched. Repeating it changes nothing, so it may be run again after a failure. now: UTC, as the session's time zone.
    """
    limit = now - timedelta(days=days)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    named = [(str(f.getPath().getName()), f.getPath()) for f in files.listStatus(root)] if files.exists(root) else []
    dated = [(name.removeprefix("log_date="), place) for name, place in named if re.fullmatch(r"log_date=\d{4}-\d{2}-\d{2}", name)]
    old = [place for day, place in dated if day < f"{limit:%Y-%m-%d}"]
    for place in old:
        files.delete(place, True)
    if f"{limit:%Y-%m-%d}" in [day for day, _ in dated]:
        logs = spark.read.parquet(path)
        day = logs.where(F.col("log_date") == F.lit(limit.date()))
        kept = cut(day.where(F.col("started_at") >= F.lit(limit)))
        if kept.isEmpty():
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/log_date={limit:%Y-%m-%d}"), True)
        # The day's folder alone is replaced, when all of it is written.
        kept.write.partitionBy("log_date").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
        drop(kept)
    return len(old)
