"""What the registered queries share: the moment they look from, and the views in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressroom import views

NOW = "2024-01-08 00:00:00"
#: The moment from which sources are looked at: within their logs.
LATER = "2024-01-31 00:00:00"
A, L, S = (f"WITH {sql}\n" for sql in (views.ARTICLES_SQL, views.LOGS_SQL, views.SOURCES_SQL))
AS = f"WITH {views.ARTICLES_SQL}, {views.SOURCES_SQL}\n"
LS = f"WITH {views.LOGS_SQL}, {views.SOURCES_SQL}\n"
LINKS = f"WITH {views.ARTICLES_SQL}, {views.SOURCES_SQL}, {views.LINKS_SQL}\n"


def now(at: str = NOW) -> Column:
    return F.lit(at).cast("timestamp")


def of_articles(job):
    return lambda spark, d: job(views.articles(spark, d))


def of_logs(job):
    return lambda spark, d: job(views.crawl_logs(spark, d))


def of_sources(job):
    return lambda spark, d: job(views.sources(spark, d))


def of_pages(job):
    return lambda spark, d: job(views.pages(spark, d))


def matching(parts) -> str:
    """An SQL pattern for any of the parts as they are."""
    return "|".join("".join(f"\\{c}" if not c.isalnum() and c not in "/-_ " else c for c in part) for part in parts)


HOST = r"nullif(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', ''), ':\d+$', ''), '')"
PATH = r"regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
