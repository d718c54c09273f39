"""Expressions over fetched articles: quality, kind of page, times, text of a page."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressroom import constants as C
from pressroom.functions.links import any_part

#: Score from which an extraction counts as a success.
SUCCESS = 0.5
_DATES = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ssXXX",
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy",
    "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "yyyyMMdd",
)


TAG = "<[^>]+>"


def tag_share(html: Column) -> Column:
    """Tags for each character of a page; null for an empty one."""
    return F.try_divide(F.regexp_count(html, F.lit(TAG)), F.length(html))


def quality_score(title: Column, content: Column, published_at: Column, tags: Column, has_image: Column) -> Column:
    """0 to 1: title, length of the body, date, few tags in the page (tag_share), an image; added up in this order."""
    length = F.coalesce(F.length(content), F.lit(0))
    few_tags = (length > 0) & (tags < 0.03)
    parts = [
        (F.trim(F.coalesce(title, F.lit(""))) != "", 0.25),
        (length >= 200, 0.25),
        (length >= 500, 0.15),
        (published_at.isNotNull(), 0.15),
        (few_tags, 0.1),
        (has_image, 0.1),
    ]
    points = [F.when(holds, value).otherwise(0.0) for holds, value in parts]
    return F.least(reduce(lambda a, b: a + b, points), F.lit(1.0))


def is_news_article(url: Column, title: Column, content: Column) -> Column:
    """False for pages by their path, title, or a body that is short or a menu; null titles and bodies skip their rule."""
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    no_path = path.rlike("(?:" + "|".join(map(re.escape, C.NO_NEWS_PATH)) + ")/?$")
    no_title = any_part(F.lower(title), C.NO_NEWS_TITLE)
    low, length = F.lower(content), F.length(content)
    menu = reduce(lambda a, b: a + b, [low.contains(word).cast("int") for word in C.MENU_WORDS])
    no_content = (length > 0) & ((length < 100) | ((menu >= 5) & (length < 500)))
    no = F.lit(False)
    return ~(no_path | F.coalesce(no_title, no) | F.coalesce(no_content, no))


def zone_of(country: Column, zone: Column | None = None) -> Column:
    """The given time zone, else the country's, else UTC."""
    zones = F.create_map(*(F.lit(x) for pair in C.ZONES.items() for x in pair))
    of_country = F.try_element_at(zones, F.coalesce(country, F.lit("")))
    return F.coalesce(*([] if zone is None else [zone]), of_country, F.lit("UTC"))


def utc_of(wall_clock: Column, zone: Column) -> Column:
    """The instant of a zone's wall clock: of the two that an hour put back has, the later one; a time that an hour put forward leaves out is read by the offset before."""
    early, day = F.to_utc_timestamp(wall_clock, zone), F.expr("INTERVAL 24 HOURS")
    # By the offset of a day later, which is that after the change. Clocks are put back by a day at most.
    after = early + day
    late = wall_clock - (F.from_utc_timestamp(after, zone) - after)
    return F.when(F.from_utc_timestamp(late, zone) == wall_clock, F.greatest(early, late)).otherwise(early)


def three_times(wall_clock: Column, country: Column, zone: Column | None = None) -> Column:
    """struct local (as given), utc (instant), beijing (wall clock, 8 hours ahead of UTC) of a time without zone; a wall clock that is shown twice stands for its second time."""
    utc = utc_of(wall_clock.cast("timestamp"), zone_of(country, zone))
    beijing = (utc + F.expr("INTERVAL 8 HOURS")).cast("timestamp_ntz")
    return F.struct(wall_clock.cast("timestamp_ntz").alias("local"), utc.alias("utc"), beijing.alias("beijing"))


def parse_publish_date(text: Column) -> Column:
    """A timestamp in any of the usual formats, UTC where no zone is named; else null."""
    plain = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(*(F.try_to_timestamp(plain, F.lit(f)) for f in _DATES))


def classify_crawl_error(error: Column, found: Column) -> Column:
    """http_error, timeout, extract_empty (fetched, nothing found), unknown; null where nothing is wrong."""
    return (
        F.when(error.startswith("http_"), "http_error")
        .when(error == "timeout", "timeout")
        .when(error.isNotNull(), "unknown")
        .when(F.coalesce(found, F.lit(0)) == 0, "extract_empty")
    )


def truncate_dims(vector: Column, k: int = 256) -> Column:
    """The first k dimensions."""
    return F.slice(vector, 1, k)
