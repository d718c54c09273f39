"""Rules about domains, links and site addresses; all built-in expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressroom import constants as C


def any_part(text: Column, parts) -> Column:
    """Whether the text holds one of the parts."""
    return text.rlike("|".join(map(re.escape, parts)))


def is_listed(domain: Column, listed) -> Column:
    """Whether the domain or one above it is listed."""
    return domain.rlike(r"(?:^|\.)(?:" + "|".join(map(re.escape, listed)) + ")$")


def is_blacklisted(domain: Column, listed=C.MINED_BLACKLIST, known=C.KNOWN_SITES) -> Column:
    """Listed itself, or below a listed domain and no known site."""
    return domain.isin(*listed) | (~domain.isin(*known) & is_listed(domain, listed))


def has_topic_keyword(url: Column) -> Column:
    return any_part(F.lower(url), C.TOPIC_IN_URL)


def keyword_topic_score(text: Column) -> Column:
    """struct n, is_automotive, confidence from how many of the topic's words the text holds."""
    low = F.lower(text)
    n = reduce(lambda a, b: a + b, [low.contains(word).cast("int") for word in C.TOPIC_IN_TEXT])
    return F.struct(n.alias("n"), (n >= 3).alias("is_automotive"), F.least(0.5 + n * 0.1, F.lit(0.95)).alias("confidence"))


ANALYSIS = (
    "is_automotive boolean, confidence double, language string, country string, update_frequency string, content_type string, "
    "uniqueness_score double, reason string"
)


def parse_analysis_json(text: Column) -> Column:
    """What stands between the first { and the last }, as a struct; null where that is no JSON."""
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(inner != "", F.from_json(inner, ANALYSIS))


def _first(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    return reduce(lambda out, case: out.when(*case), cases[1:], F.when(*cases[0])).otherwise(otherwise)


def site_country(domain: Column, url: Column) -> Column:
    ends = [(domain.endswith(f".{end}"), country) for end, country in C.COUNTRY_BY_SUFFIX.items()]
    return _first(ends + [(F.lower(url).contains(f"/{part}/"), country) for part, country in C.COUNTRY_BY_PATH.items()], "US")


def site_language(domain: Column, url: Column) -> Column:
    low = [F.lower(domain), F.lower(url)]
    parts = [(low[0].contains(part) | low[1].contains(part), language) for part, language in C.LANGUAGE_BY_PART.items()]
    return _first(parts + [(low[1].contains(f"/{language}/"), language) for language in C.LANGUAGE_BY_PATH], "en")


def site_region(country: Column) -> Column:
    return _first([(country.isin(*countries), region) for region, countries in C.REGIONS.items()], "Other")


def site_name(domain: Column) -> Column:
    parts = F.split(F.regexp_replace(domain, r"^www\.", ""), r"\.")
    name = F.when(F.size(parts) > 3, F.try_element_at(parts, F.lit(-2))).otherwise(F.get(parts, 0))
    return F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 1_000_000)))


def is_auto_site(domain: Column, url: Column) -> Column:
    return any_part(F.lower(F.concat_ws(" ", domain, url)), C.TOPIC_IN_SITE)


def feed_link(html: Column) -> Column:
    """The first advertised feed, by four orders of attributes; null where there is none."""
    value = """["']([^"']+)["']"""
    rel, kind, href = """rel=["']alternate["']""", """type=["']application/rss\\+xml["']""", f"href={value}"
    orders = ((rel, kind, href), (kind, rel, href), (href, kind), (href, rel, kind))
    found = [F.regexp_extract(html, "(?i)<link[^>]+" + "[^>]+".join(order), 1) for order in orders]
    return F.coalesce(*(F.nullif(f, F.lit("")) for f in found))
