"""URL normalisation and fingerprints."""

from __future__ import annotations

from urllib.parse import parse_qs, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of query parameters that only track visitors.
TRACKING = {
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source",
    "campaign", "medium", "mc_cid", "mc_eid",
}


def normalized(url: str) -> str:
    try:
        parts = urlsplit(url)
        query = {k: v for k, v in parse_qs(parts.query).items() if k.lower() not in TRACKING}
    except ValueError:
        return url
    # Parameters of the path's last segment are no part of it when a closing slash is looked for.
    segment = parts.path.rfind("/") + 1
    at = parts.path.find(";", segment)
    path, rest = (parts.path, "") if at < 0 else (parts.path[:at], parts.path[at:])
    if path.endswith("/") and path != "/":
        path = path[:-1]
    path += rest if len(rest) > 1 else ""
    return urlunsplit((parts.scheme.lower(), parts.netloc.lower().removeprefix("www."), path, urlencode(query, doseq=True), ""))


@F.pandas_udf(T.StringType())
def _normalize_odd(urls: pd.Series) -> pd.Series:
    return urls.map(normalized, na_action="ignore")


_word = "[A-Za-z0-9._~-]*"
_pair = f"{_word}(?:={_word})?"
#: Addresses whose parts stand as they are: nothing is escaped, a query is plain pairs, no parameters in the path.
PLAIN = rf"^[A-Za-z][A-Za-z0-9+.-]*://(?!(?i:www\.)(?:[/?#]|$))[A-Za-z0-9._:-]+(?:/[A-Za-z0-9._~!$&'()*+,=:@%/-]*)?(?:\?{_pair}(?:&{_pair})*)?(?:#.*)?$"


def _normalize_plain(url: Column) -> Column:
    """The normal form of an address like PLAIN whose query names no parameter twice; else null."""
    scheme, host = F.lower(F.regexp_extract(url, "^([^:]*):", 1)), F.regexp_replace(F.lower(F.regexp_extract(url, "://([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)
    path = F.when(path.endswith("/") & (path != "/"), F.substring(path, F.lit(1), F.length(path) - 1)).otherwise(path)
    name = lambda pair: F.substring_index(pair, "=", 1)
    good = lambda pair: pair.contains("=") & ~pair.endswith("=") & ~F.lower(name(pair)).isin(*TRACKING)
    pairs = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), good)
    names = F.transform(pairs, name)
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    return F.when(url.rlike(PLAIN) & (F.size(F.array_distinct(names)) == F.size(names)), F.concat(scheme, F.lit("://"), host, path, query))


def normalize_url(url: Column | str) -> Column:
    """Null stays null; a malformed URL is kept as it is. Only addresses that are not PLAIN are sent to Python."""
    url = F.col(url) if isinstance(url, str) else url
    plain = _normalize_plain(url)
    return F.coalesce(plain, _normalize_odd(F.when(plain.isNull(), url)))


def url_hash(url: Column) -> Column:
    return F.sha2(normalize_url(url), 256)


def url_domain(url: Column) -> Column:
    host = F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))
    return F.nullif(F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":\d+$", ""), F.lit(""))
