"""Expressions over titles, bodies and scores."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A stop counts as the end of an excerpt only beyond this place of its 300 characters.
EXCERPT, EARLIEST_STOP = 300, 151


def preprocess_title(title: Column) -> Column:
    """Everything but word characters becomes white space, which collapses; only ASCII letters are lower-cased."""
    words = F.regexp_replace(title, r"(?U)[^\w\s]", " ")
    lower = F.translate(words, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, r"(?U)\s+", " "))


def title_tokens(title: Column, language: Column) -> Column:
    """Chinese, Japanese and Korean: overlapping pairs of characters; otherwise words."""
    pairs = F.when(F.length(title) > 1, F.transform(F.sequence(F.lit(1), F.length(title) - 1), lambda i: title.substr(i, F.lit(2)))).otherwise(
        F.array().cast("array<string>")
    )
    cjk = F.split_part(F.lower(F.coalesce(language, F.lit(""))), F.lit("-"), F.lit(1)).isin("zh", "ja", "ko")
    return F.when(cjk, pairs).otherwise(F.array_remove(F.split(title, r"\s+"), ""))


@F.pandas_udf(T.LongType())
def simhash64(tokens: pd.Series) -> pd.Series:
    """63 bits: bit i tells whether most tokens' md5 (low 64 bits) have it set; none: 0."""
    rows = [() if row is None else row for row in tokens]
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    out = np.zeros(len(rows), np.int64)
    some = sizes > 0
    if some.any():
        codes, distinct = pd.factorize(np.array([t for row in rows for t in row], object))
        digests = b"".join(hashlib.md5(t.encode()).digest()[8:] for t in distinct)
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        starts = (np.cumsum(sizes) - sizes)[some]
        most = np.add.reduceat(bits[codes], starts, axis=0, dtype=np.int64) * 2 > sizes[some, None]
        out[some] = np.packbits(most, axis=1).view(">u8").ravel().astype(np.int64) & 0x7FFFFFFFFFFFFFFF
    return pd.Series(out, index=tokens.index)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def excerpt(content: Column) -> Column:
    head = F.substring(content, 1, EXCERPT)
    cut = F.regexp_extract(head, "(?s)^(.*[。！？.!?])", 1)
    return F.when(F.length(content) <= EXCERPT, content).when(F.length(cut) > EARLIEST_STOP, cut).otherwise(F.concat(F.rtrim(head), F.lit("...")))


def is_article_url(path: Column) -> Column:
    """Dated paths, deep paths whose last part is a slug, and numbered paths."""
    parts = F.array_remove(F.split(path, "/"), "")
    slug = (F.size(parts) >= 2) & F.coalesce(F.try_element_at(parts, F.lit(-1)).rlike("[-_]"), F.lit(False))
    return path.rlike(r"/\d{4}/\d{2}/|/\d{4}-\d{2}-\d{2}/") | slug | path.rlike(r"/\d{4,}")


def importance_score(articles: Column, languages: Column, countries: Column) -> Column:
    return F.round(articles * 0.4 + languages * 0.3 + countries * 0.3, 2)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)
