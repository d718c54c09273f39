"""Fetched pages: one parse of each page in a task, everything after it as expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressroom import constants as C
from pressroom.functions import articles as A
from pressroom.functions import links as L
from pressroom.functions.markup import Parser
from pressroom.functions.text import excerpt, is_article_url
from pressroom.functions.urls import url_domain

PARSED = (
    "id long, url string, title string, content string, author string, published string, language string, lead_image string, images array<string>, hrefs array<string>, tags double"
)
_TAG = re.compile(A.TAG)
_SKIPPED = {"script", "style", "nav", "footer", "aside", "header", "noscript", "form"}
_BLOCKS = {"p", "h2", "h3", "h4", "li", "blockquote", "pre"}
#: Elements that hold a body's blocks.
_HOLDERS = {"body", "main", "section", "div", "article", "td"}
#: From this share of a block's characters in links on, it is a menu.
MENU = 0.5
MOST_LINKS = 30


class Block(NamedTuple):
    said: str
    linked: float
    holders: tuple[int, ...]
    article: int | None

    def weight(self) -> float:
        return len(self.said) * (1 - self.linked)


def body_of(blocks: list[Block]) -> list[str]:
    """The blocks of the <article> with most text, or of the element with most text of its own, as far as it isn't links.

    Outside of articles a block counts for the element that holds it and half for the one around that; all blocks within the best one are taken but for menus.
    """
    articles: dict[int, float] = {}
    holders: dict[int, float] = {}
    for block in blocks:
        if block.article is not None:
            articles[block.article] = articles.get(block.article, 0) + block.weight()
        for share, holder in zip((1, 0.5), reversed(block.holders), strict=False):
            holders[holder] = holders.get(holder, 0) + share * block.weight()
    if articles:
        best = max(articles, key=articles.get)
        return [b.said for b in blocks if b.article == best]
    best = max(holders, key=holders.get, default=None)
    return [b.said for b in blocks if b.linked < MENU and (best is None or best in b.holders)]


class Page(Parser):
    """What a page says about itself: titles, metadata, blocks of text and what holds them, images and links."""

    def __init__(self, url: str):
        super().__init__()
        self.url, self.base = url, url
        self.meta: dict[str, str] = {}
        self.titles: dict[str, list[str]] = {}
        self.images: list[str] = []
        self.hrefs: list[str] = []
        self.language = self.time = None
        self.skipped = self.holders_seen = self.link_chars = 0
        self.open_title: str | None = None
        self.block: list[str] | None = None
        self.blocks: list[Block] = []
        self.holders: list[tuple[str, int]] = []
        self.in_link = False

    def absolute(self, link: str) -> str | None:
        try:
            return urljoin(self.base, link)
        except ValueError:
            return None

    def handle_starttag(self, tag, attrs):
        at = {name: value or "" for name, value in reversed(attrs)}
        if tag == "html":
            self.language = self.language or at.get("lang") or None
        elif tag == "meta":
            name = (at.get("property") or at.get("name") or at.get("itemprop") or "").lower()
            if name and at.get("content"):
                self.meta.setdefault(name, at["content"].strip())
        elif tag == "time":
            self.time = self.time or at.get("datetime") or None
        elif tag == "img":
            link = at.get("src") or at.get("data-src") or at.get("data-lazy-src")
            if link and (link := self.absolute(link)):
                self.images.append(link)
        elif tag == "a":
            self.in_link = "href" in at
            if self.in_link:
                self.hrefs.append(at["href"].strip())
        if tag in ("title", "h1"):
            self.open_title = tag
            self.titles.setdefault(tag, [])
        if tag in _SKIPPED:
            self.skipped += 1
            self.close_block()
        elif tag in _HOLDERS:
            self.close_block()
            self.holders_seen += 1
            self.holders.append((tag, self.holders_seen))
        elif tag in _BLOCKS and not self.skipped:
            self.close_block()
            self.block, self.link_chars = [], 0
        elif tag == "br" and self.block is not None:
            self.block.append(" ")

    def handle_endtag(self, tag):
        if tag == self.open_title:
            self.open_title = None
        if tag in _BLOCKS:
            self.close_block()
        elif tag in _SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        elif tag == "a":
            self.in_link = False
        elif tag in _HOLDERS:
            self.close_block()
            at = next((k for k in reversed(range(len(self.holders))) if self.holders[k][0] == tag), None)
            del self.holders[at if at is not None else len(self.holders) :]

    def handle_data(self, data):
        if self.open_title and (self.open_title == "h1" or not self.titles.get("h1")):
            self.titles[self.open_title].append(data)
        if self.block is not None and not self.skipped:
            self.block.append(data)
            self.link_chars += len(data) if self.in_link else 0

    def close_block(self):
        if self.block is not None:
            whole = "".join(self.block)
            said = " ".join(whole.split())
            if said:
                article = next((n for tag, n in self.holders if tag == "article"), None)
                self.blocks.append(Block(said, self.link_chars / len(whole), tuple(n for _, n in self.holders), article))
            self.block = None

    def row(self, key: int) -> tuple:
        self.close_block()
        said = lambda tag: " ".join("".join(self.titles.get(tag, [])).split())
        title = self.meta.get("og:title") or said("h1") or said("title") or None
        dates = ("article:published_time", "datepublished", "pubdate", "date", "dc.date")
        lead = self.meta.get("og:image")
        return (
            key,
            self.url,
            title,
            "\n".join(body_of(self.blocks)) or None,
            self.meta.get("author") or self.meta.get("article:author"),
            next((self.meta[d] for d in dates if d in self.meta), self.time),
            self.language,
            self.absolute(lead) if lead else None,
            self.images,
            self.hrefs,
        )


def parsed(pages: DataFrame) -> DataFrame:
    """The columns of PARSED for every page (id, url, html), tags being tag_share(); a null or unreadable page has none but id and url. No shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, url, html in frame.itertuples(index=False):
                page = Page(url or "")
                try:
                    page.feed(html or "")
                    page.close()
                except (AssertionError, ValueError):
                    page = Page(url or "")
                tags = len(_TAG.findall(html)) / len(html) if html else None
                rows.append((key, url, *page.row(key)[2:], tags))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])

    return pages.select(F.col("id").cast("long"), "url", "html").mapInPandas(run, PARSED)


def page_images(lead: Column, images: Column) -> tuple[Column, Column]:
    """The lead image (declared, else the first), and all distinct ones in order."""
    distinct = F.array_distinct(images)
    return F.coalesce(lead, F.get(distinct, 0)).alias("image_url"), distinct.alias("image_urls")


def _host(url: Column) -> Column:
    """Lower-case host with its port, without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^https?://([^/?#]*)", 1)), r"^www\.", "")


def external_links(url: Column, hrefs: Column) -> Column:
    """Distinct absolute links to other hosts that may lead to news, in order."""

    def good(href: Column) -> Column:
        host = _host(href)
        return href.rlike("^https?://") & (host != _host(url)) & ~L.is_listed(host, C.PAGE_BLACKLIST) & ~L.any_part(F.lower(href), C.NO_NEWS_LINK)

    return F.array_distinct(F.filter(hrefs, good))


def extract_pages(pages: DataFrame) -> DataFrame:
    """Articles of fetched pages: title, content, author, published_at, images, external_links, language, excerpt, quality, is_news, success."""
    lead, images = page_images(F.col("lead_image"), F.col("images"))
    out = parsed(pages).select(
        "id", "url", "title", "content", "author", A.parse_publish_date(F.col("published")).alias("published_at"), lead, images,
        external_links(F.col("url"), F.col("hrefs")).alias("external_links"), "language", "tags",
    )
    has_image = F.col("image_url").isNotNull() | (F.size("image_urls") > 0)
    quality = A.quality_score(F.col("title"), F.col("content"), F.col("published_at"), F.col("tags"), has_image)
    out = out.withColumns(
        {
            "content_length": F.coalesce(F.length("content"), F.lit(0)),
            "excerpt": excerpt(F.col("content")),
            "quality": quality,
            "is_news": A.is_news_article(F.col("url"), F.col("title"), F.col("content")),
        }
    )
    return out.withColumn("success", F.col("quality") >= A.SUCCESS).drop("tags")


def article_links(pages: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """id, position, link: the first distinct links of list pages to articles of the same host."""

    @F.pandas_udf("array<string>")
    def absolute(urls: pd.Series, hrefs: pd.Series) -> pd.Series:
        def one(base, links):
            out = []
            for link in links:
                try:
                    out.append(link if link.startswith(("http://", "https://")) else urljoin(base or "", link))
                except ValueError:
                    continue
            return out

        return pd.Series([one(base, links) for base, links in zip(urls, hrefs, strict=True)])

    def good(link: Column) -> Column:
        path = F.lower(F.regexp_extract(link, "^https?://[^/?#]*([^?#;]*)", 1))
        return (_host(link) == _host(F.col("url"))) & ~path.isin("", "/") & ~L.any_part(path, C.NO_ARTICLE_PATH) & is_article_url(path)

    made = parsed(pages).select("id", "url", absolute("url", "hrefs").alias("links"))
    kept = F.slice(F.array_distinct(F.filter("links", good)), 1, most)
    return made.select("id", F.posexplode(kept).alias("position", "link"))


def tier_route(pages: DataFrame, sources: DataFrame, adapted: DataFrame) -> DataFrame:
    """Extracted pages: of tier-2 sites those that an adapter read (adapted: id, title, content, published_at; quality 1), all others by extract_pages.

    An adapter's row without title and content counts as a failure. Pages of unknown sites are read by extract_pages.
    """
    tiers = sources.select("domain", "tier").dropDuplicates(["domain"])
    placed = pages.withColumn("domain", url_domain(F.col("url"))).join(tiers, "domain", "left")
    good = adapted.where(F.col("title").isNotNull() | F.col("content").isNotNull())
    by_adapter = placed.where("tier = 2").select("id", "url").join(good.select("id", "title", "content", "published_at"), "id")
    by_adapter = by_adapter.select(
        "id", "url", "title", "content", "published_at", F.substring("content", 1, 200).alias("excerpt"), F.lit(1.0).alias("quality"), F.lit("adapter").alias("route")
    )
    rest = pages.join(by_adapter.select("id"), "id", "left_anti")
    generic = extract_pages(rest).select("id", "url", "title", "content", "published_at", "excerpt", "quality", F.lit("generic").alias("route"))
    return by_adapter.unionByName(generic)


def adapter_quality(extracted: DataFrame, first: int = 3, least: int = 2, chars: int = 200) -> DataFrame:
    """domain, good, passes: whether an adapter reads enough of a site's first pages; extracted: domain, position, success, content_length."""
    rank = F.row_number().over(Window.partitionBy("domain").orderBy("position"))
    good = F.count_if(F.col("success") & (F.col("content_length") > chars)).alias("good")
    return extracted.withColumn("_rank", rank).where(F.col("_rank") <= first).groupBy("domain").agg(good).withColumn("passes", F.col("good") >= least)
