"""New sources from the links of articles, and from site lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressroom.functions import links as L
from pressroom.functions.urls import url_domain

#: Mentions from which a candidate is worth analysing.
WORTH = 5
#: Articles that are shown of those that mention a domain.
SHOWN = 50


def exploded_links(articles: DataFrame) -> DataFrame:
    """article_id, article_title, crawled_at, url of every outbound link; articles: id, title, crawled_at, external_links array<struct<url, anchor>>."""
    link = F.explode("external_links").alias("link")
    return articles.select(F.col("id").alias("article_id"), F.col("title").alias("article_title"), "crawled_at", link).withColumn("url", F.col("link.url")).drop("link")


def judged_links(links: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """The links of the last hours with domain and verdict: candidate, no_domain, blacklisted or off_topic."""
    recent = links.where(F.col("crawled_at") >= now - F.expr(f"INTERVAL {hours} HOURS")).withColumn("domain", url_domain(F.col("url")))
    verdict = (
        F.when(F.col("domain").isNull(), "no_domain")
        .when(L.is_blacklisted(F.col("domain")), "blacklisted")
        .when(~L.has_topic_keyword(F.col("url")), "off_topic")
        .otherwise("candidate")
    )
    return recent.withColumn("verdict", verdict)


def link_mentions(links: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """domain, article_id, mentions, article_title, url: the domains that recent articles link to, a row for each article of each; title and link are those of the least link."""
    found = judged_links(links, now, hours).where("verdict = 'candidate'")
    by_article = found.groupBy("domain", "article_id").agg(F.count("*").alias("mentions"), F.min(F.struct("article_title", "url")).alias("first"))
    return by_article.select("domain", "article_id", "mentions", "first.article_title", "first.url")


def with_mentions(domains: DataFrame, mentions: DataFrame, most: int = SHOWN) -> DataFrame:
    """The domains with articles, how many mention them, and discovered_from: the first `most` of these, by article id. mentions: domain, article_id, article_title, url.

    Mentions are counted before they are shuffled, and ranked in parts before they are by domain, so a domain that very many articles link to is no single row or task.
    """
    known = mentions.select("domain", "article_id", "article_title", "url")
    rank = lambda *by: F.row_number().over(Window.partitionBy("domain", *by).orderBy("article_id"))
    few = known.withColumn("_rank", rank(F.pmod(F.xxhash64("article_id"), F.lit(64)))).where(F.col("_rank") <= most)
    few = few.withColumn("_rank", rank()).where(F.col("_rank") <= most)
    shown = few.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("article_id", "article_title", "url"))).alias("discovered_from"))
    return domains.join(known.groupBy("domain").agg(F.count("*").alias("articles")), "domain", "left").fillna(0, ["articles"]).join(shown, "domain", "left")


def mine_link_candidates(links: DataFrame, now: Column, hours: int = 24, most: int = SHOWN) -> DataFrame:
    """domain, mentions, articles, discovered_from: the domains that recent articles link to; mentions counts every link, articles each article once."""
    found = link_mentions(links, now, hours)
    return with_mentions(found.groupBy("domain").agg(F.sum("mentions").alias("mentions")), found, most)


def mining_stats(links: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """One row: links scanned, kept and dropped, distinct domains kept."""
    judged = judged_links(links, now, hours)
    kept = F.col("verdict") == "candidate"
    return judged.agg(
        F.count("*").alias("links"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"), F.count_distinct(F.when(kept, F.col("domain"))).alias("domains")
    )


def exclude_sources(mined: DataFrame, sources: DataFrame) -> DataFrame:
    """The mined domains that are no sources yet."""
    return mined.join(sources.select("domain").distinct(), "domain", "left_anti")


def merge_candidates(existing: DataFrame, known: DataFrame, mined: DataFrame, sources: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The candidates after a run of mining, and the mentions that it adds; domains that are sources already are left alone.

    A known candidate gains one mention a run, a new one starts with its links. Either awaits analysis from WORTH mentions, the known one only if it was never
    analysed. existing: domain, url, mention_count, first_seen_at, last_seen_at, auto_analysis, status; known: the mentions so far (domain, article_id,
    article_title, url), to which what comes second is to be appended; mined: link_mentions of the run. with_mentions shows what mentions a candidate.
    """
    new = exclude_sources(mined, sources)
    added = new.join(known.select("domain", "article_id"), ["domain", "article_id"], "left_anti").select("domain", "article_id", "article_title", "url")
    both = existing.join(new.groupBy("domain").agg(F.sum("mentions").alias("mentions")), "domain", "full_outer")
    seen, listed = F.col("mentions").isNotNull(), F.col("mention_count").isNotNull()
    count = F.when(listed & seen, F.col("mention_count") + 1).otherwise(F.coalesce("mention_count", "mentions"))
    asks = seen & (count >= WORTH) & F.col("auto_analysis").isNull()
    candidates = both.select(
        "domain",
        F.coalesce("url", F.concat(F.lit("https://"), "domain")).alias("url"),
        count.cast("long").alias("mention_count"),
        F.coalesce("first_seen_at", now).alias("first_seen_at"),
        F.when(seen, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        "auto_analysis",
        F.when(asks, "pending_analysis").otherwise(F.coalesce("status", F.lit("new"))).alias("status"),
    )
    return candidates, added


def pending_candidates(candidates: DataFrame, most: int = 20) -> DataFrame:
    """The candidates to analyse next."""
    waiting = (F.col("mention_count") >= WORTH) & F.col("auto_analysis").isNull() & F.col("status").isin("new", "pending_analysis")
    return candidates.where(waiting).orderBy(F.desc("mention_count"), "domain").limit(most)


def list_candidates(candidates: DataFrame, status: str | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """A page of candidates, most mentions first."""
    found = candidates if status is None else candidates.where(F.col("status") == status)
    return found.orderBy(F.desc("mention_count"), "domain").offset((page - 1) * size).limit(size)


def approve_candidates(candidates: DataFrame, decisions: DataFrame, sources: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """New sources, and the candidates with status and approved_source_id after decisions (domain, approve, name, country, language, priority).

    A candidate approved before, or whose domain is a source, stays as it is. New ids go on from the highest one; within a
    run they follow the domains' order, domain by domain, so a run is meant for the decisions of a day.
    """
    known = sources.select("domain").distinct().withColumn("_source", F.lit(True))
    asked = decisions.select("domain", "approve", *(F.col(c).alias(f"_{c}") for c in ("name", "country", "language", "priority"))).dropDuplicates(["domain"])
    both = candidates.join(asked, "domain", "left").join(known, "domain", "left")
    free = F.col("approve").isNotNull() & (F.col("status") != "approved")
    accepted = both.where(free & F.col("approve") & F.col("_source").isNull())
    top = sources.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    number = F.row_number().over(Window.orderBy("domain"))  # over one run's approvals
    ids = accepted.select("domain", number.alias("_n")).withColumn("_one", F.lit(1)).join(top.withColumn("_one", F.lit(1)), "_one")
    ids = ids.select("domain", (F.col("_top") + F.col("_n")).cast("long").alias("_id"))
    made = accepted.join(ids, "domain")
    new = made.select(
        F.col("_id").alias("id"),
        F.coalesce("_name", "domain").alias("name"),
        "domain",
        F.coalesce("url", F.concat(F.lit("https://"), "domain")).alias("url"),
        F.coalesce("_country", "auto_analysis.country", F.lit("US")).alias("country"),
        F.coalesce("_language", "auto_analysis.language", F.lit("en")).alias("language"),
        F.coalesce("_priority", F.lit("medium")).alias("priority"),
        F.lit("active").alias("status"),
        F.lit(1).alias("tier"),
        F.lit(False).alias("has_rss"),
        F.lit(240).alias("crawl_interval_minutes"),
        now.alias("next_crawl_at"),
    )
    changed = both.join(ids, "domain", "left")
    status = F.when(F.col("_id").isNotNull(), "approved").when(free & ~F.col("approve"), "rejected").otherwise(F.col("status"))
    rest = [c for c in candidates.columns if c not in ("status", "approved_source_id")]
    old = F.col("approved_source_id") if "approved_source_id" in candidates.columns else F.lit(None).cast("long")
    return new, changed.select(*rest, status.alias("status"), F.coalesce("_id", old).alias("approved_source_id"))


def sites_of_lines(lines: DataFrame) -> DataFrame:
    """domain, url, country, language, region, name, is_auto of a list of sites; lines: position, line.

    Blank lines, comments and headers are skipped; a line is an address or a bare domain; the first line of a domain counts.
    """
    line = F.trim("line")
    address = line.rlike("^https?://")
    bare = ~address & line.rlike(r"^[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}")
    good = (line != "") & ~line.startswith("#") & ~line.startswith("是否") & (address | bare)
    url = F.when(address, line).otherwise(F.concat(F.lit("https://"), line))
    host = F.when(address, F.regexp_extract(line, "^https?://([^/?#]*)", 1)).otherwise(line)
    found = lines.where(good).select("position", url.alias("url"), F.regexp_replace(host, r"^www\.", "").alias("domain"))
    first = found.groupBy("domain").agg(F.min_by("url", "position").alias("url"))
    d, u = F.col("domain"), F.col("url")
    out = first.select(d, u, L.site_country(d, u).alias("country"), L.site_language(d, u).alias("language"), L.site_name(d).alias("name"), L.is_auto_site(d, u).alias("is_auto"))
    return out.withColumn("region", L.site_region(F.col("country")))


def import_new_sites(sites: DataFrame, sources: DataFrame) -> DataFrame:
    """The sites whose domain is no source yet."""
    return sites.join(sources.select("domain").distinct(), "domain", "left_anti")


def upsert_sources(existing: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """The sources after a catalogue is read: known URLs get its descriptive columns, unknown ones are added as active and due.

    incoming: url, name, domain, country, language, region, priority, tier; the last of equal URLs by all columns counts.
    """
    described = ["name", "domain", "country", "language", "region", "priority", "tier"]
    given = incoming.withColumn("url", F.trim("url")).groupBy("url").agg(F.max(F.struct(*described)).alias("_new"))
    both = existing.join(given, "url", "full_outer")
    added = F.col("id").isNull() & F.col("_new").isNotNull()
    replaced = {c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in described}
    replaced |= {"status": F.when(added, "active").otherwise(F.col("status")), "next_crawl_at": F.when(added, now).otherwise(F.col("next_crawl_at"))}
    return both.withColumns(replaced).select(existing.columns)
