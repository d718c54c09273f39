"""Sources, their logs and profiles, and candidates for new ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressroom import constants as C
from pressroom import views
from pressroom.functions import articles as AF
from pressroom.functions import links as LF
from pressroom.functions.urls import url_domain
from pressroom.operators import aggregates, discovery, listings, sources
from pressroom.plans.common import HOST, LATER, LINKS, LS, NOW, AS, L, S, matching, now, of_articles, of_logs, of_sources
from pressroom.sources import sites

HOUR, WEEKDAY = 9, 6


def _rates(logs):
    rate = sources.discovery_rate(F.col("articles_new"), F.col("articles_found"))
    return logs.select("id", rate.alias("rate"), sources.next_interval(F.lit(90), rate).alias("minutes"))


def _totals(spark, d):
    return aggregates.source_totals(views.articles(spark, d), views.sources(spark, d), now())


def _success(spark, d):
    return aggregates.success_rate(views.crawl_logs(spark, d).where("source_id % 4 <> 1"), views.sources(spark, d))


def _profile(spark, d):
    return aggregates.publish_profile(views.articles(spark, d), now())


def _profile_row(spark, d):
    lists = ("hours", "weekdays", "top_hours", "top_weekdays")
    return _profile(spark, d).select(
        "source_id", "total", *(F.array_join(c, ",").alias(c) for c in lists), *(F.round(c, 6).alias(c) for c in ("weekend_ratio", "weekend_ratio_per_day", "avg_articles_per_day"))
    )


def _decisions(spark, d):
    maps = aggregates.profile_maps(_profile(spark, d))
    hour = (F.col("source_id") % 24).cast("int")
    day = (F.col("source_id") % 7).cast("int")
    said = sources.should_crawl_now(F.col("publish_hours"), F.col("publish_weekdays"), hour, day)
    return maps.select("source_id", said["crawl"].alias("crawl"), said["reason"].alias("reason"), sources.optimized_interval(F.lit(240), F.col("publish_hours"), hour).alias("minutes"))


def _patched(spark, d):
    own = views.sources(spark, d)
    patches = own.where("id % 3 = 0").select(
        (F.col("id") * 2).alias("id"),
        F.when(F.col("id") % 2 == 0, "paused").alias("status"),
        F.when(F.col("id") % 9 == 0, "urgent").otherwise("high").alias("priority"),
        F.lit(None).cast("int").alias("tier"),
        F.lit(60).alias("crawl_interval_minutes"),
    )
    out, rejected = listings.patch_sources(own, patches)
    rejected = rejected.select("id", F.lit(True).alias("rejected"))
    return out.select("id", "status", "priority", "tier", "crawl_interval_minutes").join(rejected, "id", "full_outer").fillna(False, ["rejected"])


def _restored(spark, d):
    own = views.sources(spark, d)
    probes = own.select(F.col("id").alias("source_id"), F.when(F.col("id") % 3 == 0, 404).otherwise(200).alias("http_status"), (F.col("id") * 10).alias("content_chars"))
    return sources.restore_paused(own, probes).select("id", "status", "priority", "consecutive_errors")


def _upserted(spark, d):
    own = views.sources(spark, d)
    known = own.where("id % 2 = 0").select("url", F.concat(F.lit("New "), "name").alias("name"), "domain", F.lit("XX").alias("country"), "language", "region", F.lit("low").alias("priority"), F.lit(3).alias("tier"))
    new = own.where("id % 2 = 1").select(
        F.concat(F.lit(" https://new"), "id", F.lit(".example.org ")).alias("url"), "name", "domain", "country", "language", "region", "priority", "tier"
    )
    return sources_state(discovery.upsert_sources(own, known.unionByName(new), now(LATER)))


def sources_state(df):
    return df.select("id", "url", "name", "country", "priority", "tier", "status", "next_crawl_at", "crawl_count")


def _site_lines(spark, d):
    """Addresses of pages, domains and odd lines, as a site list has them."""
    line = (
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("# "), "url"))
        .when(F.col("page_id") % 5 == 1, F.regexp_extract("url", "://([^/?#]*)", 1))
        .when(F.col("page_id") % 5 == 2, "  ")
        .otherwise(F.col("url"))
    )
    return views.table(spark, d, "pages").select(F.col("page_id").alias("position"), line.alias("line"))


def _sites(spark, d):
    return discovery.sites_of_lines(_site_lines(spark, d))


def _new_sites(spark, d):
    known = views.table(spark, d, "pages").where("page_id % 2 = 0").select(F.regexp_replace(F.regexp_extract("url", "://([^/?#]*)", 1), r"^www\.", "").alias("domain"))
    return discovery.import_new_sites(_sites(spark, d), known).select("domain", "url")


def _mined(spark, d, hours=24):
    return discovery.mine_link_candidates(views.links(spark, d), now(), hours)


def _mined_row(spark, d):
    return _mined(spark, d).select("domain", "mentions", F.col("articles").cast("int").alias("articles"), F.get("discovered_from", 0)["article_id"].alias("first_article"))


def _candidates(spark, d):
    """Candidates of the week before, made from the same links."""
    old = discovery.mine_link_candidates(views.links(spark, d), F.lit("2024-01-07").cast("timestamp"), 24 * 6)
    asked = F.length("domain") % 3 == 0
    analysis = F.from_json(F.when(asked, '{"is_automotive": true, "confidence": 0.9, "language": "de", "country": "DE"}'), LF.ANALYSIS)
    return old.select(
        "domain", F.concat(F.lit("https://"), "domain").alias("url"), F.col("mentions").alias("mention_count"), now("2024-01-02").alias("first_seen_at"),
        now("2024-01-06").alias("last_seen_at"), analysis.alias("auto_analysis"), F.lit("new").alias("status"),
    )


def _merged(spark, d):
    known = _candidates(spark, d).select(F.col("domain")).where("length(domain) % 5 = 0")
    before = discovery.link_mentions(views.links(spark, d), F.lit("2024-01-07").cast("timestamp"), 24 * 6)
    out, added = discovery.merge_candidates(_candidates(spark, d), before, discovery.link_mentions(views.links(spark, d), now()), known, now())
    shown = discovery.with_mentions(out, before.select(added.columns).unionByName(added))
    return shown.select("domain", "mention_count", F.col("articles").cast("int").alias("articles"), "last_seen_at", "status")


def _excluded(spark, d):
    """Mined domains but those that every third page has as its host."""
    known = views.table(spark, d, "pages").where("page_id % 3 = 0").select(url_domain(F.col("url")).alias("domain"))
    return discovery.exclude_sources(_mined(spark, d), known).select("domain", "mentions")


def _approved(spark, d):
    c = _candidates(spark, d)
    none = F.lit(None).cast("string")
    decisions = c.where("length(domain) % 2 = 0").select("domain", (F.length("domain") % 4 == 0).alias("approve"), none.alias("name"), none.alias("country"), F.lit("fr").alias("language"), none.alias("priority"))
    new, changed = discovery.approve_candidates(c, decisions, views.sources(spark, d), now(LATER))
    return changed.select("domain", "status", "approved_source_id").join(new.select("domain", "country", "language", "priority"), "domain", "left")


def _feeds(spark, d):
    """Articles of each source as feeds: the sources of even number in Atom, the others in RSS."""
    a = views.articles(spark, d)
    escaped = F.replace(F.replace(F.replace(F.coalesce("title", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    link = F.concat(F.lit("https://example.com/"), "id")
    rss = F.concat(F.lit("<item><title>"), escaped, F.lit("</title><link>"), link, F.lit("</link><pubDate>"), F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate></item>"))
    atom = F.concat(F.lit("<entry><title>"), escaped, F.lit('</title><link href="'), link, F.lit('"/><updated>'), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated></entry>"))
    item = F.struct("id", F.when(F.col("source_id") % 2 == 0, atom).otherwise(rss).alias("x"))
    docs = a.where("source_id IS NOT NULL").groupBy("source_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return docs.select("source_id", F.concat(F.lit("<feed>"), F.array_join(F.transform("items", lambda s: s["x"]), ""), F.lit("</feed>")).alias("xml"))


def _fed(spark, d):
    return sites.read_feed(_feeds(spark, d)).select("source_id", "position", "title", "url", "published_at")


def _incremental(spark, d):
    items = views.articles(spark, d).select("id", "source_id", F.col("id").alias("position"), F.when(F.col("id") % 5 != 0, F.col("published_at")).alias("published_at"))
    known = views.sources(spark, d).select("id", F.when(F.col("id") % 3 != 0, now("2024-01-03")).alias("last_crawl_at"))
    return listings.incremental_filter(items, known, now(), 10).select("id", "source_id")


def _errors(logs):
    error = F.when(F.col("status") == "error", F.element_at(F.array(F.lit("http_500"), F.lit("timeout"), F.lit("broken")), (F.col("id") % 3 + 1).cast("int")))
    return logs.select("id", AF.classify_crawl_error(error, F.col("articles_found") % 10).alias("kind"))


def _domains(spark, d):
    domain = F.element_at(F.array(*map(F.lit, ("m.facebook.com", "x.com", "motor1.com", "netflix.com", "uk.motor1.com"))), (F.col("page_id") % 6 + 1).cast("int"))
    own = F.when(F.col("page_id") % 6 < 5, domain).otherwise(F.regexp_extract("url", "://([^/?#]*)", 1))
    p = views.table(spark, d, "pages").select("page_id", own.alias("domain"))
    return p.select(F.col("page_id").alias("id"), LF.is_blacklisted(F.col("domain")).alias("listed"))


def _topics(spark, d):
    return views.pages(spark, d).select("id", LF.has_topic_keyword(F.col("url")).alias("on_topic"))


QUERIES = {
    "a1_site_list": lambda spark, d: _sites(spark, d).drop("is_auto"),
    "a3_upsert_sources": _upserted,
    "a4_import_new_sites": _new_sites,
    "a5_read_feed": _fed,
    "a8_prune_logs": of_logs(lambda logs: sites.prune_logs(logs, now(LATER), 10).select("id", "source_id")),
    "f12_is_blacklisted": _domains,
    "f13_topic_keyword": _topics,
    "f17_site_rules": lambda spark, d: _sites(spark, d).select("domain", "country", "language", "region", "is_auto"),
    "w1_incremental_filter": _incremental,
    "w3_list_sources": of_sources(lambda s: listings.list_sources(s, status="active", sort_by="country", descending=True, size=30).select("id", "country")),
    "w4_patch_sources": _patched,
    "g1_system_stats": lambda spark, d: listings.system_stats(views.sources(spark, d), views.articles(spark, d), now()),
    "g2_top_languages": of_articles(lambda a: aggregates.top_values(a, "language")),
    "g2_top_countries": of_articles(lambda a: aggregates.top_values(a, "country")),
    "g3_source_totals": _totals,
    "g4_health_stats": of_sources(listings.health_stats),
    "g5_health_matrix": of_sources(listings.health_matrix),
    "g6_daily_crawl_report": of_logs(aggregates.daily_crawl_report),
    "g7_success_rate": _success,
    "g8_publish_profile": _profile_row,
    "g9_mine_links": _mined_row,
    "g9_mining_stats": lambda spark, d: discovery.mining_stats(views.links(spark, d), now()),
    "g10_merge_candidates": _merged,
    "j3_candidate_exclusion": _excluded,
    "t1_due_sources": of_sources(lambda s: listings.due_sources(s, now(LATER)).select("id", "priority", "next_crawl_at")),
    "t2_needs_repair": of_sources(lambda s: listings.needs_repair(s).select("id", "consecutive_errors")),
    "t3_pending_candidates": lambda spark, d: discovery.pending_candidates(_candidates(spark, d)).select("domain", "mention_count"),
    "t4_list_candidates": lambda spark, d: discovery.list_candidates(_candidates(spark, d), "new").select("domain", "mention_count"),
    "t5_recent_logs": of_logs(lambda logs: aggregates.recent_logs(logs, 5).select("source_id", "id", "rank")),
    "t6_t7_next_interval": of_logs(_rates),
    "t8_next_crawl_at": of_sources(lambda s: s.select("id", sources.next_crawl_at(F.col("last_crawl_at"), F.col("crawl_interval_minutes"), F.col("consecutive_errors")).alias("next_crawl_at"))),
    "t9_frequency": of_logs(lambda logs: sources.frequency(logs).withColumn("average_new", F.round("average_new", 6))),
    "t10_health": of_logs(sources.health),
    "t11_daily_health_rules": of_sources(lambda s: sources.daily_health_rules(s, now(LATER)).select("id", "status", "priority", "changed")),
    "t12_restore_paused": _restored,
    "t13_t14_profile_decisions": _decisions,
    "t15_approve_candidates": _approved,
    "t17_classify_crawl_error": of_logs(_errors),
}

_HOURS = ", ".join(f"count(*) FILTER (hour(published_at) = {h})" for h in range(24))
_DAYS = ", ".join(f"count(*) FILTER (isodow(published_at) = {d + 1})" for d in range(7))
_PROFILE = f"""profile AS (SELECT source_id, count(*) AS total, [{_HOURS}] AS h, [{_DAYS}] AS w FROM articles
  WHERE published_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAYS AND published_at <= TIMESTAMP '{NOW}' AND NOT is_duplicate GROUP BY 1)"""
_TOP = lambda c, n: f"list_transform(list_sort(list_transform(range({n}), lambda i: {{'n': -{c}[i + 1], 'i': i}}))[1:3], lambda s: s.i)"
_FOLD = """ordered AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at, id) AS rn FROM crawl_logs {where})"""
_LR = L.replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
_CASES = lambda pairs: " ".join(f"WHEN {test} THEN '{value}'" for test, value in pairs)
_LIST = r"""lines AS (SELECT page_id AS position, trim(CASE page_id % 5 WHEN 0 THEN '# ' || url WHEN 1 THEN regexp_extract(url, '://([^/?#]*)', 1) WHEN 2 THEN '  ' ELSE url END) AS line FROM pages),
  found AS (SELECT position, CASE WHEN line LIKE 'http%://%' THEN line ELSE 'https://' || line END AS url,
    regexp_replace(CASE WHEN line LIKE 'http%://%' THEN regexp_extract(line, '://([^/?#]*)', 1) ELSE line END, '^www\.', '') AS domain FROM lines WHERE line <> '' AND line NOT LIKE '#%'),
  sites AS (SELECT domain, arg_min(url, position) AS url FROM found GROUP BY 1)"""
_COUNTRY = "CASE " + _CASES([(f"suffix(domain, '.{e}')", c) for e, c in C.COUNTRY_BY_SUFFIX.items()] + [(f"contains(lower(url), '/{p}/')", c) for p, c in C.COUNTRY_BY_PATH.items()]) + " ELSE 'US' END"
_LANGUAGE = "CASE " + _CASES([(f"contains(lower(url), '{p}')", v) for p, v in C.LANGUAGE_BY_PART.items()] + [(f"contains(lower(url), '/{p}/')", p) for p in C.LANGUAGE_BY_PATH]) + " ELSE 'en' END"
_REGION = "CASE " + " ".join(f"WHEN country IN ({', '.join(repr(c) for c in cs)}) THEN '{r}'" for r, cs in C.REGIONS.items()) + " ELSE 'Other' END"
_NAME = "(CASE WHEN len(string_split(domain, '.')) > 3 THEN string_split(domain, '.')[-2] ELSE string_split(domain, '.')[1] END)"
_JUDGED = lambda first, last: rf"""(SELECT *, domain IS NOT NULL AND NOT listed AND topic AS kept FROM (SELECT *, {HOST} AS domain,  # noqa: E731
    regexp_matches(lower(url), '{matching(C.TOPIC_IN_URL)}') AS topic, coalesce({HOST} IN ({', '.join(repr(x) for x in C.MINED_BLACKLIST)}), false) AS listed FROM links
    WHERE crawled_at >= TIMESTAMP '{first}' {last}))""".replace("  # noqa: E731", "")
_MINED = f"mined AS (SELECT domain, count(*) AS mentions, count(DISTINCT article_id) AS articles, min(article_id) AS first_article, list(DISTINCT article_id) AS ids FROM {_JUDGED('2024-01-07', '')} WHERE kept GROUP BY 1)"
_OLD = f"""old AS (SELECT domain, mentions AS mention_count, articles, ids, CASE WHEN length(domain) % 3 = 0 THEN 'DE' END AS country FROM
  (SELECT domain, count(*) AS mentions, count(DISTINCT article_id) AS articles, list(DISTINCT article_id) AS ids FROM {_JUDGED('2024-01-01', '')} WHERE kept GROUP BY 1))"""

ORACLE_SQL = {
    "a1_site_list": f"""WITH {_LIST}, placed AS (SELECT *, {_COUNTRY} AS country, {_LANGUAGE} AS language FROM sites)
      SELECT domain, url, country, language, upper({_NAME}[1]) || lower({_NAME}[2:]) AS name, {_REGION} AS region FROM placed""",
    "a3_upsert_sources": f"""{S}SELECT id, url, CASE WHEN id % 2 = 0 THEN 'New ' || name ELSE name END AS name, CASE WHEN id % 2 = 0 THEN 'XX' ELSE country END AS country,
        CASE WHEN id % 2 = 0 THEN 'low' ELSE priority END AS priority, CASE WHEN id % 2 = 0 THEN 3 ELSE tier END AS tier, status, next_crawl_at, crawl_count FROM sources
      UNION ALL SELECT NULL, 'https://new' || id || '.example.org', name, country, priority, tier, 'active', TIMESTAMP '{LATER}', NULL FROM sources WHERE id % 2 = 1""",
    "a4_import_new_sites": rf"WITH {_LIST} SELECT domain, url FROM sites WHERE domain NOT IN (SELECT regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www\.', '') FROM pages WHERE page_id % 2 = 0)",
    "a5_read_feed": f"""{AS}SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC, id) AS INT) AS position,
        CASE WHEN trim(title) <> '' THEN trim(title) ELSE 'Untitled' END AS title, 'https://example.com/' || id AS url, published_at
      FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id) AS n FROM articles WHERE source_id IS NOT NULL) WHERE n <= 50""",
    "a8_prune_logs": f"{L}SELECT id, source_id FROM crawl_logs WHERE started_at >= TIMESTAMP '{LATER}' - INTERVAL 10 DAYS",
    "f12_is_blacklisted": "SELECT page_id AS id, page_id % 6 IN (0, 1) AS listed FROM pages",
    "f13_topic_keyword": f"SELECT page_id AS id, regexp_matches(lower(url), '{matching(C.TOPIC_IN_URL)}') AS on_topic FROM pages",
    "f17_site_rules": f"""WITH {_LIST}, placed AS (SELECT *, {_COUNTRY} AS country, {_LANGUAGE} AS language FROM sites)
      SELECT domain, country, language, {_REGION} AS region, regexp_matches(lower(domain || ' ' || url), '{matching(C.TOPIC_IN_SITE)}') AS is_auto FROM placed""",
    "w1_incremental_filter": f"""{AS}SELECT id, source_id FROM (SELECT a.id, a.source_id, row_number() OVER (PARTITION BY a.source_id ORDER BY a.id) AS n FROM articles a JOIN sources s ON s.id = a.source_id
      WHERE a.id % 5 = 0 OR a.published_at IS NULL OR a.published_at >= CASE WHEN s.id % 3 <> 0 THEN TIMESTAMP '2024-01-03' - INTERVAL 1 HOUR ELSE TIMESTAMP '{NOW}' - INTERVAL 30 DAYS END) WHERE n <= 10""",
    "w3_list_sources": f"{S}SELECT id, country FROM sources WHERE status = 'active' ORDER BY country DESC NULLS FIRST, id LIMIT 30",
    "w4_patch_sources": f"""{S}, patches AS (SELECT id * 2 AS id, CASE WHEN id % 2 = 0 THEN 'paused' END AS status, id % 9 = 0 AS bad FROM sources WHERE id % 3 = 0)
      SELECT coalesce(s.id, p.id) AS id, CASE WHEN s.id IS NOT NULL AND p.id IS NOT NULL AND NOT bad THEN coalesce(p.status, s.status) ELSE s.status END AS status,
        CASE WHEN s.id IS NULL THEN NULL WHEN p.id IS NOT NULL AND NOT bad THEN 'high' ELSE s.priority END AS priority, s.tier AS tier,
        CASE WHEN s.id IS NULL THEN NULL WHEN p.id IS NOT NULL AND NOT bad THEN 60 ELSE 240 END AS crawl_interval_minutes, p.id IS NOT NULL AND (bad OR s.id IS NULL) AS rejected
      FROM sources s FULL JOIN patches p ON s.id = p.id""".replace("\n, patches", ", patches"),
    "g1_system_stats": f"""{AS}SELECT s.*, a.* FROM (SELECT count(*) AS sources, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'degraded') AS degraded, count(*) FILTER (status = 'paused') AS paused FROM sources) s,
      (SELECT count(*) AS articles, count(*) FILTER (r) AS last_24h, count(*) FILTER (r AND is_duplicate) AS duplicates_24h, count(*) FILTER (r AND NOT is_duplicate) AS uniques_24h
       FROM (SELECT *, crawled_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOURS AS r FROM articles)) a""",
    "g2_top_languages": f"{AS}SELECT language, count(*) AS count FROM articles WHERE language IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "g2_top_countries": f"{AS}SELECT country, count(*) AS count FROM articles WHERE country IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "g3_source_totals": f"""{AS}SELECT s.id AS source_id, count(a.id) FILTER (NOT is_duplicate) AS total, count(a.id) FILTER (crawled_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOURS) AS last_24h
      FROM sources s LEFT JOIN articles a ON a.source_id = s.id GROUP BY 1""",
    "g4_health_stats": f"""{S}SELECT count(*) AS total, {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in listings.STATUSES)},
      count(*) FILTER (last_error_type = 'extract_empty' AND status IN ('active', 'degraded')) AS needs_repair FROM sources""",
    "g5_health_matrix": f"""{S}SELECT coalesce(country, 'Unknown') AS country, count(*) AS total, {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in listings.STATUSES)} FROM sources GROUP BY 1""",
    "g6_daily_crawl_report": f"{L}SELECT CAST(started_at AS DATE) AS day, count(*) AS crawls, CAST(sum(articles_new) AS BIGINT) AS new, round(avg(response_time_ms), 4) AS avg_ms FROM crawl_logs GROUP BY 1",
    "g7_success_rate": f"""{LS}SELECT s.id AS source_id, coalesce(r.rate, 0) AS success_rate FROM sources s LEFT JOIN (SELECT source_id, round(avg(CASE WHEN status = 'success' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 2) AS rate
      FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) AS rank FROM crawl_logs WHERE source_id % 4 <> 1) WHERE rank <= 10 GROUP BY 1) r ON r.source_id = s.id""",
    "g8_publish_profile": f"""{AS.rstrip()}, {_PROFILE}
      SELECT source_id, total, array_to_string(h, ',') AS hours, array_to_string(w, ',') AS weekdays, array_to_string({_TOP('h', 24)}, ',') AS top_hours, array_to_string({_TOP('w', 7)}, ',') AS top_weekdays,
        round(CASE WHEN total - w[6] - w[7] > 0 THEN (w[6] + w[7])::DOUBLE / (total - w[6] - w[7]) ELSE 0 END, 6) AS weekend_ratio,
        round(CASE WHEN total - w[6] - w[7] > 0 THEN (w[6] + w[7])::DOUBLE / ((total - w[6] - w[7]) * 2::DOUBLE / 5) ELSE 0 END, 6) AS weekend_ratio_per_day, round(total::DOUBLE / 30, 6) AS avg_articles_per_day FROM profile""",
    "g9_mine_links": f"{LINKS.rstrip()}, {_MINED} SELECT domain, mentions, CAST(articles AS INT) AS articles, first_article FROM mined",
    "g9_mining_stats": f"{LINKS}SELECT count(*) AS links, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS dropped, count(DISTINCT domain) FILTER (kept) AS domains FROM {_JUDGED('2024-01-07', '')}",
    "g10_merge_candidates": f"""{LINKS.rstrip()}, {_MINED}, {_OLD}, new AS (SELECT * FROM mined WHERE domain NOT IN (SELECT domain FROM old WHERE length(domain) % 5 = 0))
      SELECT coalesce(o.domain, n.domain) AS domain, CASE WHEN o.domain IS NULL THEN n.mentions WHEN n.domain IS NULL THEN o.mention_count ELSE o.mention_count + 1 END AS mention_count,
        CAST(len(list_distinct(list_concat(coalesce(o.ids, []), coalesce(n.ids, [])))) AS INT) AS articles, CASE WHEN n.domain IS NULL THEN TIMESTAMP '2024-01-06' ELSE TIMESTAMP '{NOW}' END AS last_seen_at,
        CASE WHEN n.domain IS NOT NULL AND o.country IS NULL AND coalesce(o.mention_count + 1, n.mentions) >= 5 THEN 'pending_analysis' ELSE 'new' END AS status
      FROM old o FULL JOIN new n ON o.domain = n.domain""",
    "j3_candidate_exclusion": f"""{LINKS.rstrip()}, {_MINED} SELECT domain, mentions FROM mined WHERE domain NOT IN (SELECT {HOST} FROM pages WHERE page_id % 3 = 0)""",
    "t1_due_sources": f"""{S}SELECT id, priority, next_crawl_at FROM sources WHERE status IN ('active', 'degraded') AND next_crawl_at <= TIMESTAMP '{LATER}'
      ORDER BY CASE priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, next_crawl_at, id LIMIT 20""",
    "t2_needs_repair": f"{S}SELECT id, consecutive_errors FROM sources WHERE last_error_type = 'extract_empty' AND status IN ('active', 'degraded')",
    "t3_pending_candidates": f"{LINKS.rstrip()}, {_OLD} SELECT domain, mention_count FROM old WHERE mention_count >= 5 AND country IS NULL ORDER BY mention_count DESC, domain LIMIT 20",
    "t4_list_candidates": f"{LINKS.rstrip()}, {_OLD} SELECT domain, mention_count FROM old ORDER BY mention_count DESC, domain LIMIT 20",
    "t5_recent_logs": f"""{L}SELECT source_id, id, CAST(rank AS INT) AS rank
      FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) AS rank FROM crawl_logs) WHERE rank <= 5""",
    "t6_t7_next_interval": f"""{L}SELECT id, rate, CAST(CASE WHEN rate > 0.5 THEN 62 WHEN rate > 0.1 THEN 90 WHEN rate > 0 THEN 135 ELSE 180 END AS INT) AS minutes
      FROM (SELECT id, CASE WHEN articles_found > 0 THEN articles_new::DOUBLE / articles_found ELSE 0 END AS rate FROM crawl_logs)""",
    "t8_next_crawl_at": f"{S}SELECT id, last_crawl_at + to_minutes(240 * (1 << least(consecutive_errors, 10))) AS next_crawl_at FROM sources",
    "t9_frequency": f"""{_LR}, {_FOLD.format(where="WHERE status = 'success'")},
      states(source_id, rn, minutes, average, n) AS (SELECT DISTINCT source_id, 0::BIGINT, 240, 0::DOUBLE, 0 FROM ordered UNION ALL
        SELECT o.source_id, o.rn, CAST(CASE WHEN r > 0.5 THEN greatest(30, trunc(s.minutes * 0.7::DOUBLE)) WHEN r > 0.1 THEN s.minutes WHEN r > 0 THEN least(1440, trunc(s.minutes * 1.5::DOUBLE)) ELSE least(1440, s.minutes * 2) END AS INT),
          CASE WHEN s.n <= 1 THEN o.articles_new::DOUBLE ELSE 0.3::DOUBLE * o.articles_new + 0.7::DOUBLE * s.average END, s.n + 1
        FROM states s JOIN (SELECT *, CASE WHEN articles_found > 0 THEN articles_new::DOUBLE / articles_found ELSE 0 END AS r FROM ordered) o ON o.source_id = s.source_id AND o.rn = s.rn + 1)
      SELECT source_id, minutes AS interval_minutes, round(average, 6) AS average_new, n AS crawl_count FROM states QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY rn DESC) = 1""",
    "t10_health": f"""{_LR}, {_FOLD.format(where="")},
      states(source_id, rn, status, errors, idle, degraded_at, paused_at) AS (SELECT DISTINCT source_id, 0::BIGINT, 'active', 0, 0, NULL::TIMESTAMP, NULL::TIMESTAMP FROM ordered UNION ALL
        SELECT o.source_id, o.rn, CASE WHEN o.status = 'success' THEN 'active' WHEN s.errors >= 14 AND s.status = 'degraded' THEN 'paused' WHEN s.errors >= 4 AND s.status = 'active' THEN 'degraded' ELSE s.status END,
          CASE WHEN o.status = 'success' THEN 0 ELSE s.errors + 1 END, CASE WHEN o.status = 'success' AND o.articles_new > 0 THEN 0 ELSE s.idle + 1 END,
          CASE WHEN o.status <> 'success' AND s.errors >= 4 AND s.status = 'active' THEN o.started_at ELSE s.degraded_at END,
          CASE WHEN o.status <> 'success' AND s.errors >= 14 AND s.status = 'degraded' THEN o.started_at ELSE s.paused_at END
        FROM states s JOIN ordered o ON o.source_id = s.source_id AND o.rn = s.rn + 1)
      SELECT source_id, status, errors AS consecutive_errors, idle AS days_without_new, degraded_at, paused_at FROM states QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY rn DESC) = 1""",
    "t11_daily_health_rules": f"""{S}SELECT id, CASE WHEN status IN ('active', 'degraded') AND days_without_new >= 90 THEN 'archived' ELSE status END AS status,
      CASE WHEN status = 'active' AND days_without_new >= 30 THEN 'low' ELSE priority END AS priority,
      CASE WHEN status IN ('active', 'degraded') AND days_without_new >= 90 THEN 'archived' WHEN status = 'active' AND days_without_new >= 30 THEN 'priority_low' END AS changed FROM sources""",
    "t12_restore_paused": f"""{S}SELECT id, CASE WHEN b THEN 'active' ELSE status END AS status, CASE WHEN b THEN 'medium' ELSE priority END AS priority, CASE WHEN b THEN 0 ELSE consecutive_errors END AS consecutive_errors
      FROM (SELECT *, status = 'paused' AND id % 3 <> 0 AND id * 10 > 500 AS b FROM sources)""",
    "t13_t14_profile_decisions": f"""{AS.rstrip()}, {_PROFILE}, asked AS (SELECT *, h[source_id % 24 + 1] AS now, (source_id % 7) >= 5 AND total - w[6] - w[7] > 0 AND (w[6] + w[7]) / ((total - w[6] - w[7]) * 2::DOUBLE / 5) < 0.3 AS quiet,
        {_TOP('h', 24)} AS top, source_id % 24 AS hour FROM profile WHERE source_id IS NOT NULL)
      SELECT source_id, now > 0 AND now::DOUBLE / total >= 0.02 AND NOT quiet AS crawl,
        CASE WHEN now = 0 THEN 'low_activity_hour' WHEN now::DOUBLE / total < 0.02 THEN 'very_low_activity_hour' WHEN quiet THEN 'low_weekend_activity' ELSE 'normal_activity' END AS reason,
        CAST(CASE WHEN now > 0 AND list_contains(top, hour) THEN 120 WHEN now::DOUBLE / total < 0.02 THEN 480 ELSE 240 END AS INT) AS minutes FROM asked""",
    "t15_approve_candidates": f"""{LINKS.rstrip()}, {_OLD}, numbered AS (SELECT domain, (SELECT max(id) FROM sources) + row_number() OVER (ORDER BY domain) AS id FROM old WHERE length(domain) % 4 = 0)
      SELECT o.domain, CASE WHEN n.id IS NOT NULL THEN 'approved' WHEN length(o.domain) % 2 = 0 THEN 'rejected' ELSE 'new' END AS status, n.id AS approved_source_id,
        CASE WHEN n.id IS NOT NULL THEN coalesce(o.country, 'US') END AS country, CASE WHEN n.id IS NOT NULL THEN 'fr' END AS language, CASE WHEN n.id IS NOT NULL THEN 'medium' END AS priority
      FROM old o LEFT JOIN numbered n USING (domain)""",
    "t17_classify_crawl_error": f"""{L}SELECT id, CASE WHEN status = 'error' THEN ['http_error', 'timeout', 'unknown'][id % 3 + 1] WHEN articles_found % 10 = 0 THEN 'extract_empty' END AS kind FROM crawl_logs""",
}
