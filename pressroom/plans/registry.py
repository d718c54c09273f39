"""All registered queries of the library and their SQL."""

from __future__ import annotations

from pressroom.plans import articles, dedup, sources

QUERIES = {**articles.QUERIES, **dedup.QUERIES, **sources.QUERIES}
ORACLE_SQL = {**articles.ORACLE_SQL, **dedup.ORACLE_SQL, **sources.ORACLE_SQL}
# The stream's states are those of the batch folds.
_HEALTH, _FREQUENCY = sources.ORACLE_SQL["t10_health"], sources.ORACLE_SQL["t9_frequency"]
ORACLE_SQL["x2_stream_exact_url"] = dedup.ORACLE_SQL["d1_exact_url"]
ORACLE_SQL["x2_stream_within_watermark"] = f"SELECT DISTINCT url_hash FROM ({dedup.ORACLE_SQL['f2_url_hash']})"
ORACLE_SQL["x4_stream_states"] = f"""SELECT source_id, status, consecutive_errors, days_without_new, coalesce(interval_minutes, 240) AS interval_minutes, coalesce(average_new, 0) AS average_new,
  coalesce(crawl_count, 0) AS crawl_count FROM ({_HEALTH}) LEFT JOIN ({_FREQUENCY}) USING (source_id)"""
ORACLE_SQL["x3_stream_cascade"] = dedup.ORACLE_SQL["d5_cascade"]
