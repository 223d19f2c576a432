"""Queries of the event family over the news view, with DuckDB counterparts."""

from __future__ import annotations

from marlstone.operators import news as ops
from marlstone.sources.adapters import NEWS, news, with_views

NOW, HOT_NOW = 1704067200 + 30 * 86400, 1704067200 + 100_000

QUERIES = {
    "event_board": lambda s, d: ops.event_board(news(s, d), NOW),
    "event_children": lambda s, d: ops.children_list(news(s, d)),
    "hot_tags": lambda s, d: ops.hot_tags(news(s, d), HOT_NOW),
    "source_quality": lambda s, d: ops.source_quality(news(s, d)),
    "distinct_urls": lambda s, d: ops.distinct_urls(news(s, d)),
}

ORACLES = {
    "event_board": with_views(NEWS, sql=f""",
g AS (SELECT coalesce(related_to_id, id) AS root, count(*) AS n_articles, count(DISTINCT source) AS n_sources, max(CASE WHEN id != coalesce(related_to_id, id) THEN published END) AS child FROM news GROUP BY ALL),
j AS (SELECT id, title, ai_score, n_articles, n_sources, greatest(published, child) AS fresh FROM news JOIN g ON id = root WHERE related_to_id IS NULL)
SELECT id, title, n_articles, n_sources, fresh, round(greatest(greatest(ai_score, 0e0) + least(n_sources * 0.5e0, 2e0) - 1, 0e0)
  / pow(greatest(({NOW} - fresh) / 3600.0e0, 0e0) + 2, CASE WHEN n_articles > 1 THEN 1.2e0 ELSE 1.8e0 END), 4) AS rank FROM j"""),
    "event_children": with_views(NEWS, sql="""
SELECT related_to_id AS id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY published DESC, id DESC) AS children FROM news WHERE related_to_id IS NOT NULL AND related_to_id != id GROUP BY ALL"""),
    "hot_tags": with_views(NEWS, sql=f", t AS (SELECT unnest(tags) AS tag FROM news WHERE ai_score >= 7 AND published BETWEEN {HOT_NOW} - 86400 AND {HOT_NOW}) SELECT tag, count(*) AS n FROM t GROUP BY tag ORDER BY n DESC, tag LIMIT 8"),
    "source_quality": with_views(NEWS, sql=""",
q AS (SELECT source, count(*) AS samples, round(avg(ai_score), 6) AS mean_score, round(count(CASE WHEN ai_score >= 5 THEN 1 END) / count(*), 6) AS pass_rate, round(count(CASE WHEN ai_score >= 6 THEN 1 END) / count(*), 6) AS display_rate,
  round(count(CASE WHEN is_highlight THEN 1 END) / count(*), 6) AS highlight_rate, round(count(related_to_id) / count(*), 6) AS duplicate_rate FROM news GROUP BY source)
SELECT *, CASE WHEN display_rate < 0.03 AND samples >= 200 THEN 'D' WHEN display_rate < 0.1 THEN 'C' WHEN display_rate >= 0.3 THEN 'A' ELSE 'B' END AS tier FROM q"""),
    "distinct_urls": with_views(NEWS, sql=""",
b AS (SELECT id, regexp_replace(trim(url), '#.*$', '') AS u FROM news),
p AS (SELECT id, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1) AS site, regexp_replace(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?]*)?([^?]*)', 1), ';[^/]*$', '') AS path,
  array_to_string(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: NOT regexp_matches(x, '^(utm_|feed_item)')), '&') AS kept FROM b),
n AS (SELECT id, site || CASE WHEN path = '/' THEN path ELSE regexp_replace(path, '/+$', '') END || CASE WHEN coalesce(kept, '') = '' THEN '' ELSE '?' || kept END AS url FROM p)
SELECT url, min(id) AS id, count(*) AS n, sha256(url) AS url_hash FROM n GROUP BY url"""),
}
