"""Scans, filters, joins, roll-ups and windows over the canonical relations, written once for both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import features as fx
from marlstone.operators import ledger
from marlstone.operators.pairs import closest_titles, similar_vectors
from marlstone.plans.dialect import both, spark_query
from marlstone.plans.news import HOT_NOW
from marlstone.session import settle
from marlstone.sources.adapters import every_quote, trades, vectors

NOW = HOT_NOW
#: Cosines from which on an event is like another, and from which on it is the same.
LOW, HIGH = 0.1, 0.9
#: Articles told of an event, newest ones always among them.
ARTICLES, RECENT = 8, 2
#: Fixed value: seconds after which the age of an article counts. Sources of quick news, whose old articles are not scored.
OLD, QUICK = 86400, ("src2", "src12")
#: Fixed values of the hot topics: seconds, least score, events, titles of articles under one.
HOT_SECONDS, HOT_LEAST, HOT_MOST, HOT_TITLES = 86400, 5, 10, 6
#: Money at the start, loss in per cent that stops trading.
CAPITAL, BREAK = "1e10", -15
RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn FROM quotes)"
ROOTS = "roots AS (SELECT *, coalesce(related_to_id, id) AS root FROM news)"

FOUND = {
    # scans
    "latest_day_scan": (lambda d: "SELECT code, trade_date, CAST(close AS DOUBLE) AS close, volume FROM quotes WHERE trade_date = (SELECT max(trade_date) FROM quotes)", "quotes"),
    "table_reload": (lambda d: "SELECT code, trade_date, CAST(close AS DOUBLE) AS close FROM quotes WHERE trade_date >= DATE '2001-06-01'", "quotes"),
    # filters
    "bad_names": (
        lambda d: """
WITH days AS (SELECT trade_date, count(DISTINCT code) AS n FROM quotes GROUP BY trade_date),
full_day AS (SELECT max(trade_date) AS day FROM days WHERE n >= 3)
SELECT q.code, q.name, q.name LIKE '%ST%' AS bad FROM quotes q JOIN full_day ON q.trade_date = full_day.day""",
        "quotes",
    ),
    "complete_day_names": (
        lambda d: """
WITH days AS (SELECT trade_date, count(DISTINCT code) AS n FROM quotes WHERE name IS NOT NULL AND name != '' GROUP BY trade_date), pick AS (SELECT max(trade_date) AS day FROM days WHERE n >= 2)
SELECT q.code, max(q.name) AS name FROM quotes q JOIN pick ON q.trade_date = pick.day GROUP BY q.code""",
        "quotes",
    ),
    "clean_quotes": (lambda d: "SELECT market, count(*) AS n_rows, CAST(sum(volume) AS BIGINT) AS volume FROM (SELECT DISTINCT code, trade_date, open, high, low, close, volume, market FROM quotes WHERE volume > 0) AS q GROUP BY market", "quotes"),
    "sanity_check": (
        lambda d: """
WITH c AS (SELECT code, trade_date, open, high, low, close, volume, (CAST(close AS DOUBLE) / lag(CAST(close AS DOUBLE)) OVER (PARTITION BY code ORDER BY trade_date) - 1) * 100 AS pct FROM quotes),
m AS (SELECT *, CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL THEN 'missing' WHEN least(open, high, low, close) <= 0.001 THEN 'price' WHEN low > high THEN 'range'
  WHEN CAST(close AS DOUBLE) < CAST(low AS DOUBLE) * 0.999 OR CAST(close AS DOUBLE) > CAST(high AS DOUBLE) * 1.001 THEN 'close' WHEN abs(pct) > 50 THEN 'change' WHEN volume < 0 THEN 'volume' ELSE 'ok' END AS reason FROM c)
SELECT code, reason, count(*) AS n FROM m GROUP BY code, reason""",
        "quotes",
    ),
    "stale_series": (
        lambda d: """
WITH w AS (SELECT code, CASE WHEN count(*) OVER v = 5 THEN min(close) OVER v = max(close) OVER v END AS same FROM quotes WINDOW v AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT code, coalesce(max(CASE WHEN same THEN 1 ELSE 0 END), 0) = 1 AS stale FROM w GROUP BY code""",
        "quotes",
    ),
    "cross_source_check": (
        lambda d: """
WITH a AS (SELECT code, trade_date, CAST(close AS DOUBLE) AS x FROM quotes WHERE code % 2 = 0), b AS (SELECT code, trade_date, (CAST(high AS DOUBLE) + CAST(low AS DOUBLE)) / 2 AS y FROM quotes),
m AS (SELECT a.code, abs(x - y) / y <= 0.02 AS same FROM a JOIN b ON a.code = b.code AND a.trade_date = b.trade_date WHERE y > 0)
SELECT code, count(*) AS n, round(count(CASE WHEN same THEN 1 END) * 1e0 / count(*), 6) AS match_rate, count(CASE WHEN same THEN 1 END) * 1e0 / count(*) < 0.7 AS alert FROM m GROUP BY code""",
        "quotes",
    ),
    "sector_news": (lambda d: f"SELECT id, source FROM news WHERE {d.has('tags', chr(39) + 'topic3' + chr(39))}", "news"),
    "any_concept": (lambda d: f"SELECT id FROM news WHERE {d.join('tags', ',')} LIKE '%topic2%' OR {d.join('tags', ',')} LIKE '%topic5%'", "news"),
    "not_st_or_unnamed": (lambda d: "SELECT code, count(*) AS n FROM quotes WHERE name NOT LIKE '%ST%' OR name IS NULL GROUP BY code", "quotes"),
    "keyword_search": (lambda d: f"SELECT code, max(name) AS name FROM quotes WHERE CAST(code AS {d.string}) ILIKE '%1%' OR name ILIKE '%plier#%09%' GROUP BY code ORDER BY code LIMIT 20", "quotes"),
    "fresh_roots": (
        lambda d: f"SELECT id, title FROM news WHERE related_to_id IS NULL AND (published >= {NOW} - 14400 OR id IN (SELECT related_to_id FROM news WHERE related_to_id IS NOT NULL AND published >= {NOW} - 14400))",
        "news",
    ),
    "local_day_half_open": (lambda d: "SELECT id FROM news WHERE published >= 1704067200 + 86400 - 28800 - 50400 AND published < 1704067200 + 86400 - 28800 AND ai_score >= 5", "news"),
    "local_day_closed": (lambda d: "SELECT id FROM news WHERE published >= 1704067200 - 28800 AND published <= 1704067200 - 28800 + 86399.999999", "news"),
    "date_fallback": (lambda d: "SELECT code, max(trade_date) AS trade_date FROM quotes WHERE trade_date <= DATE '2001-05-05' GROUP BY code", "quotes"),
    "readiness_gate": (
        lambda d: """
WITH l AS (SELECT market, max(trade_date) AS last FROM quotes GROUP BY market)
SELECT l.market, l.last, count(DISTINCT q.code) AS n_codes, l.last = DATE '2001-08-01' AND count(DISTINCT q.code) >= 5 AS ready FROM l JOIN quotes q ON q.market = l.market AND q.trade_date = l.last GROUP BY l.market, l.last""",
        "quotes",
    ),
    "title_predrop": (lambda d: f"SELECT id, length(title) >= 4 AND NOT {d.rx('lower(title)', 'sponsored|subscribe|webinar|podcast|buy now')} AS kept FROM news", "news"),
    "staleness_filter": (lambda d: f"SELECT id FROM news WHERE published IS NULL OR published >= {NOW} - 7 * 86400", "news"),
    "age_gate": (
        lambda d: f"""
WITH r AS (SELECT n.*, coalesce(n.title, '') || ' ' || coalesce(n.content, '') AS body, coalesce(p.title, '') || ' ' || coalesce(p.content, '') AS root_body FROM news n LEFT JOIN news p ON p.id = n.related_to_id)
SELECT id, CASE WHEN published IS NULL OR {NOW} - published <= {OLD} THEN 'young' WHEN {fx.official(d, "source", "url")} THEN 'official' WHEN related_to_id IS NOT NULL AND {fx.news_beside(d, "body", "root_body")} THEN 'new_fact'
  WHEN lower(source) IN ({", ".join(map(d.lit, QUICK))}) THEN 'drop' ELSE 'keep' END AS gate FROM r""",
        "news",
    ),
    "noise_tags": (lambda d: f"SELECT id FROM news WHERE NOT ({d.has('tags', chr(39) + 'topic0' + chr(39))} AND ai_score <= 4)", "news"),
    "own_source_tags": (lambda d: f"SELECT id, {d.join(d.filter('tags', 't', 't != source'), ',')} AS tags FROM news", "news"),
    "mirror_column": (lambda d: "SELECT n.id, coalesce(e.status, n.status, 'new') AS status FROM news n LEFT JOIN (SELECT id, CASE WHEN is_highlight THEN status END AS status FROM news) AS e ON e.id = n.related_to_id", "news"),
    "trade_filters": (
        lambda d: """
SELECT market, count(*) AS n_all, count(CASE WHEN status = 'open' THEN 1 END) AS n_open, count(CASE WHEN status = 'closed' THEN 1 END) AS n_closed, count(CASE WHEN pnl_pct > 0 THEN 1 END) AS n_win, count(CASE WHEN pnl_pct < 0 THEN 1 END) AS n_loss,
  count(CASE WHEN NOT followed_rule THEN 1 END) AS n_violation FROM closed_trades GROUP BY market""",
        "closed_trades",
    ),
    "page_with_total": (lambda d: "SELECT id, ai_score, (SELECT count(*) FROM news WHERE ai_score >= 3) AS total FROM news WHERE ai_score >= 3 ORDER BY ai_score DESC, id DESC LIMIT 20 OFFSET 40", "news"),
    # joins
    "trades_with_quotes": (lambda d: "SELECT t.trade_id, CAST(q.close AS DOUBLE) AS close, CAST(t.price AS DOUBLE) AS price FROM trades t LEFT JOIN every_quote q ON q.code = t.code AND q.trade_date = t.trade_date", "trades", "every_quote"),
    "roots_with_events": (lambda d: "SELECT n.id, e.id AS event_id, e.status FROM news n LEFT JOIN (SELECT id, status FROM news WHERE is_highlight) AS e ON e.id = n.id WHERE n.related_to_id IS NULL", "news"),
    "roots_with_children": (lambda d: "SELECT id FROM news n LEFT SEMI JOIN (SELECT DISTINCT related_to_id FROM news WHERE related_to_id IS NOT NULL) AS c ON c.related_to_id = n.id" if type(d).__name__ == "SparkSql" else "SELECT id FROM news n SEMI JOIN (SELECT DISTINCT related_to_id FROM news WHERE related_to_id IS NOT NULL) AS c ON c.related_to_id = n.id", "news"),
    "without_bad_names": (lambda d: f"SELECT code, count(*) AS n FROM quotes q {'LEFT ANTI' if type(d).__name__ == 'SparkSql' else 'ANTI'} JOIN (SELECT DISTINCT code FROM quotes WHERE name LIKE '%9') AS b USING (code) GROUP BY code", "quotes"),
    "retention": (
        lambda d: f"""
WITH keep AS (SELECT id FROM news WHERE is_highlight UNION SELECT related_to_id AS id FROM news WHERE related_to_id IS NOT NULL UNION SELECT n.id FROM news n JOIN news p ON p.id = n.related_to_id WHERE p.is_highlight)
SELECT n.id FROM news n {"LEFT ANTI" if type(d).__name__ == "SparkSql" else "ANTI"} JOIN keep USING (id) WHERE n.published < {NOW} - 43200""",
        "news",
    ),
    "nav_at_or_before": (
        lambda d: """
WITH t AS (SELECT trade_date, CAST(sum(CASE WHEN action = 'buy' THEN shares ELSE -shares END) AS BIGINT) AS moved FROM trades GROUP BY trade_date)
SELECT max(trade_date) AS day, CAST(sum(moved) AS BIGINT) AS shares FROM t WHERE trade_date <= DATE '2000-06-15'""",
        "trades",
    ),
    "bounded_as_of": (
        lambda d: f"""
WITH t AS (SELECT trade_id, code, trade_date, {d.unnest(d.array(*map(str, range(6))))} AS back FROM trades), n AS (SELECT trade_id, code, back, trade_date - back AS day FROM t),
m AS (SELECT n.trade_id, min(n.back) AS back FROM n JOIN every_quote q ON q.code = n.code AND q.trade_date = n.day GROUP BY n.trade_id)
SELECT m.trade_id, q.trade_date, CAST(q.close AS DOUBLE) AS close FROM m JOIN n ON n.trade_id = m.trade_id AND n.back = m.back JOIN every_quote q ON q.code = n.code AND q.trade_date = n.day""",
        "trades",
        "every_quote",
    ),
    "latest_trade_by_date": (lambda d: "SELECT t.code, max(t.trade_id) AS trade_id, t.trade_date FROM trades t JOIN (SELECT code, max(trade_date) AS last FROM trades GROUP BY code) AS l ON l.code = t.code AND l.last = t.trade_date GROUP BY t.code, t.trade_date", "trades"),
    "latest_trade_by_id": (lambda d: "SELECT t.code, t.trade_id, CAST(t.price AS DOUBLE) AS price FROM trades t JOIN (SELECT code, max(trade_id) AS last FROM trades GROUP BY code) AS l ON l.last = t.trade_id AND l.code = t.code", "trades"),
    "calendar_fill": (
        lambda d: f"""
WITH b AS (SELECT market, trade_date, count(*) AS n FROM quotes GROUP BY market, trade_date), s AS (SELECT market, min(trade_date) AS first, max(trade_date) AS last FROM b GROUP BY market),
cal AS (SELECT market, {d.days("first", "last")} AS day FROM s),
m AS (SELECT cal.market, cal.day, max(b.trade_date) OVER (PARTITION BY cal.market ORDER BY cal.day ROWS UNBOUNDED PRECEDING) AS source_day FROM cal LEFT JOIN b ON b.market = cal.market AND b.trade_date = cal.day)
SELECT m.day, m.market, m.source_day, b.n, m.day != m.source_day AS copied FROM m JOIN b ON b.market = m.market AND b.trade_date = m.source_day""",
        "quotes",
    ),
    "source_counts": (lambda d: f"WITH {ROOTS}, g AS (SELECT root, count(DISTINCT source) AS n FROM roots GROUP BY root) SELECT n.id, greatest(coalesce(g.n, 0), 1) AS source_count FROM news n LEFT JOIN g ON g.root = n.id WHERE n.related_to_id IS NULL", "news"),
    "event_candidates": (
        lambda d: f"""
WITH fresh AS (SELECT DISTINCT coalesce(related_to_id, id) AS root FROM news WHERE published >= {NOW} - 28800), agg AS (SELECT coalesce(related_to_id, id) AS root, count(*) AS n, max(published) AS last FROM news GROUP BY coalesce(related_to_id, id))
SELECT p.id, agg.n, agg.last, e.id IS NULL OR agg.n > e.id % 3 AS due FROM news p JOIN fresh ON fresh.root = p.id JOIN agg ON agg.root = p.id LEFT JOIN (SELECT id FROM news WHERE is_highlight) AS e ON e.id = p.id WHERE p.related_to_id IS NULL""",
        "news",
    ),
    "code_lookup": (
        lambda d: f"""
WITH a AS (SELECT DISTINCT split_part(CAST(code AS {d.string}) || '.' || market, '.', 1) AS clean, market FROM quotes), t AS (SELECT CAST(code AS {d.string}) AS clean, count(*) AS n FROM trades GROUP BY code)
SELECT a.clean, a.market, coalesce(t.n, 0) AS n_trades FROM a LEFT JOIN t ON t.clean = a.clean""",
        "quotes",
        "trades",
    ),
    "priority_merge": (
        lambda d: """
WITH u AS (SELECT code, 1 AS priority, 'held' AS kind FROM (SELECT code FROM trades GROUP BY code HAVING count(*) % 2 = 0) AS x UNION ALL SELECT code, 2, 'liquid' FROM (SELECT code FROM quotes GROUP BY code HAVING sum(volume) > 12000) AS y UNION ALL SELECT code, 3, 'listed' FROM (SELECT DISTINCT code FROM quotes) AS z),
r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY priority) AS rn FROM u)
SELECT code, kind FROM r WHERE rn = 1""",
        "trades",
        "quotes",
    ),
    "enriched_list": (
        lambda d: """
WITH l AS (SELECT code, max(trade_date) AS last FROM quotes GROUP BY code), n AS (SELECT code, max(name) AS name, max(market) AS market FROM quotes GROUP BY code), v AS (SELECT code, CAST(sum(volume) AS BIGINT) AS volume FROM quotes GROUP BY code), t AS (SELECT code, count(*) AS trades FROM trades GROUP BY code)
SELECT l.code, l.last, n.name, n.market, v.volume, t.trades FROM l LEFT JOIN n ON n.code = l.code LEFT JOIN v ON v.code = l.code LEFT JOIN t ON t.code = l.code""",
        "quotes",
        "trades",
    ),
    "list_difference": (
        lambda d: """
WITH last AS (SELECT max(trade_date) AS day FROM quotes), prev AS (SELECT max(trade_date) AS day FROM quotes WHERE trade_date < (SELECT max(trade_date) FROM quotes))
SELECT code FROM quotes JOIN last ON trade_date = day EXCEPT SELECT code FROM quotes JOIN prev ON trade_date = day""",
        "quotes",
    ),
    "orphan_links": (lambda d: f"SELECT n.id, n.related_to_id FROM news n {'LEFT SEMI' if type(d).__name__ == 'SparkSql' else 'SEMI'} JOIN (SELECT id FROM news WHERE related_to_id IS NULL) AS e ON e.id = n.related_to_id", "news"),
    "band_join": (
        lambda d: f"""
WITH t AS (SELECT id, source, published, related_to_id, {d.shingles("lower(title)", 3)} AS g, CAST(floor(published / 21600) AS BIGINT) AS slot FROM news WHERE length(title) > 0 AND published > {NOW} - 72 * 3600),
o AS (SELECT *, {d.unnest(d.array("slot", "slot + 1"))} AS near FROM t),
p AS (SELECT b.id AS newer, a.id AS older, {d.common("a.g", "b.g")} * 1e0 / ({d.size("a.g")} + {d.size("b.g")} - {d.common("a.g", "b.g")}) AS sim FROM o a JOIN t b ON a.near = b.slot AND a.source != b.source AND a.published < b.published AND b.published - a.published < 21600 WHERE b.related_to_id IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY newer ORDER BY sim DESC, older) AS rn FROM p WHERE sim > 0.5)
SELECT newer, older, round(sim, 6) AS sim FROM r WHERE rn = 1""",
        "news",
    ),
    # roll-ups
    "hot_topics": (
        lambda d: f"""
WITH {ROOTS}, c AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY published, id) AS rn FROM roots WHERE related_to_id IS NOT NULL AND related_to_id != id),
t AS (SELECT root, {d.gather("title", "rn")} AS child_titles FROM c WHERE rn <= {HOT_TITLES} GROUP BY root), u AS (SELECT root, {d.gather("source", "source")} AS child_sources FROM (SELECT DISTINCT root, source FROM c) AS x GROUP BY root),
k AS (SELECT root, count(*) AS children FROM c GROUP BY root), s AS (SELECT root, count(DISTINCT source) AS source_count FROM roots GROUP BY root)
SELECT p.id, p.title, p.ai_score, s.source_count, k.children, u.child_sources, t.child_titles FROM news p JOIN k ON k.root = p.id JOIN s ON s.root = p.id JOIN t ON t.root = p.id JOIN u ON u.root = p.id
WHERE p.related_to_id IS NULL AND p.ai_score >= {HOT_LEAST} AND p.published >= {NOW} - {HOT_SECONDS} ORDER BY s.source_count DESC, p.ai_score DESC, p.published DESC, p.id LIMIT {HOT_MOST}""",
        "news",
    ),
    "event_sources": (lambda d: f"WITH {ROOTS}, u AS (SELECT DISTINCT root, source FROM roots), k AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY source) AS rn FROM u) SELECT root AS id, {d.gather('source', 'source')} AS sources FROM k WHERE rn <= 5 GROUP BY root", "news"),
    "title_suggestions": (
        lambda d: f"WITH w AS (SELECT {d.unnest(d.every('lower(title)', '[a-z]+'))} AS word FROM news) SELECT DISTINCT word FROM w WHERE word LIKE 'th%' AND length(word) >= 4 ORDER BY word LIMIT 5",
        "news",
    ),
    "filter_counts": (lambda d: "SELECT count(*) FILTER (WHERE status = 'new') AS n_new, count(*) FILTER (WHERE status = 'developing') AS n_developing, count(*) FILTER (WHERE status = 'stable') AS n_stable FROM news", "news"),
    "stock_rollup": (
        lambda d: """
WITH t AS (SELECT code, CAST(sum(CASE WHEN action = 'buy' THEN shares ELSE -shares END) AS BIGINT) AS net, count(*) AS n, max(trade_date) AS last FROM trades GROUP BY code),
c AS (SELECT code, CAST(close AS DOUBLE) AS close, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn FROM every_quote), v AS (SELECT t.*, CASE WHEN net > 0 THEN net * close ELSE 0e0 END AS worth FROM t LEFT JOIN c ON c.code = t.code AND rn = 1),
s AS (SELECT sum(worth) AS total FROM v)
SELECT code, net, n, last, round(coalesce(worth, 0) * 100 / s.total, 4) AS position_pct, CASE WHEN net > 0 THEN 'holding' ELSE 'watching' END AS status FROM v CROSS JOIN s""",
        "trades",
        "every_quote",
    ),
    "account_state": (
        lambda d: f"""
WITH l AS (SELECT code, trade_date, CAST(close AS DECIMAL(18,2)) AS close, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn FROM every_quote),
t AS (SELECT c.market, c.status, t.shares * t.price AS amount, CASE WHEN c.status = 'closed' THEN t.shares * t.price * CAST(coalesce(c.pnl_pct, 0e0) AS DECIMAL(6,1)) / 100 END AS pnl, t.shares * coalesce(l.close, t.price) AS worth
  FROM closed_trades c JOIN trades t ON t.trade_id = c.trade_id LEFT JOIN l ON l.code = t.code AND l.rn = 1),
s AS (SELECT market, CAST(coalesce(sum(CASE WHEN status = 'open' THEN amount END), 0) AS DOUBLE) AS held, CAST(coalesce(sum(pnl), 0) AS DOUBLE) AS pnl, CAST(coalesce(sum(CASE WHEN status = 'open' THEN worth END), 0) AS DOUBLE) AS worth FROM t GROUP BY market),
v AS (SELECT market, {CAPITAL} - held + pnl AS cash, worth AS holdings, pnl AS realized, {CAPITAL} - held + pnl + worth AS total FROM s)
SELECT market, round(cash, 2) AS cash, round(holdings, 2) AS holdings, round(realized, 2) AS realized_pnl, round(total, 2) AS total, round((total - {CAPITAL}) / {CAPITAL} * 100, 4) AS total_pnl_pct, (total - {CAPITAL}) / {CAPITAL} * 100 <= {BREAK} AS breaker FROM v""",
        "closed_trades",
        "trades",
        "every_quote",
    ),
    "account_defaults": (lambda d: f"WITH m AS (SELECT {d.unnest(d.array(*(chr(39) + x + chr(39) for x in ('CN', 'HK', 'US', 'JP'))))} AS market), a AS (SELECT market, count(*) AS n FROM closed_trades GROUP BY market) SELECT m.market, coalesce(a.n, 0) AS n_trades, CASE WHEN a.market IS NULL THEN 100000e0 ELSE 10000e0 END AS capital FROM m LEFT JOIN a ON a.market = m.market", "closed_trades"),
    "mean_session": (lambda d: "SELECT started, round(sum(CASE WHEN kind = 'click' THEN value END) / count(CASE WHEN kind = 'view' THEN 1 END), 4) AS mean_value FROM runs GROUP BY started", "runs"),
    "run_stats": (lambda d: "SELECT kind, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(count(CASE WHEN value >= 50 THEN 1 END) * 100e0 / count(*), 4) AS retention FROM runs GROUP BY kind", "runs"),
    "json_map_sums": (
        lambda d: "WITH m AS (SELECT kind, explode(from_json(props, 'map<string,bigint>')) AS (k, v) FROM runs) SELECT kind, k, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM m GROUP BY kind, k"
        if type(d).__name__ == "SparkSql"
        else "WITH j AS (SELECT kind, props, unnest(json_keys(props)) AS k FROM runs), m AS (SELECT kind, k, CAST(json_extract_string(props, '$.' || k) AS BIGINT) AS v FROM j) SELECT kind, k, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM m GROUP BY kind, k",
        "runs",
    ),
    "usage_rollup": (lambda d: "SELECT coalesce(metric, 'all') AS scene, CAST(sum(value) AS BIGINT) AS total FROM usage GROUP BY ROLLUP (metric)", "usage"),
    "user_stats": (lambda d: "SELECT date, count(DISTINCT dimension) AS users, CAST(sum(CASE WHEN metric = 'view' THEN value ELSE 0 END) AS BIGINT) AS views, CAST(sum(CASE WHEN metric = 'click' THEN value ELSE 0 END) AS BIGINT) AS clicks FROM usage GROUP BY date", "usage"),
    "ordered_children": (lambda d: f"SELECT related_to_id AS id, {d.gather('id', '-(ai_score * 1000000000 - id)')} AS children FROM news WHERE related_to_id IS NOT NULL GROUP BY related_to_id", "news"),
    "outcome_mode": (
        lambda d: """
WITH c AS (SELECT source, status, count(*) AS n FROM news WHERE status IN ('stable', 'resolved') GROUP BY source, status), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, status) AS rn FROM c)
SELECT source, CASE WHEN n >= 2 THEN status END AS pattern FROM r WHERE rn = 1""",
        "news",
    ),
    "drop_reasons": (lambda d: "WITH m AS (SELECT CASE WHEN length(title) < 20 THEN 'short(' || length(title) || ')' WHEN ai_score < 3 THEN 'score(' || CAST(floor(ai_score) AS INT) || ')' ELSE 'none' END AS reason FROM news) SELECT split_part(reason, '(', 1) AS rule, count(*) AS n FROM m GROUP BY split_part(reason, '(', 1)", "news"),
    "score_counters": (lambda d: "SELECT CAST(floor(ai_score) AS INT) AS score, count(*) AS n, count(CASE WHEN ai_score >= 5 THEN 1 END) AS passed FROM news GROUP BY CAST(floor(ai_score) AS INT)", "news"),
    "filter_options": (lambda d: f"WITH t AS (SELECT DISTINCT trim(tag) AS concept FROM (SELECT {d.unnest('tags')} AS tag FROM news) AS u) SELECT concept, concept LIKE 'topic%' AS topical FROM t WHERE concept != ''", "news"),
    "source_census": (lambda d: "SELECT source, count(*) AS n, min(published) AS oldest FROM news GROUP BY source ORDER BY n DESC, source", "news"),
    "prompt_context": (lambda d: "SELECT id, title, ai_score FROM news WHERE published >= 1704067200 - 28800 AND published < 1704067200 + 57600 ORDER BY ai_score DESC, published DESC LIMIT 66", "news"),
    "digest_candidates": (lambda d: f"WITH c AS (SELECT id, ai_score, published, status FROM news WHERE related_to_id IS NULL ORDER BY ai_score DESC, published DESC LIMIT 60) SELECT id, ai_score FROM c WHERE status != 'resolved' AND published >= {NOW} - 86400 ORDER BY ai_score DESC, published DESC LIMIT 20", "news"),
    "article_selection": (
        lambda d: f"""
WITH {ROOTS}, r AS (SELECT root, id, published, row_number() OVER (PARTITION BY root ORDER BY published DESC, id DESC) AS newest, row_number() OVER (PARTITION BY root ORDER BY ai_score DESC, published DESC, id DESC) AS best FROM roots),
k AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY CASE WHEN newest <= {RECENT} THEN 0 ELSE 1 END, best) AS pick FROM r)
SELECT root AS id, {d.gather("id", "published")} AS articles FROM k WHERE pick <= {ARTICLES} GROUP BY root""",
        "news",
    ),
    # windows
    "one_series_rows": (lambda d: "SELECT trade_date, rn, CAST(close AS DOUBLE) AS close FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn FROM quotes WHERE code = 3) AS q WHERE rn <= 250", "quotes"),
    "forward_returns": (
        lambda d: "SELECT code, trade_date, " + ", ".join(f"round(CAST(lead(close, {n}) OVER (PARTITION BY code ORDER BY trade_date) AS DOUBLE) / CAST(close AS DOUBLE) - 1, 8) AS r{n}" for n in (5, 10, 20, 60)) + " FROM quotes WHERE market = 'ASIA'",
        "quotes",
    ),
    "backtest_summary": (
        lambda d: f"""
WITH f AS (SELECT market, CAST(lead(close, 20) OVER (PARTITION BY code ORDER BY trade_date) AS DOUBLE) / CAST(close AS DOUBLE) - 1 AS r FROM quotes)
SELECT market, count(r) AS n, round(median(r), 8) AS median, round(avg(r), 8) AS mean, round(count(CASE WHEN r > 0 THEN 1 END) * 100e0 / count(r), 4) AS win_pct FROM f GROUP BY market""",
        "quotes",
    ),
    "volume_segments": (
        lambda d: f"""
WITH {RANKED}, s AS (SELECT code, stddev_samp(CASE WHEN rn <= 20 THEN CAST(close AS DOUBLE) END) AS s1, stddev_samp(CASE WHEN rn BETWEEN 21 AND 40 THEN CAST(close AS DOUBLE) END) AS s2, stddev_samp(CASE WHEN rn BETWEEN 41 AND 60 THEN CAST(close AS DOUBLE) END) AS s3,
  CAST(sum(CASE WHEN rn <= 5 THEN volume END) AS DOUBLE) / 5 AS v5, CAST(sum(CASE WHEN rn <= 20 THEN volume END) AS DOUBLE) / 20 AS v20 FROM r WHERE rn <= 60 GROUP BY code HAVING count(*) >= 60)
SELECT code, round(s1, 4) AS sd1, round(s2, 4) AS sd2, round(s3, 4) AS sd3, s1 < s2 AND s2 < s3 AS contracting, round(v5 / v20 - 1, 6) AS volume_change FROM s""",
        "quotes",
    ),
    "volume_ratio": (lambda d: f"WITH {RANKED} SELECT code, round(max(CASE WHEN rn = 1 THEN volume END) / (CAST(sum(volume) AS DOUBLE) / count(*)), 6) AS ratio FROM r WHERE rn <= 20 GROUP BY code", "quotes"),
    "big_candles": (
        lambda d: "WITH c AS (SELECT code, (CAST(close AS DOUBLE) / lag(CAST(close AS DOUBLE)) OVER (PARTITION BY code ORDER BY trade_date) - 1) * 100 AS pct, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn FROM quotes) SELECT code, coalesce(max(CASE WHEN pct >= 5 THEN 1 ELSE 0 END), 0) = 1 AS has_big FROM c WHERE rn <= 20 GROUP BY code",
        "quotes",
    ),
    "daily_pnl": (
        lambda d: "WITH n AS (SELECT trade_date, CAST(sum(CASE WHEN action = 'sell' THEN shares * price ELSE -shares * price END) AS DOUBLE) AS flow FROM trades GROUP BY trade_date) SELECT trade_date, round(flow, 2) AS flow, round(flow - lag(flow) OVER (ORDER BY trade_date), 2) AS change FROM n",
        "trades",
    ),
    # vectors
    "vector_recall": (
        lambda d: f"""
WITH q AS (SELECT id, embedding AS e, sqrt({d.dot("embedding", "embedding")}) AS n FROM vectors WHERE id % 50 = 0), x AS (SELECT id, embedding AS e, sqrt({d.dot("embedding", "embedding")}) AS n FROM vectors),
s AS (SELECT q.id AS query_id, x.id, CASE WHEN q.n = 0 OR x.n = 0 THEN 0e0 ELSE round({d.dot("q.e", "x.e")} / (q.n * x.n), 8) END AS sim FROM q JOIN x ON q.id != x.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rn FROM s WHERE sim >= {LOW} AND sim < {HIGH})
SELECT query_id, id, sim FROM r WHERE rn <= 3""",
        "vectors",
    ),
}

QUERIES, ORACLES = both(FOUND)


def band_join(spark, sf_dir, least: float = 0.5, band: int = 21600):
    """(newer, older, sim): for each root its most similar title of another source in the six hours before it, by trigrams."""
    text = lambda d: f"SELECT id, source, published, related_to_id IS NULL AS root, lower(title) AS t FROM news WHERE length(title) > 0 AND published > {NOW} - 72 * 3600"
    return closest_titles(settle(spark_query(text, "news")(spark, sf_dir)), least, band).withColumn("sim", F.round("sim", 6))


def vector_recall(spark, sf_dir, low: float = LOW, high: float = HIGH, top: int = 3):
    """(query_id, id, sim): the best ``top`` vectors in the band for each whose id is divisible by 50."""
    found = vectors(spark, sf_dir)
    return similar_vectors(found.where("id % 50 = 0"), found, low, high, top=top)


def bounded_as_of(spark, sf_dir):
    return ledger.bounded_as_of(trades(spark, sf_dir), every_quote(spark, sf_dir))


QUERIES |= {"band_join": band_join, "bounded_as_of": bounded_as_of, "vector_recall": vector_recall}
