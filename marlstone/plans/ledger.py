"""Queries of the ledger and usage family, with DuckDB counterparts."""

from __future__ import annotations

from marlstone.operators import ledger
from marlstone.sources.adapters import CLOSED_TRADES, EVERY_QUOTE, TRADES, USAGE, closed_trades, every_quote, trades, usage, with_views

QUERIES = {
    "net_shares": lambda s, d: ledger.net_shares(trades(s, d)),
    "close_as_of": lambda s, d: ledger.with_close_as_of(trades(s, d), every_quote(s, d)),
    "nav": lambda s, d: ledger.nav(trades(s, d), every_quote(s, d)),
    "trade_kpi": lambda s, d: ledger.trade_kpi(closed_trades(s, d)),
    "click_rates": lambda s, d: ledger.click_rates(usage(s, d)),
    "usage_trend": lambda s, d: ledger.usage_trend(usage(s, d)),
}

NET = ", net AS (SELECT code, sum(CASE action WHEN 'buy' THEN shares ELSE -shares END)::BIGINT AS shares, sum(CASE action WHEN 'buy' THEN shares * price ELSE -shares * price END)::DOUBLE AS spent FROM trades GROUP BY code)"

ORACLES = {
    "net_shares": with_views(TRADES, sql=NET + " SELECT * FROM net"),
    "close_as_of": with_views(EVERY_QUOTE, TRADES, sql=" SELECT trade_id, t.code, t.trade_date, CAST(q.close AS DOUBLE) AS close FROM trades t ASOF LEFT JOIN every_quote q ON t.code = q.code AND t.trade_date >= q.trade_date"),
    "nav": with_views(EVERY_QUOTE, TRADES, sql=NET + """,
l AS (SELECT code, CAST(arg_max(close, trade_date) AS DOUBLE) AS close FROM every_quote GROUP BY code), o AS (SELECT code, CAST(arg_max(price, (trade_date, trade_id)) AS DOUBLE) AS paid FROM trades GROUP BY code),
s AS (SELECT count(*) FILTER (WHERE shares > 0) AS codes, sum(spent) AS spent, coalesce(sum(shares * coalesce(close, paid)) FILTER (WHERE shares > 0), 0e0) AS worth FROM net JOIN o ON o.code = net.code LEFT JOIN l ON l.code = net.code)
SELECT codes, round(1e9 - spent, 2) AS cash, round(worth, 2) AS holdings, round(1e9 - spent + worth, 2) AS assets, round((1e9 - spent + worth) / 1e9, 6) AS nav FROM s"""),
    "trade_kpi": with_views(CLOSED_TRADES, sql="""
SELECT market, count(*) AS sample_size, round(count(*) FILTER (WHERE followed_rule) * 100e0 / nullif(count(followed_rule), 0), 1) AS discipline_rate,
  round(coalesce(avg(CASE WHEN pnl_pct > 0 THEN pnl_pct END), 0e0), 2) AS avg_win_pct, round(coalesce(avg(CASE WHEN pnl_pct < 0 THEN -pnl_pct END), 0e0), 2) AS avg_loss_pct,
  round(avg(CASE WHEN pnl_pct > 0 THEN pnl_pct END) / avg(CASE WHEN pnl_pct < 0 THEN -pnl_pct END), 2) AS profit_loss_ratio, round(count(CASE WHEN pnl_pct > 0 THEN 1 END) * 100e0 / count(*), 1) AS win_rate,
  coalesce(count(*) FILTER (WHERE followed_rule) = count(followed_rule) AND count(followed_rule) > 0 AND coalesce(avg(CASE WHEN pnl_pct > 0 THEN pnl_pct END), 0) / avg(CASE WHEN pnl_pct < 0 THEN -pnl_pct END) >= 2 AND count(*) >= 15, false) AS passed
FROM closed_trades WHERE status = 'closed' GROUP BY market"""),
    "click_rates": with_views(USAGE, sql=""",
v AS (SELECT dimension, sum(value) AS views FROM usage WHERE metric = 'view' GROUP BY ALL), c AS (SELECT dimension, sum(value) AS clicks FROM usage WHERE metric = 'click' GROUP BY ALL)
SELECT coalesce(v.dimension, c.dimension) AS dimension, CAST(coalesce(views, 0) AS BIGINT) AS views, CAST(clicks AS BIGINT) AS clicks, CASE WHEN views > 0 THEN CAST(round(CAST(clicks * 100 AS DECIMAL(20,6)) / views, 1) AS DOUBLE) ELSE 0e0 END AS rate
FROM v FULL OUTER JOIN c ON v.dimension = c.dimension WHERE clicks > 0 ORDER BY clicks DESC, dimension LIMIT 10"""),
    "usage_trend": with_views(USAGE, sql=" SELECT date, metric, CAST(sum(value) AS BIGINT) AS total FROM usage GROUP BY ALL"),
}
