"""Queries of the cross-sectional family over the quotes view, with DuckDB counterparts."""

from __future__ import annotations

from marlstone.operators import cross_section as cs
from marlstone.sources.adapters import AS_OF, QUOTES, quotes, with_views

RANKED = ", ranked AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn FROM quotes)"
RS = RANKED + """,
wide AS (
  SELECT code, max(name) AS name, max(trade_date) AS trade_date, count(*) AS days, max(CASE WHEN rn = 1 THEN close END) AS last,
    max(CASE WHEN rn = 63 THEN close END) AS c3, max(CASE WHEN rn = 126 THEN close END) AS c6, max(CASE WHEN rn = 189 THEN close END) AS c9, max(CASE WHEN rn = 252 THEN close END) AS c12
  FROM ranked WHERE close > 0 GROUP BY code),
roc AS (
  SELECT code, name, trade_date, days,
    CAST(round(CAST((CAST(last AS DOUBLE) / CAST(c3 AS DOUBLE) - 1) * 100 AS DECIMAL(20,8)), 2) AS DOUBLE) AS p3,
    CAST(round(CAST((CAST(last AS DOUBLE) / CAST(c6 AS DOUBLE) - 1) * 100 AS DECIMAL(20,8)), 2) AS DOUBLE) AS p6,
    CAST(round(CAST((CAST(last AS DOUBLE) / CAST(c9 AS DOUBLE) - 1) * 100 AS DECIMAL(20,8)), 2) AS DOUBLE) AS p9,
    CAST(round(CAST((CAST(last AS DOUBLE) / CAST(c12 AS DOUBLE) - 1) * 100 AS DECIMAL(20,8)), 2) AS DOUBLE) AS p12
  FROM wide WHERE days >= 63 AND c3 IS NOT NULL),
scored AS (
  SELECT *, CAST(round(CAST(
    (CASE WHEN p3 IS NULL THEN 0e0 ELSE p3 * 0.4e0 END + CASE WHEN p6 IS NULL THEN 0e0 ELSE p6 * 0.2e0 END + CASE WHEN p9 IS NULL THEN 0e0 ELSE p9 * 0.2e0 END + CASE WHEN p12 IS NULL THEN 0e0 ELSE p12 * 0.2e0 END)
    / (CASE WHEN p3 IS NULL THEN 0e0 ELSE 0.4e0 END + CASE WHEN p6 IS NULL THEN 0e0 ELSE 0.2e0 END + CASE WHEN p9 IS NULL THEN 0e0 ELSE 0.2e0 END + CASE WHEN p12 IS NULL THEN 0e0 ELSE 0.2e0 END)
    AS DECIMAL(20,8)), 4) AS DOUBLE) AS score FROM roc),
rated AS (
  SELECT code, name, trade_date, p3, p6, p9, p12, score,
    CAST(greatest(1, least(99, round_even(CAST((rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0) / count(*) OVER () * 98 + 1 AS DECIMAL(12,6)), 0))) AS INT) AS rs_rating
  FROM scored)"""
CHANGE = """, moved AS (SELECT *, CAST(close AS DOUBLE) / lag(CAST(close AS DOUBLE)) OVER (PARTITION BY code ORDER BY trade_date) - 1 AS change FROM quotes),
daily AS (SELECT market, trade_date, avg(change) AS change, count(*) AS n FROM moved WHERE change IS NOT NULL AND name NOT LIKE '%ST%' GROUP BY ALL)"""
POOL = ", pool AS (SELECT * FROM quotes WHERE close > 0 AND volume > 0 AND name NOT LIKE '%ST%')"
INPUTS = """, inputs AS (
  SELECT code, CAST(max(CASE WHEN rn = 1 THEN close END) AS DOUBLE) AS price,
    CASE WHEN count(*) >= 50 THEN CAST(sum(CASE WHEN rn <= 50 THEN close END) AS DOUBLE) / 50 END AS ma50,
    CASE WHEN count(*) >= 150 THEN CAST(sum(CASE WHEN rn <= 150 THEN close END) AS DOUBLE) / 150 END AS ma150,
    CASE WHEN count(*) >= 200 THEN CAST(sum(CASE WHEN rn <= 200 THEN close END) AS DOUBLE) / 200 END AS ma200,
    CASE WHEN count(*) >= 200 THEN CAST(sum(CASE WHEN rn BETWEEN 22 AND 222 THEN close END) AS DOUBLE) / count(CASE WHEN rn BETWEEN 22 AND 222 THEN 1 END) END AS ma200_before,
    CAST(max(CASE WHEN rn <= 250 THEN high END) AS DOUBLE) AS high52w, CAST(min(CASE WHEN rn <= 250 THEN low END) AS DOUBLE) AS low52w
  FROM ranked GROUP BY code)"""


BREADTH = """,
bm AS (SELECT market, trade_date, CAST(close AS DOUBLE) AS close, CAST(sum(close) OVER w AS DOUBLE) / count(*) OVER w AS ma20, max(trade_date) OVER (PARTITION BY market) AS last
  FROM pool WINDOW w AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
breadth AS (SELECT market, trade_date, count(*) AS pool, CAST(round(CAST(count(CASE WHEN close >= ma20 THEN 1 END) * 100.0 / count(*) AS DECIMAL(20,8)), 2) AS DOUBLE) AS breadth_pct FROM bm WHERE trade_date = last GROUP BY ALL)"""
TURNOVER = """,
td AS (SELECT market, trade_date, sum(amount) AS amount FROM quotes GROUP BY ALL), tl AS (SELECT *, max(trade_date) OVER (PARTITION BY market) AS last FROM td),
turnover AS (SELECT market, count(CASE WHEN trade_date < last THEN 1 END) AS n_before,
  CASE WHEN count(CASE WHEN trade_date < last THEN 1 END) >= 5 THEN round(CAST(max(CASE WHEN trade_date = last THEN amount END) AS DOUBLE) / (CAST(sum(CASE WHEN trade_date < last THEN amount END) AS DOUBLE) / count(CASE WHEN trade_date < last THEN 1 END)) * 100, 2) END AS turnover_pct
FROM tl WHERE trade_date >= last - 25 GROUP BY market)"""
BREAKOUT = """,
om AS (SELECT market, trade_date, close, volume, CASE WHEN count(*) OVER p = 60 THEN max(close) OVER p END AS high60, CASE WHEN count(*) OVER t = 20 THEN CAST(sum(volume) OVER t AS DOUBLE) / 20 END AS vol20, lead(close, 5) OVER o AS later, max(trade_date) OVER (PARTITION BY market) AS last
  FROM pool WINDOW o AS (PARTITION BY code ORDER BY trade_date), p AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), t AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
oh AS (SELECT *, coalesce(close > high60 AND volume >= 1.2 * coalesce(vol20, 0), false) AS hit, trade_date BETWEEN last - 30 AND last - 5 AND later IS NOT NULL AS counted FROM om),
breakout AS (SELECT market, last, count(*) FILTER (WHERE hit AND counted) AS sample_count,
  CASE WHEN count(*) FILTER (WHERE hit AND counted) > 0 THEN CAST(round(CAST(count(*) FILTER (WHERE hit AND counted AND later > close) * 100.0 / count(*) FILTER (WHERE hit AND counted) AS DECIMAL(20,8)), 2) AS DOUBLE) END AS positive_ratio,
  count(*) FILTER (WHERE hit AND trade_date = last) AS breakout_today FROM oh GROUP BY ALL)"""
DERIVED = CHANGE + """,
lv AS (SELECT *, exp(sum(ln(1 + change)) OVER (PARTITION BY market ORDER BY trade_date ROWS UNBOUNDED PRECEDING)) * 1000 AS close FROM daily),
dv AS (SELECT *, CASE WHEN count(*) OVER t = 20 THEN stddev_samp(change) OVER t * sqrt(252.0) END AS vol, CASE WHEN count(*) OVER t = 20 THEN avg(close) OVER t END AS ma20, CASE WHEN count(*) OVER s = 60 THEN avg(close) OVER s END AS ma60
  FROM lv WINDOW t AS (PARTITION BY market ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), s AS (PARTITION BY market ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
dr AS (SELECT *, lag(vol, 5) OVER w AS vb, lag(ma20, 5) OVER w AS b20, lag(ma60, 5) OVER w AS b60, row_number() OVER (PARTITION BY market ORDER BY trade_date DESC) AS rn FROM dv WINDOW w AS (PARTITION BY market ORDER BY trade_date)),
dl AS (SELECT market, trade_date, close > ma20 AS above_ma20, close > ma60 AS above_ma60, ma20 > b20 AS ma20_up, ma60 < b60 AS ma60_down, vol AS now, vol / vb - 1 AS shock FROM dr WHERE rn = 1),
derived AS (SELECT market, trade_date, above_ma20, above_ma60, ma20_up, ma60_down, round(now, 6) AS vol20, round(shock, 6) AS vol_shock, (SELECT round(count(CASE WHEN vol <= now + 1e-12 THEN 1 END) * 100.0 / count(*), 4) FROM dr WHERE dr.market = dl.market AND rn <= 250 AND vol IS NOT NULL) AS vol_pct_250 FROM dl)"""


def _adaptability(s, d, as_of=AS_OF):
    q = quotes(s, d, as_of)
    return cs.adaptability(cs.benchmark_derived(cs.daily_changes(q)), cs.market_breadth(q), cs.breakout_efficacy(q), cs.turnover_ratio(q))


QUERIES = {
    "rs_rating": lambda s, d, as_of=AS_OF: cs.rs_rating(quotes(s, d, as_of)),
    "price_extremes": lambda s, d, as_of=AS_OF: cs.price_extremes(quotes(s, d, as_of)),
    "trend_inputs": lambda s, d, as_of=AS_OF: cs.trend_inputs(quotes(s, d, as_of)),
    "trend_template": lambda s, d, as_of=AS_OF: cs.trend_template(cs.trend_inputs(q := quotes(s, d, as_of)), cs.rs_rating(q)),
    "market_breadth": lambda s, d, as_of=AS_OF: cs.market_breadth(quotes(s, d, as_of)),
    "turnover_ratio": lambda s, d, as_of=AS_OF: cs.turnover_ratio(quotes(s, d, as_of)),
    "breakout_efficacy": lambda s, d, as_of=AS_OF: cs.breakout_efficacy(quotes(s, d, as_of)),
    "equal_weight_index": lambda s, d, as_of=AS_OF: cs.equal_weight_index(quotes(s, d, as_of)),
    "benchmark_derived": lambda s, d, as_of=AS_OF: cs.benchmark_derived(cs.daily_changes(quotes(s, d, as_of))),
    "adaptability": _adaptability,
    "price_trend": lambda s, d, as_of=AS_OF: cs.price_trend(quotes(s, d, as_of)),
    "quantile_close": lambda s, d, as_of=AS_OF: cs.quantile_close(quotes(s, d, as_of)),
    "range_contraction": lambda s, d, as_of=AS_OF: cs.range_contraction(quotes(s, d, as_of)),
    "point_of_control": lambda s, d, as_of=AS_OF: cs.point_of_control(quotes(s, d, as_of)),
}

ORACLES = {
    "rs_rating": with_views(QUOTES, sql=RS + " SELECT * FROM rated"),
    "price_extremes": with_views(QUOTES, sql=RANKED + """
SELECT code, CAST(min(CASE WHEN rn <= 120 THEN low END) AS DOUBLE) AS low_120, CAST(max(CASE WHEN rn <= 60 THEN high END) AS DOUBLE) AS high_60,
  CAST(sum(CASE WHEN rn <= 50 THEN volume END) AS DOUBLE) / count(CASE WHEN rn <= 50 THEN 1 END) AS volume_50,
  max(CASE WHEN rn = 1 THEN volume END) AS volume, CAST(max(CASE WHEN rn = 1 THEN close END) AS DOUBLE) AS close FROM ranked GROUP BY code"""),
    "trend_inputs": with_views(QUOTES, sql=RANKED + INPUTS + " SELECT * FROM inputs"),
    "trend_template": with_views(QUOTES, sql=RS + INPUTS + """, rules AS (
  SELECT inputs.code, coalesce(price > ma150 AND price > ma200, false) AS rule1, coalesce(ma150 > ma200, false) AS rule2, coalesce(ma200 > ma200_before, false) AS rule3,
    coalesce(ma50 > ma150 AND ma50 > ma200, false) AS rule4, coalesce(price > ma50, false) AS rule5, coalesce(low52w > 0 AND (price - low52w) / low52w >= 0.25, false) AS rule6,
    coalesce(high52w > 0 AND (high52w - price) / high52w <= 0.25, false) AS rule7, coalesce(rs_rating >= 70, false) AS rule8
  FROM inputs LEFT JOIN rated ON rated.code = inputs.code)
SELECT *, rule1::INT + rule2::INT + rule3::INT + rule4::INT + rule5::INT + rule6::INT + rule7::INT + rule8::INT AS n_passed,
  rule1 AND rule2 AND rule3 AND rule4 AND rule5 AND rule6 AND rule7 AND rule8 AS all_pass FROM rules"""),
    "market_breadth": with_views(QUOTES, sql=POOL + BREADTH + " SELECT * FROM breadth"),
    "turnover_ratio": with_views(QUOTES, sql=TURNOVER + " SELECT * FROM turnover"),
    "breakout_efficacy": with_views(QUOTES, sql=POOL + BREAKOUT + " SELECT * FROM breakout"),
    "equal_weight_index": with_views(QUOTES, sql=CHANGE + """, n AS (SELECT *, max(trade_date) OVER (PARTITION BY market) AS last FROM daily)
SELECT market, trade_date, n, round(change, 9) AS mean_change, CAST(printf('%.6e', exp(sum(ln(1 + change)) OVER (PARTITION BY market ORDER BY trade_date ROWS UNBOUNDED PRECEDING)) * 1000) AS DOUBLE) AS level FROM n WHERE trade_date >= last - 420"""),
    "benchmark_derived": with_views(QUOTES, sql=DERIVED + " SELECT * FROM derived"),
    "adaptability": with_views(QUOTES, sql=POOL + BREADTH + TURNOVER + BREAKOUT + DERIVED + """,
c AS (SELECT derived.*, breadth_pct, sample_count, positive_ratio, turnover_pct FROM derived LEFT JOIN breadth USING (market) LEFT JOIN breakout USING (market) LEFT JOIN turnover USING (market)),
p AS (SELECT *, CASE WHEN above_ma60 IS NULL THEN 0 ELSE [0, 5, 15, 25][above_ma20::INT + above_ma60::INT + coalesce(ma20_up, false)::INT + 1] END AS trend,
  CASE WHEN breadth_pct > 60 THEN 20 WHEN breadth_pct >= 45 THEN 14 WHEN breadth_pct >= 30 THEN 7 ELSE 0 END AS breadth,
  CASE WHEN vol_pct_250 IS NULL THEN 5 WHEN vol_shock >= 0.3 THEN 0 WHEN vol_pct_250 >= 30 AND vol_pct_250 <= 60 THEN 20 WHEN vol_pct_250 >= 20 AND vol_pct_250 <= 75 THEN 12 ELSE 5 END AS volatility,
  CASE WHEN coalesce(sample_count, 0) < 20 OR positive_ratio IS NULL THEN 12 WHEN positive_ratio > 65 THEN 25 WHEN positive_ratio >= 50 THEN 18 WHEN positive_ratio >= 35 THEN 8 ELSE 0 END AS breakout,
  CASE WHEN turnover_pct > 110 THEN 10 WHEN turnover_pct >= 90 THEN 7 WHEN turnover_pct >= 80 THEN 3 ELSE 0 END AS activity FROM c),
t AS (SELECT *, trend + breadth + volatility + breakout + activity AS total FROM p), b AS (SELECT *, CASE WHEN total >= 70 THEN 2 WHEN total >= 45 THEN 1 ELSE 0 END AS base FROM t),
d AS (SELECT *, CASE WHEN sample_count >= 20 AND positive_ratio < 30 THEN 0 ELSE greatest((CASE WHEN NOT above_ma60 AND ma60_down THEN least(base, 1) ELSE base END) - (coalesce(vol_shock, 0) >= 0.3)::INT, 0) END AS final FROM b)
SELECT market, trend, breadth, volatility, breakout, activity, total, ['cautious', 'neutral', 'favorable'][base + 1] AS base_level, ['cautious', 'neutral', 'favorable'][final + 1] AS level FROM d"""),
    "price_trend": with_views(QUOTES, sql=""",
m AS (SELECT code, round(CAST((CAST(close AS DOUBLE) / lag(CAST(close AS DOUBLE)) OVER (PARTITION BY code ORDER BY trade_date) - 1) * 100 AS DECIMAL(20,8)), 2) AS pct, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn FROM quotes),
s AS (SELECT code, CAST(sum(pct) AS DOUBLE) AS sum_pct FROM m WHERE rn <= 5 GROUP BY code)
SELECT *, CASE WHEN sum_pct <= -10 THEN 'strong_down' WHEN sum_pct <= -5 THEN 'down' ELSE 'flat_or_up' END AS trend FROM s"""),
    "quantile_close": with_views(QUOTES, sql=RANKED + """
SELECT code, CASE WHEN count(*) >= 10 THEN CAST(round(CAST(quantile_cont(CAST(close AS DOUBLE), 0.9) AS DECIMAL(20,8)), 6) AS DOUBLE) END AS quantile_close FROM ranked WHERE rn <= 60 GROUP BY code"""),
    "range_contraction": with_views(QUOTES, sql=""",
r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn, close < open AS down FROM quotes)
SELECT code, CAST(max(CASE WHEN rn <= 40 THEN high END) - min(CASE WHEN rn <= 40 THEN low END) AS DOUBLE) / CAST(max(CASE WHEN rn = 1 THEN close END) AS DOUBLE) AS range40,
  CAST(max(CASE WHEN rn <= 10 THEN high END) - min(CASE WHEN rn <= 10 THEN low END) AS DOUBLE) / CAST(max(CASE WHEN rn = 1 THEN close END) AS DOUBLE) AS range10,
  coalesce(CAST(sum(CASE WHEN rn <= 5 AND down THEN volume END) AS DOUBLE) / nullif(count(CASE WHEN rn <= 5 AND down THEN 1 END), 0), 0e0) AS down_volume,
  CAST(sum(CASE WHEN rn <= 50 THEN volume END) AS DOUBLE) / count(CASE WHEN rn <= 50 THEN 1 END) AS volume_50 FROM r GROUP BY code HAVING count(*) >= 10"""),
    "point_of_control": with_views(QUOTES, sql=RANKED + """,
l AS (SELECT code, CAST(close AS DOUBLE) AS close, volume FROM ranked WHERE rn <= 120), s AS (SELECT code, min(close) AS low, max(close) AS high, count(*) AS n FROM l GROUP BY code),
b AS (SELECT l.code, low, high, n, CASE WHEN high = low THEN 0 ELSE CAST(least(19, floor((close - low) / ((high - low) / 20))) AS INT) END AS bin, sum(volume) AS v FROM l JOIN s ON l.code = s.code GROUP BY ALL),
m AS (SELECT code, low, high, n, arg_max(bin, (v, -bin)) AS bin FROM b GROUP BY ALL)
SELECT code, CASE WHEN n >= 20 THEN CASE WHEN high = low THEN low ELSE low + (bin + 0.5e0) * ((high - low) / 20) END END AS poc FROM m"""),
}
