"""Queries of the fold family over the quotes view, with DuckDB counterparts."""

from __future__ import annotations

from marlstone.operators import folds
from marlstone.sources.adapters import AS_OF, QUOTES, quotes, with_views

QUERIES = {
    "ema_history": lambda s, d, as_of=AS_OF: folds.ema(quotes(s, d, as_of)),
    "rsi_wilder": lambda s, d, as_of=AS_OF: folds.rsi(quotes(s, d, as_of)),
    "adx_wilder": lambda s, d, as_of=AS_OF: folds.adx(quotes(s, d, as_of)),
    "trend_signals": lambda s, d, as_of=AS_OF: folds.trend_signals(quotes(s, d, as_of)),
    "trend_screen": lambda s, d, as_of=AS_OF: folds.trend_screen(quotes(s, d, as_of)),
}

CLOSES = ", l AS (SELECT code, list(CAST(close AS DOUBLE) ORDER BY trade_date) AS c FROM quotes GROUP BY code)"
RSI = CLOSES + """,
d AS (SELECT code, CASE WHEN len(c) > 14 THEN list_transform(range(1, len(c)), lambda i: c[i + 1] - c[i]) END AS d FROM l),
g AS (SELECT code, list_transform(d, lambda x: greatest(x, 0e0)) AS g, list_transform(d, lambda x: greatest(-x, 0e0)) AS b FROM d),
m AS (SELECT code, list_reduce(g[15:], lambda a, x: (a * 13 + x) / 14, list_sum(g[1:14]) / 14) AS gain, list_reduce(b[15:], lambda a, x: (a * 13 + x) / 14, list_sum(b[1:14]) / 14) AS loss FROM g),
rsi AS (SELECT code, round(CASE WHEN loss = 0 THEN 100e0 ELSE 100 - 100 / (1 + gain / loss) END, 6) AS rsi FROM m)"""
_SMOOTH = {c: f"(CASE WHEN a.i < 14 THEN a.{c} + x.{c} / 14 ELSE a.{c} * (1 - 1e0 / 14) + x.{c} / 14 END)" for c in ("tr", "plus", "minus")}
_DX = "(CASE WHEN {tr} > 0 AND {plus} + {minus} > 0 THEN 100 * abs({plus} - {minus}) / ({plus} + {minus}) ELSE 0e0 END)".format(**_SMOOTH)
ADX = f""",
e AS (SELECT *, CAST(high AS DOUBLE) AS h, CAST(low AS DOUBLE) AS w, lag(CAST(high AS DOUBLE)) OVER o AS ph, lag(CAST(low AS DOUBLE)) OVER o AS pl, lag(CAST(close AS DOUBLE)) OVER o AS pc FROM quotes WINDOW o AS (PARTITION BY code ORDER BY trade_date)),
v AS (SELECT code, trade_date, greatest(h - w, abs(h - pc), abs(w - pc)) AS tr, CASE WHEN h - ph > pl - w AND h > ph THEN h - ph ELSE 0e0 END AS plus, CASE WHEN pl - w > h - ph AND pl > w THEN pl - w ELSE 0e0 END AS minus FROM e WHERE pc IS NOT NULL),
q AS (SELECT code, list({{'i': 0, 'tr': tr, 'plus': plus, 'minus': minus, 'adx': 0e0}} ORDER BY trade_date) AS s FROM v GROUP BY code),
f AS (SELECT code, list_reduce(s, lambda a, x: {{'i': a.i + 1, 'tr': {_SMOOTH["tr"]}, 'plus': {_SMOOTH["plus"]}, 'minus': {_SMOOTH["minus"]},
  'adx': CASE WHEN a.i < 13 THEN 0e0 WHEN a.i < 28 THEN a.adx + {_DX} / 15 ELSE a.adx * (1 - 1e0 / 14) + {_DX} / 14 END}}, {{'i': 0, 'tr': 0e0, 'plus': 0e0, 'minus': 0e0, 'adx': 0e0}}) AS f FROM q),
adx AS (SELECT c.code, CASE WHEN f.i >= 28 THEN round(f.adx, 6) END AS adx FROM (SELECT DISTINCT code FROM quotes) AS c LEFT JOIN f ON c.code = f.code)"""
SIGNALS = """,
k AS (SELECT code, trade_date, CAST(close AS DOUBLE) AS close, CASE WHEN count(*) OVER a = 20 THEN CAST(sum(close) OVER a AS DOUBLE) / 20 END AS sma20, CASE WHEN count(*) OVER b = 50 THEN CAST(sum(close) OVER b AS DOUBLE) / 50 END AS sma50,
  CASE WHEN count(*) OVER p = 20 THEN close >= max(high) OVER p END AS new_high, CASE WHEN count(*) OVER p = 20 THEN volume / (CAST(sum(volume) OVER p AS DOUBLE) / 20) END AS ratio,
  round(volume / (CAST(sum(volume) OVER a AS DOUBLE) / count(*) OVER a), 2) AS volume_ratio, CAST(sum(amount) OVER a AS DOUBLE) / count(*) OVER a AS amount20
  FROM quotes WINDOW a AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), b AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), p AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, lag(sma20, 5) OVER o AS b20, lag(sma50, 5) OVER o AS b50, max(ratio) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS vr, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn, count(*) OVER (PARTITION BY code) AS n, max(trade_date) OVER () AS newest FROM k WINDOW o AS (PARTITION BY code ORDER BY trade_date)),
signals AS (SELECT code, coalesce(close > sma20 AND sma20 > sma50 AND sma20 > b20 AND sma50 > b50, false) AS t1, coalesce(new_high, false) AS t3, coalesce(vr >= 1.5, false) AS t4, volume_ratio,
  amount20 >= 2e7 AS liquid, trade_date >= newest - 3 AS fresh, n >= 55 AS long_enough FROM z WHERE rn = 1)"""

ORACLES = {
    "ema_history": with_views(QUOTES, sql=CLOSES + " SELECT code, " + ", ".join(f"round(list_reduce(c, lambda a, x: a + (x - a) * (2e0 / {p + 1})), 6) AS ema{p}" for p in folds.EMA_PERIODS) + " FROM l WHERE len(c) >= 20"),
    "rsi_wilder": with_views(QUOTES, sql=RSI + " SELECT * FROM rsi"),
    "adx_wilder": with_views(QUOTES, sql=ADX + " SELECT * FROM adx"),
    "trend_signals": with_views(QUOTES, sql=SIGNALS + " SELECT code, t1, t3, t4, volume_ratio FROM signals"),
    "trend_screen": with_views(QUOTES, sql=RSI + ADX + SIGNALS + """
SELECT signals.code, liquid, fresh, long_enough, t1, coalesce(round(adx, 2) > 25, false) AS t2, t3, t4, coalesce(round(rsi, 2) > 50 AND round(rsi, 2) < 80, false) AS t5,
  CASE WHEN rsi IS NOT NULL AND adx IS NOT NULL THEN round(0.4e0 * least(1e0, round(adx, 2) / 50) + 0.3e0 * greatest(0e0, least(1e0, (round(rsi, 2) - 50) / 30)) + 0.3e0 * least(1e0, volume_ratio / 3), 3) END AS score
FROM signals LEFT JOIN rsi ON rsi.code = signals.code LEFT JOIN adx ON adx.code = signals.code"""),
}
