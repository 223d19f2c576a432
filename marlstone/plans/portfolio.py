"""Value of the portfolio on every day, its returns over periods and its allocation, written once for both engines."""

from __future__ import annotations

from marlstone.plans.dialect import both
from marlstone.sources.adapters import AS_OF

#: Money at the start.
CAPITAL = 1_000_000_000


def rounded(x: str, digits: int) -> str:
    """Rounded half up, by way of a decimal so that both engines agree."""
    return f"CAST(round(CAST({x} AS DECIMAL(24,8)), {digits}) AS DOUBLE)"


def positions(d, as_of: str) -> str:
    """CTEs up to held(code, trade_date, moved, spent, shares, worth): each position on each day on which it or its close changes.

    Trades are summed by code and day first. Bars and trades of a code make one sorted
    stream, in which the last close so far (else the last price paid) values the shares.
    """
    last = (lambda x: f"last_value({x}, true) OVER w") if type(d).__name__ == "SparkSql" else (lambda x: f"last_value({x} IGNORE NULLS) OVER w")
    return f"""m AS (SELECT code, trade_date, CAST(sum(CASE WHEN action = 'buy' THEN shares ELSE -shares END) AS BIGINT) AS moved, CAST(sum(CASE WHEN action = 'buy' THEN shares * price ELSE -shares * price END) AS DECIMAL(30,2)) AS spent, max_by(price, trade_id) AS paid
  FROM trades WHERE trade_date <= DATE '{as_of}' GROUP BY code, trade_date),
own AS (SELECT DISTINCT code FROM m),
u AS (SELECT code, trade_date, moved, spent, paid, CAST(NULL AS DECIMAL(18,2)) AS close FROM m UNION ALL
  SELECT q.code, q.trade_date, CAST(0 AS BIGINT), CAST(0 AS DECIMAL(30,2)), CAST(NULL AS DECIMAL(18,2)), q.close FROM every_quote q JOIN own ON own.code = q.code WHERE q.trade_date <= DATE '{as_of}'),
e AS (SELECT code, trade_date, CAST(sum(moved) AS BIGINT) AS moved, CAST(sum(spent) AS DECIMAL(30,2)) AS spent, max(paid) AS paid, max(close) AS close FROM u GROUP BY code, trade_date),
p AS (SELECT code, trade_date, moved, spent, CAST(sum(moved) OVER w AS BIGINT) AS shares, coalesce({last("close")}, {last("paid")}) AS price FROM e WINDOW w AS (PARTITION BY code ORDER BY trade_date ROWS UNBOUNDED PRECEDING)),
held AS (SELECT code, trade_date, moved, spent, shares, CAST(CASE WHEN shares > 0 THEN shares * price ELSE 0 END AS DECIMAL(30,2)) AS worth FROM p)"""


def series(d, as_of: str, capital: int) -> str:
    """CTEs up to nav(trade_date, cash, market_value, nav): a day's value is the running sum of the changes of all positions, so no position is copied to days on which it stays."""
    return f"""{positions(d, as_of)},
c AS (SELECT trade_date, spent, worth - coalesce(lag(worth) OVER (PARTITION BY code ORDER BY trade_date), 0) AS gained FROM held),
s AS (SELECT trade_date, sum(spent) AS spent, sum(gained) AS gained FROM c GROUP BY trade_date),
r AS (SELECT trade_date, CAST({capital} - sum(spent) OVER w AS DOUBLE) AS cash, CAST(sum(gained) OVER w AS DOUBLE) AS market_value FROM s WINDOW w AS (ORDER BY trade_date ROWS UNBOUNDED PRECEDING)),
nav AS (SELECT trade_date, cash, market_value, (cash + market_value) / {capital} AS nav FROM r)"""


def nav_series(d, as_of: str = AS_OF, capital: int = CAPITAL) -> str:
    """Cash, holdings, their sum, and the sum against the money at the start, on each day with a trade or a bar of what was ever traded."""
    return f"""WITH {series(d, as_of, capital)}
SELECT trade_date, cash, market_value, round(cash + market_value, 2) AS total_assets, {rounded("nav", 4)} AS nav, {rounded("(nav - 1) * 100", 2)} AS total_pnl FROM nav"""


def overview(d, as_of: str = AS_OF, capital: int = CAPITAL, inception: str = "1993-01-01") -> str:
    """One row: latest value and its change on the day before, share of holdings, returns since the inception, in a year, in 90 days and in this year, and the numbers of codes by status.

    A period starts from the last value on or before its first day; where there is none, it counts from the money at the start.
    """
    starts = {"since_inception": f"DATE '{inception}'", "1y": f"DATE '{as_of}' - 365", "3m": f"DATE '{as_of}' - 90", "ytd": f"DATE '{as_of[:4]}-01-01'"}
    bases = ", ".join(f"max_by(nav, trade_date) FILTER (WHERE trade_date <= {day}) AS b_{name}" for name, day in starts.items())
    gain = lambda base: f"CASE WHEN {base} IS NULL OR {base} = 0 THEN (nav - 1) * 100 ELSE (nav - {base}) / {base} * 100 END"
    returns = ", ".join(f"{rounded(gain(f'b_{name}'), 2)} AS pnl_{name}" for name in starts)
    return f"""WITH {series(d, as_of, capital)},
n AS (SELECT *, lag(nav) OVER (ORDER BY trade_date) AS before FROM nav),
t AS (SELECT max(trade_date) AS latest_date, max_by(nav, trade_date) AS nav, max_by(coalesce(before, 0), trade_date) AS before, max_by(cash, trade_date) AS cash, max_by(market_value, trade_date) AS market_value, {bases} FROM n),
k AS (SELECT code, sum(moved) AS shares FROM held GROUP BY code),
g AS (SELECT count(CASE WHEN k.shares > 0 THEN 1 END) AS holding_count, count(CASE WHEN k.shares <= 0 THEN 1 END) AS exited_count, count(CASE WHEN k.code IS NULL THEN 1 END) AS watching_count
  FROM (SELECT code FROM every_quote WHERE trade_date <= DATE '{as_of}' UNION SELECT code FROM own) AS a LEFT JOIN k ON k.code = a.code)
SELECT latest_date, {rounded("nav", 4)} AS latest_nav, {rounded("(nav - 1) * 100", 2)} AS total_pnl, round(cash + market_value, 2) AS total_assets, CASE WHEN before = 0 THEN 0e0 ELSE {rounded("(nav - before) / nullif(before, 0) * 100", 2)} END AS daily_pnl,
  CASE WHEN cash + market_value > 0 THEN {rounded("market_value / nullif(cash + market_value, 0) * 100", 1)} ELSE 0e0 END AS position_pct, {returns}, holding_count, watching_count, exited_count, holding_count + watching_count AS total_active
FROM t, g"""


def allocation(d, as_of: str = AS_OF, capital: int = CAPITAL) -> str:
    """Each holding and the cash (without a code) with its share of the whole in percent."""
    return f"""WITH {positions(d, as_of)},
l AS (SELECT code, sum(spent) AS spent, max_by(worth, trade_date) AS worth, max_by(shares, trade_date) AS shares FROM held GROUP BY code),
h AS (SELECT code, CAST(worth AS DOUBLE) AS worth FROM l WHERE shares > 0 UNION ALL SELECT NULL, CAST({capital} - coalesce(sum(spent), 0) AS DOUBLE) FROM l),
w AS (SELECT sum(worth) AS whole FROM h)
SELECT h.code, round(h.worth, 2) AS market_value, CASE WHEN whole > 0 THEN {rounded("h.worth / nullif(whole, 0) * 100", 1)} WHEN h.code IS NULL THEN 100e0 ELSE 0e0 END AS pct FROM h, w"""


QUERIES, ORACLES = both({"nav_series": (nav_series, "every_quote", "trades"), "portfolio_overview": (overview, "every_quote", "trades"), "portfolio_allocation": (allocation, "every_quote", "trades")})
