"""Values of a small portfolio, by hand."""

import datetime as dt
from decimal import Decimal

from marlstone.plans import digests, portfolio
from marlstone.plans.dialect import run_text


def day(n):
    return dt.date(2001, 1, n)


def frames(spark):
    trades = [(1, 1, "buy", 10, Decimal(5), day(2)), (2, 1, "sell", 4, Decimal(7), day(4)), (3, 2, "buy", 1, Decimal(30), day(3)), (4, 3, "buy", 2, Decimal(1), day(3)), (5, 3, "sell", 2, Decimal(2), day(5))]
    bars = [(1, day(1), Decimal(4)), (1, day(3), Decimal(6)), (1, day(6), Decimal(8)), (4, day(1), Decimal(9)), (1, day(9), Decimal(100))]
    return {"trades": spark.createDataFrame(trades, "trade_id long, code long, action string, shares long, price decimal(18,2), trade_date date"), "every_quote": spark.createDataFrame(bars, "code long, trade_date date, close decimal(18,2)")}


def test_days(spark):
    rows = run_text(spark, lambda d: portfolio.nav_series(d, "2001-01-08", 100), **frames(spark)).collect()
    # 1: nothing held; 2: 10 at the close of day 1; 3: 10 x 6, 1 x 30 and 2 x 1 at the price paid; 4: 6 left; 5: 3 sold; 6: close 8
    assert {r.trade_date.day: (r.cash, r.market_value) for r in rows} == {1: (100.0, 0.0), 2: (50.0, 40.0), 3: (18.0, 92.0), 4: (46.0, 68.0), 5: (50.0, 66.0), 6: (50.0, 78.0)}
    assert {r.trade_date.day: (r.nav, r.total_pnl) for r in rows}[6] == (1.28, 28.0)


def test_overview(spark):
    (r,) = run_text(spark, lambda d: portfolio.overview(d, "2001-01-08", 100, "2001-01-03"), **frames(spark)).collect()
    assert (r.latest_date, r.latest_nav, r.total_assets, r.daily_pnl, r.position_pct) == (day(6), 1.28, 128.0, 10.34, 60.9)
    assert (r.pnl_since_inception, r.pnl_1y, r.pnl_3m, r.pnl_ytd) == (16.36, 28.0, 28.0, 28.0)  # no value a year before: from the money at the start
    assert (r.holding_count, r.watching_count, r.exited_count, r.total_active) == (2, 1, 1, 3)


def test_allocation(spark):
    rows = run_text(spark, lambda d: portfolio.allocation(d, "2001-01-08", 100), **frames(spark)).collect()
    assert {r.code: (r.market_value, r.pct) for r in rows} == {1: (48.0, 37.5), 2: (30.0, 23.4), None: (50.0, 39.1)}


def test_no_trades(spark):
    none = {n: f.limit(0) for n, f in frames(spark).items()}
    assert run_text(spark, portfolio.nav_series, **none).collect() == []
    assert [(r.code, r.pct) for r in run_text(spark, portfolio.allocation, **none).collect()] == [(None, 100.0)]


def test_the_relaxed_limits_are_those_of_the_backtest(spark):
    sf = "/root/testdata/sf0.001"
    hits = {tuple(r) for r in digests.vcp_backtest(spark, sf).select("code", "trade_date").collect()}
    counts = {(r.market, r.variant): r.hits for r in digests.vcp_variants(spark, sf).collect()}
    assert sum(n for (_, variant), n in counts.items() if variant == "relaxed") == len(hits) > 0
    assert all(counts.get((m, "strict"), 0) <= counts.get((m, "mid"), 0) for m, _ in counts)
