"""Trades with the latest bar of five days, without a table sent to all tasks."""

from datetime import date

from marlstone.operators import ledger
from marlstone.plans import catalog


def test_by_hand(spark):
    day = lambda n: date(2000, 1, n)
    trades = spark.createDataFrame([(1, 7, day(10)), (2, 7, day(15)), (3, 7, day(16)), (4, 8, day(10)), (5, 7, day(3)), (6, 7, day(12)), (6, 7, day(10)), (None, 7, day(10))], "trade_id long, code long, trade_date date")
    bars = spark.createDataFrame([(7, day(4), 1.0), (7, day(8), 2.0), (7, day(10), 3.0), (9, day(10), 4.0)], "code int, trade_date date, close double")
    got = sorted(map(tuple, ledger.bounded_as_of(trades, bars).collect()))
    assert got == [(1, day(10), 3.0), (2, day(10), 3.0), (6, day(10), 3.0)]


def test_trades_are_not_broadcast(spark):
    df = catalog.QUERIES["bounded_as_of"](spark, "/root/testdata/sf0.01")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") <= 3  # names of series, nations and regions
