"""Ratings of all days against those of single days."""

import datetime as dt

import pytest

from marlstone.operators import cross_section
from marlstone.plans import ratings
from marlstone.session import table
from marlstone.sources.adapters import quotes

SF = "/root/testdata/sf0.01"
COLUMNS = ("code", "p3", "p6", "p9", "p12", "score", "rs_rating")


@pytest.fixture(scope="module")
def days(spark):
    return ratings.ratings_between(spark, SF, "2000-12-24", "2001-01-06").cache()


def test_a_day_is_rated_as_if_it_were_today(spark, days):
    traded = {r[0] for r in table(spark, SF, "lineitem").selectExpr("to_date(l_shipdate)").distinct().collect()}
    for day in ("2000-12-24", "2000-12-31", "2001-01-06"):
        assert dt.date.fromisoformat(day) in traded
        want = {tuple(r[c] for c in COLUMNS) for r in cross_section.rs_rating(quotes(spark, SF, day)).collect()}
        got = {tuple(r[c] for c in COLUMNS) for r in days.where(f"trade_date = '{day}'").collect()}
        assert got == want and len(want) > 90


def test_days_without_trade_copy_the_last_one(spark):
    rows = [(c, f"n{c}", dt.date(2001, 1, 1) + dt.timedelta(days=2 * k), 10.0 + c + k * (c - 2)) for c in range(1, 5) for k in range(70) if 20 + k * (c - 2) > 0 and k not in (66, 67)]
    bars = spark.createDataFrame(rows, "code long, name string, trade_date date, close double").where("close > 0")
    from marlstone.plans.dialect import run_text

    found = run_text(spark, lambda d: ratings.backfill(d, lookback=400), every_quote=bars).collect()
    by_day = {}
    for r in found:
        by_day.setdefault(r.trade_date, {})[r.code] = r
    start, first = dt.date(2001, 1, 1), dt.date(2001, 1, 1) + dt.timedelta(days=124)
    assert min(by_day) == first and max(by_day) == start + dt.timedelta(days=138)
    for day, mine in by_day.items():
        last = max(r[2] for r in rows if r[2] <= day)
        assert all(r.copied == (day != last) for r in mine.values())
        assert {c: r.p3 for c, r in mine.items()} == {c: r.p3 for c, r in by_day[last].items()}


def test_the_board_is_ordered_and_cut(spark):
    every = ratings.QUERIES["rs_backfill"](spark, "/root/testdata/sf0.001")
    day = every.agg({"trade_date": "max"}).first()[0]
    from marlstone.plans.dialect import run_text
    from marlstone.sources.adapters import every_quote

    board = run_text(spark, lambda d: ratings.board(d, str(day + dt.timedelta(days=9)), top=5, least=20), every_quote=every_quote(spark, "/root/testdata/sf0.001")).collect()
    assert [r.rs_rating for r in board] == sorted((r.rs_rating for r in board), reverse=True) and len(board) == 5
    assert all(r.trade_date == day and r.rs_rating >= 20 for r in board)
