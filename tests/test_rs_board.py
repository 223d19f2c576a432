"""The board of a day rates that day alone, with the rows that a rating of every day gives."""

import pytest

from marlstone.plans import ratings
from marlstone.plans.dialect import run_text
from marlstone.sources import adapters

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("day", "lookback"), [("2001-08-01", 1600), ("1997-03-09", 1000), ("1900-01-01", 1600)])
def test_board_of_a_day(spark, day, lookback):
    want = run_text(spark, lambda d: ratings.board(d, day, lookback=lookback), every_quote=adapters.every_quote(spark, DATA)).collect()
    got = ratings.rs_board(spark, DATA, day, lookback=lookback)
    assert got.collect() == want and (len(want) > 0) == (day > "1990")
    assert "sequence(" not in ratings.QUERIES["rs_board"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()  # no bar is spread over its days
