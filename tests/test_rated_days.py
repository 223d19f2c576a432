"""Ratings of all days from spans of days, against those computed a day at a time."""

import datetime as dt
import random
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal

import numpy as np
import pytest

from marlstone.plans import ratings
from marlstone.plans.dialect import run_text


@pytest.mark.parametrize(("lookback", "start", "end"), [(400, None, None), (190, None, None), (100, "2001-05-01", "2001-10-20")])
def test_spans_give_the_rows_of_days(spark, lookback, start, end):
    """Gaps that drop periods one after the other, equal scores, days without trade, prices of nothing."""
    rng = random.Random(lookback)
    rows = []
    for code in range(1, 13):
        day = dt.date(2001, 1, 1) + dt.timedelta(days=code)
        for _ in range(rng.choice([62, 70, 200, 300])):
            day += dt.timedelta(days=rng.choice([1, 1, 1, 2, 2, 9 if code % 3 else 1]))
            if day.day not in (13, 14):
                rows.append((code, f"n{code}", day, 10.0 if code < 6 else float(rng.randrange(0, 30))))
    bars = spark.createDataFrame(rows, "code long, name string, trade_date date, close double")
    want = sorted(map(repr, run_text(spark, lambda d: ratings.backfill(d, start, end, lookback), every_quote=bars).collect()))
    got = sorted(map(repr, ratings.rated_days(spark, bars, lookback, start, end).collect()))
    assert got == want
    assert len(want) > 100 and any("copied=True" in r for r in want)


def test_mean_ranks_of_equal_scores():
    assert ratings.ranked(np.array([1.0])).tolist() == [99]
    assert ratings.ranked(np.array([1.0, 1.0, 2.0])).tolist() == [50, 50, 99]
    for n in (2, 7, 49, 98, 196):
        want = [max(1, min(99, int((Decimal(98) * k / n + 1).quantize(Decimal("1e-6"), ROUND_HALF_UP).to_integral_value(ROUND_HALF_EVEN)))) for k in range(1, n + 1)]
        assert ratings.ranked(np.arange(n, dtype=float)).tolist() == want
