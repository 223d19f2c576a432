"""Windows of the backtest cut out of a series gathered once."""

from datetime import date, timedelta

from marlstone.plans import catalog, digests


def test_by_hand(spark):
    rows = [(c, date(2000, 1, 1) + timedelta(days=i), float(i + 2), float(i), float(i + 1), 10 * i) for c, n in ((1, 102), (2, 89), (3, 90)) for i in range(n)]
    bars = spark.createDataFrame(rows, "code int, trade_date date, high double, low double, close double, volume long").repartition(5)
    got = {r.code: r for r in digests.windows(bars).collect()}
    assert set(got) == {1_000_090, 1_000_095, 1_000_100, 3_000_090}
    r = got[1_000_095]
    assert r.n == 90 and r.c == [float(i + 1) for i in range(5, 95)] and r.h[0] == 7 and r.l[0] == 5 and r.w == [10 * i for i in range(5, 95)]
    assert [tuple(x) for x in r.s[:2]] == [(0, 1, 6.0, []), (0, 2, 7.0, [])] and len(r.s) == 90


def test_bars_are_not_repeated(spark, monkeypatch):
    def fail(*args):
        raise AssertionError("a row for each bar of each window")

    monkeypatch.setattr(digests, "frames", fail)
    assert catalog.QUERIES["vcp_variants"](spark, "/root/testdata/sf0.001").columns[:3] == ["market", "variant", "hits"]
