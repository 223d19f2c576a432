"""Both days' lists are cut from one pass over the bars."""

from marlstone.plans import screening


def test_bars_are_read_once(spark, monkeypatch):
    read, quotes = [], screening.quotes
    monkeypatch.setattr(screening, "quotes", lambda *a: read.append(a[2:]) or quotes(*a))
    screening.filter_summary(spark, "/root/testdata/sf0.001").collect()
    assert read == [(screening.AS_OF, screening.DAYS + 1)]
