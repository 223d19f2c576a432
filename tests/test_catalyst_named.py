"""Screens of a series each are computed for the series that the board names, the latest day is that of all."""

from pyspark.sql import functions as F

from marlstone.plans import catalyst
from marlstone.sources.adapters import quotes


def test_screens_take_named_series_only(spark, monkeypatch):
    data, seen, screen = "/root/testdata/sf0.001", {}, catalyst.fold_ops.trend_screen

    def watched(bars, newest=None):
        seen["codes"] = {r.code for r in bars.select("code").distinct().collect()}
        seen["newest"] = newest.collect()
        return screen(bars, newest=newest)

    monkeypatch.setattr(catalyst.fold_ops, "trend_screen", watched)
    board = {int(r.code.split(".")[0]) for r in catalyst.catalyst_board(spark, data).collect()}
    bars = quotes(spark, data)
    every = {r.code for r in bars.select("code").distinct().collect()}
    assert seen["codes"] == board & every
    assert seen["newest"] == bars.agg(F.max("trade_date").alias("newest")).collect()
    assert catalyst.catalyst_board(spark, data, day=0).count() == 0 and seen["codes"] == set()
