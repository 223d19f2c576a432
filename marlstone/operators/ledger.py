"""Positions, as-of valuation, trading statistics and usage counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def net_shares(trades: DataFrame) -> DataFrame:
    """Signed shares and cash flow of each code."""
    sign = F.when(F.col("action") == "buy", 1).otherwise(-1)
    return trades.groupBy("code").agg(F.sum(sign * F.col("shares")).alias("shares"), F.sum(sign * F.col("shares") * F.col("price")).cast("double").alias("spent"))


def with_close_as_of(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Each trade with the latest close on or before its day: both sides in one sorted stream of a code, so no range join."""
    both = bars.select("code", "trade_date", F.col("close"), F.lit(None).cast("long").alias("trade_id")).unionByName(trades.select(F.col("code").cast(bars.schema["code"].dataType).alias("code"), "trade_date", F.lit(None).cast(bars.schema["close"].dataType).alias("close"), "trade_id"))
    w = Window.partitionBy("code").orderBy("trade_date", F.col("trade_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    marked = both.withColumn("close", F.last("close", ignorenulls=True).over(w))
    return marked.where("trade_id is not null").select("trade_id", "code", "trade_date", F.col("close").cast("double").alias("close"))


def bounded_as_of(trades: DataFrame, bars: DataFrame, days: int = 5) -> DataFrame:
    """(trade_id, trade_date, close): each trade with the latest bar of its day or of the ``days`` before; trades without one have no row.

    Bars are found once for each code and day of trade, not for each trade, and the
    joins here are sorted ones, so trades and hits are not sent through the driver. Rows that repeat a trade's id
    are taken together: those with a bar as near as the nearest stay.
    """
    asked = trades.select("code", "trade_date").distinct().withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(days))))
    asked = asked.select("code", F.col("trade_date").alias("asked"), "back", F.date_sub("trade_date", F.col("back")).alias("trade_date"))
    met = bars.select(F.col("code").cast(trades.schema["code"].dataType).alias("code"), "trade_date", "close").join(asked.hint("merge"), ["code", "trade_date"])
    hits = met.groupBy("code", F.col("asked").alias("day")).agg(F.array_sort(F.collect_list(F.struct("back", "trade_date", "close"))).alias("hits"))
    mine = trades.where("trade_id is not null").select("trade_id", "code", F.col("trade_date").alias("day")).join(hits.hint("merge"), ["code", "day"])
    nearest = F.min(F.col("hits")[0]["back"]).over(Window.partitionBy("trade_id"))
    best = mine.withColumn("nearest", nearest).select("trade_id", F.explode(F.filter("hits", lambda x: x["back"] == F.col("nearest"))).alias("hit"))
    return best.select("trade_id", "hit.trade_date", F.col("hit.close").cast("double").alias("close"))


def nav(trades: DataFrame, bars: DataFrame, capital: float = 1e9) -> DataFrame:
    """Cash, holdings at the latest close (else the latest trade) of codes with shares left, the sum of both, and its ratio to the start value."""
    last = bars.groupBy("code").agg(F.max_by("close", "trade_date").cast("double").alias("close"))
    own = trades.groupBy("code").agg(F.max_by("price", F.struct("trade_date", "trade_id")).cast("double").alias("paid"))
    held = net_shares(trades).join(own, "code").join(last, "code", "left")
    mine = F.col("shares") > 0
    worth = F.coalesce(F.sum(F.when(mine, F.col("shares") * F.coalesce("close", "paid"))), F.lit(0.0))
    sums = held.agg(F.sum("spent").alias("spent"), worth.alias("worth"), F.count_if(mine).alias("codes"))
    assets = F.lit(capital) - F.col("spent") + F.col("worth")
    return sums.select("codes", F.round(F.lit(capital) - F.col("spent"), 2).alias("cash"), F.round("worth", 2).alias("holdings"), F.round(assets, 2).alias("assets"), F.round(assets / capital, 6).alias("nav"))


def trade_kpi(trades: DataFrame, ratio_target: float = 2.0, sample_target: int = 15, discipline_target: float = 100.0) -> DataFrame:
    """For each market's closed trades: share of marked ones that kept the rules, mean gain and loss in percent, their ratio (null without losses), win rate, and whether all targets are met."""
    pnl = F.col("pnl_pct")
    win, loss = F.avg(F.when(pnl > 0, pnl)), F.avg(F.when(pnl < 0, -pnl))
    n, marked = F.count("*"), F.count("followed_rule")
    kept = F.when(marked > 0, F.count_if("followed_rule") * 100.0 / marked)
    sums = trades.where("status = 'closed'").groupBy("market").agg(n.alias("sample_size"), kept.alias("discipline"), win.alias("win"), loss.alias("loss"), (F.count_if(pnl > 0) * 100.0 / n).alias("won"))
    ratio = F.col("win") / F.col("loss")
    passed = (F.col("discipline") >= discipline_target) & (F.coalesce(F.col("win"), F.lit(0.0)) / F.col("loss") >= ratio_target) & (F.col("sample_size") >= sample_target)
    return sums.select("market", "sample_size", F.round("discipline", 1).alias("discipline_rate"), F.round(F.coalesce("win", F.lit(0.0)), 2).alias("avg_win_pct"), F.round(F.coalesce("loss", F.lit(0.0)), 2).alias("avg_loss_pct"), F.round(ratio, 2).alias("profit_loss_ratio"), F.round("won", 1).alias("win_rate"), F.coalesce(passed, F.lit(False)).alias("passed"))


def click_rates(usage: DataFrame, top: int = 10) -> DataFrame:
    """Most clicked dimensions with their rate in percent; a side that is missing counts as 0."""
    side = lambda metric, out: usage.where(F.col("metric") == metric).groupBy("dimension").agg(F.sum("value").alias(out))
    both = side("view", "views").join(side("click", "clicks"), "dimension", "full_outer").fillna(0, ["views", "clicks"])
    rate = F.when(F.col("views") > 0, F.round((F.col("clicks") * 100).cast("decimal(20,6)") / F.col("views"), 1).cast("double")).otherwise(0.0)
    return both.where("clicks > 0").withColumn("rate", rate).orderBy(F.desc("clicks"), "dimension").limit(top)


def usage_trend(usage: DataFrame) -> DataFrame:
    """Sums of each day and metric."""
    return usage.groupBy("date", "metric").agg(F.sum("value").alias("total"))
