"""Path-dependent indicators: folds over the bars of a series in time order.

A series is gathered into one sorted array (its length is the number of trading
days, not of rows overall) and folded with ``aggregate`` inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spans of the exponential means, and the period of the Wilder indicators.
EMA_PERIODS = (5, 10, 20, 50, 120, 200)
WILDER = 14


def series(bars: DataFrame, *columns: str) -> DataFrame:
    """(code, s): the bars of each series as a sorted array of structs."""
    return bars.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("trade_date", *(F.col(c).cast("double").alias(c) for c in columns)))).alias("s"))


def ema(bars: DataFrame, least_rows: int = 20, digits: int | None = 6) -> DataFrame:
    """Exponential means of the closes, seeded by the first close and rounded to ``digits`` where given; series under ``least_rows`` rows are left out."""
    closes = series(bars, "close").where(F.size("s") >= least_rows).select("code", F.col("s.close").alias("c"))
    fold = lambda p: F.aggregate("c", F.element_at("c", 1), lambda a, x: a + (x - a) * F.lit(2 / (p + 1)))
    return closes.select("code", *((fold(p) if digits is None else F.round(fold(p), digits)).alias(f"ema{p}") for p in EMA_PERIODS))


def wilder_mean(side: Column, period: int) -> Column:
    """Mean of the first ``period`` values, then smoothed one by one."""
    seed = F.aggregate(F.slice(side, 1, period), F.lit(0.0), lambda a, x: a + x) / period
    return F.aggregate(F.slice(side, period + 1, F.greatest(F.size(side) - period, F.lit(0))), seed, lambda a, x: (a * (period - 1) + x) / period)


def rsi_of(closes: Column, period: int = WILDER) -> Column:
    """Index of an array of closes; 100 without losses, null under period + 1 of them."""
    n = F.size(closes)
    moves = F.when(n > period, F.zip_with(F.slice(closes, 2, n - 1), F.slice(closes, 1, n - 1), lambda x, y: x - y))
    gain, loss = (wilder_mean(F.transform(moves, f), period) for f in (lambda x: F.greatest(x, F.lit(0.0)), lambda x: F.greatest(-x, F.lit(0.0))))
    return F.round(F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss)), 6)


def rsi(bars: DataFrame, period: int = WILDER) -> DataFrame:
    """Wilder's relative strength index of each series."""
    return series(bars, "close").select("code", rsi_of(F.col("s.close"), period).alias("rsi"))


def moves(bars: DataFrame, *columns: str | Column) -> DataFrame:
    """True range and directional moves of each bar against the one before; the first has none."""
    w = Window.partitionBy("code").orderBy("trade_date")
    d = lambda c: F.col(c).cast("double")
    before = lambda c: F.lag(d(c)).over(w)
    up, down = d("high") - before("high"), before("low") - d("low")
    first = before("close").isNull()
    return bars.select(
        "code",
        "trade_date",
        F.when(~first, F.greatest(d("high") - d("low"), F.abs(d("high") - before("close")), F.abs(d("low") - before("close")))).alias("tr"),
        F.when((up > down) & (up > 0), up).otherwise(0.0).alias("plus"),
        F.when((down > up) & (down > 0), down).otherwise(0.0).alias("minus"),
        *columns,
    )


def adx_of(steps: Column, period: int = WILDER) -> Column:
    """Directional index of an array of structs (tr, plus, minus), the first bar left out; null under 2 * period steps. Its seed is the mean of period + 1 values."""
    start = F.struct(F.lit(0).alias("i"), *(F.lit(0.0).alias(c) for c in ("tr", "plus", "minus", "adx")))

    def step(s: Column, x: Column) -> Column:
        i = s["i"] + 1
        smooth = lambda c: F.when(i <= period, s[c] + x[c] / period).otherwise(s[c] * (1 - 1 / period) + x[c] / period)
        tr, plus, minus = smooth("tr"), smooth("plus"), smooth("minus")
        dx = F.when((tr > 0) & (plus + minus > 0), 100 * F.abs(plus - minus) / (plus + minus)).otherwise(0.0)
        late = F.when(i < period, 0.0).when(i <= 2 * period, s["adx"] + dx / (period + 1)).otherwise(s["adx"] * (1 - 1 / period) + dx / period)
        return F.struct(i.alias("i"), tr.alias("tr"), plus.alias("plus"), minus.alias("minus"), late.alias("adx"))

    return F.aggregate(steps, start, step, lambda f: F.when(f["i"] >= 2 * period, F.round(f["adx"], 6)))


def adx(bars: DataFrame, period: int = WILDER) -> DataFrame:
    """Wilder's directional index of each series."""
    steps = moves(bars).groupBy("code").agg(F.array_sort(F.collect_list(F.struct("trade_date", "tr", "plus", "minus"))).alias("s"))
    return steps.select("code", adx_of(F.filter("s", lambda x: x["tr"].isNotNull()), period).alias("adx"))


def signal_columns() -> list[Column]:
    """Means over 20 and 50 full bars, whether the close reaches the prior 20-bar high, and volume and amount against their means."""
    w = Window.partitionBy("code").orderBy("trade_date")

    def sma(n: int) -> Column:
        full = w.rowsBetween(1 - n, 0)
        return F.when(F.count("close").over(full) == n, F.sum("close").over(full).cast("double") / n)

    prior, twenty = w.rowsBetween(-20, -1), w.rowsBetween(-19, 0)
    ratio = F.when(F.count("volume").over(prior) == 20, F.col("volume") / (F.sum("volume").over(prior).cast("double") / 20))
    return [
        F.col("close").cast("double").alias("close"),
        sma(20).alias("sma20"),
        sma(50).alias("sma50"),
        F.when(F.count("high").over(prior) == 20, F.col("close") >= F.max("high").over(prior)).alias("new_high"),
        ratio.alias("ratio"),
        F.round(F.col("volume") / (F.sum("volume").over(twenty).cast("double") / F.count("volume").over(twenty)), 2).alias("volume_ratio"),
        (F.sum("amount").over(twenty).cast("double") / F.count("amount").over(twenty)).alias("amount20"),
    ]


def _latest_signals(marked: DataFrame, *columns: Column) -> DataFrame:
    """Of bars with ``signal_columns``, the latest of each series with its rules; ``columns`` are further aggregates of a series."""
    w = Window.partitionBy("code").orderBy("trade_date")
    sloped = marked.select("*", F.lag("sma20", 5).over(w).alias("b20"), F.lag("sma50", 5).over(w).alias("b50"), F.max("ratio").over(w.rowsBetween(-2, 0)).alias("surge"))
    kept = ("close", "sma20", "sma50", "b20", "b50", "new_high", "surge", "volume_ratio", "amount20")
    last = sloped.groupBy("code").agg(F.max_by(F.struct(*kept), "trade_date").alias("x"), F.max("trade_date").alias("last_date"), F.count("*").alias("n"), *columns)
    rule = lambda c: F.coalesce(F.expr(c), F.lit(False))
    return last.select("*", rule("x.close > x.sma20 and x.sma20 > x.sma50 and x.sma20 > x.b20 and x.sma50 > x.b50").alias("t1"), rule("x.new_high").alias("t3"), rule("x.surge >= 1.5").alias("t4"), F.col("x.volume_ratio").alias("volume_ratio"), F.col("x.amount20").alias("amount20"))


def trend_signals(bars: DataFrame) -> DataFrame:
    """Latest bar of each series: close over rising means, a close at the prior 20-bar high or above, 1.5 times the prior volume within three bars, and volume against the 20-bar mean that includes it."""
    return _latest_signals(bars.select("code", "trade_date", *signal_columns())).select("code", "t1", "t3", "t4", "volume_ratio")


def trend_screen(bars: DataFrame, least_amount: float = 2e7, stale_days: int = 3, least_rows: int = 55, newest: DataFrame | None = None) -> DataFrame:
    """The five trend rules with the score 0.4 strength + 0.3 momentum + 0.3 volume, null where an index is; one shuffle by series.

    ``liquid``, ``fresh`` and ``long_enough`` are the filters before the rules:
    mean amount of 20 bars, days behind the latest bar of all (``newest``, where these
    are not all), number of bars.
    """
    steps = F.array_sort(F.collect_list(F.struct("trade_date", "tr", "plus", "minus", "close"))).alias("s")
    last = _latest_signals(moves(bars, *signal_columns()), steps)
    found = last.select("*", rsi_of(F.col("s.close")).alias("rsi"), adx_of(F.filter("s", lambda x: x["tr"].isNotNull())).alias("adx"))
    newest = bars.agg(F.max("trade_date").alias("newest")) if newest is None else newest
    part = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    two = lambda c: F.round(c, 2)
    score = 0.4 * F.least(F.lit(1.0), two("adx") / 50) + 0.3 * part((two("rsi") - 50) / 30) + 0.3 * F.least(F.lit(1.0), F.col("volume_ratio") / 3)
    rule = lambda c: F.coalesce(c, F.lit(False))
    out = found.crossJoin(F.broadcast(newest))  # one row
    return out.select(
        "code",
        (F.col("amount20") >= least_amount).alias("liquid"),
        (F.col("last_date") >= F.date_sub("newest", stale_days)).alias("fresh"),
        (F.col("n") >= least_rows).alias("long_enough"),
        "t1",
        rule(two("adx") > 25).alias("t2"),
        "t3",
        "t4",
        rule((two("rsi") > 50) & (two("rsi") < 80)).alias("t5"),
        F.when(F.col("rsi").isNotNull() & F.col("adx").isNotNull(), F.round(score, 3)).alias("score"),
    )
