"""Cross-sectional indicators over daily bars: one aggregation a series, windows partitioned by series.

Bars have (code, trade_date, open, high, low, close, volume, amount, name,
market) with decimal prices. The current day is the latest one in them; the scan
that makes them takes the day and how far back to read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIODS = {"p3": 63, "p6": 126, "p9": 189, "p12": 252}
WEIGHTS = {"p3": 0.4, "p6": 0.2, "p9": 0.2, "p12": 0.2}


def newest_first(bars: DataFrame) -> DataFrame:
    """Adds rn: 1 for the latest bar of a series."""
    return bars.withColumn("rn", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("trade_date"))))


def mean_of(x: Column | str) -> Column:
    """Mean of decimals as double, the same whatever the order of the rows."""
    return F.sum(x).cast("double") / F.count(x)


def percent_rank_average(df: DataFrame, value: str, out: str) -> DataFrame:
    """Average-tie percentile rank of ``value`` over all rows.

    Distinct values are counted first, so the global window sees one row a
    distinct value instead of one a row.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("_ties"))
    below = F.sum("_ties").over(Window.orderBy(value))
    total = F.sum("_ties").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranks = counts.select(value, ((below - (F.col("_ties") - 1) / 2) / total).alias(out))
    return df.join(ranks, value)


def rs_rating(bars: DataFrame, min_days: int = 63) -> DataFrame:
    """Relative strength: weighted returns over four periods, renormalised over known ones, ranked to 1..99."""
    valid = bars.where("close > 0")
    ranked = newest_first(valid).withColumn("days", F.count("*").over(Window.partitionBy("code")))
    at = lambda k: F.max(F.when(F.col("rn") == k, F.col("close")))
    wide = ranked.groupBy("code").agg(F.max("name").alias("name"), F.max("trade_date").alias("trade_date"), F.max("days").alias("days"), at(1).alias("last"), *(at(k).alias(p) for p, k in PERIODS.items()))
    wide = wide.where((F.col("days") >= min_days) & F.col("p3").isNotNull())
    roc = lambda p: F.round(((F.col("last").cast("double") / F.col(p).cast("double") - 1) * 100).cast("decimal(20,8)"), 2).cast("double")
    wide = wide.select("code", "name", "trade_date", *(roc(p).alias(p) for p in PERIODS))
    weight = sum(F.when(F.col(p).isNotNull(), F.lit(w)).otherwise(0.0) for p, w in WEIGHTS.items())
    value = sum(F.coalesce(F.col(p) * w, F.lit(0.0)) for p, w in WEIGHTS.items())
    scored = wide.withColumn("score", F.round((value / weight).cast("decimal(20,8)"), 4).cast("double"))
    rated = percent_rank_average(scored, "score", "_rank")
    rating = F.bround((F.col("_rank") * 98 + 1).cast("decimal(12,6)"), 0).cast("int")
    return rated.select("code", "name", "trade_date", *PERIODS, "score", F.greatest(F.lit(1), F.least(F.lit(99), rating)).alias("rs_rating"))


def price_extremes(bars: DataFrame) -> DataFrame:
    """Lowest low of 120 bars, highest high of 60, mean volume of 50, latest close and volume."""
    rn = F.col("rn")
    return newest_first(bars).groupBy("code").agg(
        F.min(F.when(rn <= 120, F.col("low"))).cast("double").alias("low_120"),
        F.max(F.when(rn <= 60, F.col("high"))).cast("double").alias("high_60"),
        mean_of(F.when(rn <= 50, F.col("volume"))).alias("volume_50"),
        F.max(F.when(rn == 1, F.col("volume"))).alias("volume"),
        F.max(F.when(rn == 1, F.col("close"))).cast("double").alias("close"),
    )


def trend_inputs(bars: DataFrame) -> DataFrame:
    """Inputs of the eight-rule template: means over 50, 150 and 200 bars, an older 200-bar mean, 250-bar extremes."""
    rn, close, n = F.col("rn"), F.col("close"), F.count("*")
    upto = lambda k: mean_of(F.when(rn <= k, close))
    return newest_first(bars).groupBy("code").agg(
        F.max(F.when(rn == 1, close)).cast("double").alias("price"),
        F.when(n >= 50, upto(50)).alias("ma50"),
        F.when(n >= 150, upto(150)).alias("ma150"),
        F.when(n >= 200, upto(200)).alias("ma200"),
        F.when(n >= 200, mean_of(F.when(rn.between(22, 222), close))).alias("ma200_before"),
        F.max(F.when(rn <= 250, F.col("high"))).cast("double").alias("high52w"),
        F.min(F.when(rn <= 250, F.col("low"))).cast("double").alias("low52w"),
    )


def trend_template(inputs: DataFrame, ratings: DataFrame) -> DataFrame:
    """The eight rules as booleans; a missing input fails its rule."""
    rule = lambda c: F.coalesce(c, F.lit(False))
    c = F.col
    joined = inputs.join(ratings.select("code", "rs_rating"), "code", "left")
    rules = [
        (c("price") > c("ma150")) & (c("price") > c("ma200")),
        c("ma150") > c("ma200"),
        c("ma200") > c("ma200_before"),
        (c("ma50") > c("ma150")) & (c("ma50") > c("ma200")),
        c("price") > c("ma50"),
        (c("low52w") > 0) & ((c("price") - c("low52w")) / c("low52w") >= 0.25),
        (c("high52w") > 0) & ((c("high52w") - c("price")) / c("high52w") <= 0.25),
        c("rs_rating") >= 70,
    ]
    out = joined.select("code", *(rule(r).alias(f"rule{i}") for i, r in enumerate(rules, 1)))
    names = [f"rule{i}" for i in range(1, 9)]
    passed = sum(c(n).cast("int") for n in names)
    return out.withColumn("n_passed", passed).withColumn("all_pass", passed == 8)


def market_breadth(bars: DataFrame) -> DataFrame:
    """Share of each market's pool whose latest close is at or above its 20-row mean, on the market's latest day."""
    w = Window.partitionBy("code").orderBy("trade_date").rowsBetween(-19, 0)
    pool = bars.where("close > 0 and volume > 0 and name not like '%ST%'")
    marked = pool.select("market", "code", "trade_date", F.col("close").cast("double").alias("close"), (F.sum("close").over(w).cast("double") / F.count("close").over(w)).alias("ma20"))
    latest = pool.groupBy("market").agg(F.max("trade_date").alias("trade_date"))
    day = marked.join(latest, ["market", "trade_date"])
    share = F.sum((F.col("close") >= F.col("ma20")).cast("int")) * F.lit(100).cast("decimal(10,4)") / F.count("*")
    return day.groupBy("market", "trade_date").agg(F.count("*").alias("pool"), F.round(share, 2).cast("double").alias("breadth_pct"))


def turnover_ratio(bars: DataFrame, days: int = 25) -> DataFrame:
    """Amount of a market's latest day against the mean of its earlier days at most ``days`` calendar days back, in percent; null under five of them."""
    daily = bars.groupBy("market", "trade_date").agg(F.sum("amount").alias("amount"))
    latest = daily.groupBy("market").agg(F.max("trade_date").alias("last"))
    near = daily.join(latest, "market").where(F.col("trade_date") >= F.date_sub("last", days))
    before = F.when(F.col("trade_date") < F.col("last"), F.col("amount"))
    today = F.max(F.when(F.col("trade_date") == F.col("last"), F.col("amount"))).cast("double")
    return near.groupBy("market").agg(F.count(before).alias("n_before"), F.when(F.count(before) >= 5, F.round(today / mean_of(before) * 100, 2)).alias("turnover_pct"))


def breakout_efficacy(bars: DataFrame) -> DataFrame:
    """For each market: breakouts over the prior 60-bar high of closes on 1.2 times the 20-bar volume or more, full windows only.

    Counted are those 30 to 5 days before the market's latest day that have
    five later bars, the share of them that gain by then, and those of that day.
    """
    w = Window.partitionBy("code").orderBy("trade_date")
    prior, twenty = w.rowsBetween(-60, -1), w.rowsBetween(-19, 0)
    pool = bars.where("close > 0 and volume > 0 and name not like '%ST%'")
    marked = pool.select(
        "market", "trade_date", "close", "volume",
        F.when(F.count("close").over(prior) == 60, F.max("close").over(prior)).alias("high60"),
        F.when(F.count("volume").over(twenty) == 20, F.sum("volume").over(twenty).cast("double") / 20).alias("vol20"),
        F.lead("close", 5).over(w).alias("later"),
    )
    latest = pool.groupBy("market").agg(F.max("trade_date").alias("last"))
    hit = marked.where((F.col("close") > F.col("high60")) & (F.col("volume") >= 1.2 * F.coalesce("vol20", F.lit(0.0))))
    counted = F.col("trade_date").between(F.date_sub("last", 30), F.date_sub("last", 5)) & F.col("later").isNotNull()
    joined = latest.join(hit, "market", "left")
    sample = F.count_if(counted)
    share = F.count_if(counted & (F.col("later") > F.col("close"))) * F.lit(100).cast("decimal(10,4)") / sample
    return joined.groupBy("market", "last").agg(sample.alias("sample_count"), F.when(sample > 0, F.round(share, 2).cast("double")).alias("positive_ratio"), F.count_if(F.col("trade_date") == F.col("last")).alias("breakout_today"))


def daily_changes(bars: DataFrame) -> DataFrame:
    """Mean change of each market and day over its series, names with ST left out."""
    w = Window.partitionBy("code").orderBy("trade_date")
    change = F.col("close").cast("double") / F.lag("close").over(w).cast("double") - 1
    return bars.where("name not like '%ST%'").withColumn("change", change).where("change is not null").groupBy("market", "trade_date").agg(F.avg("change").alias("change"), F.count("*").alias("n"))


def equal_weight_index(bars: DataFrame, days: int = 420) -> DataFrame:
    """Mean daily change of each market compounded from 1000, from ``days`` days before its latest; levels to seven digits."""
    daily = daily_changes(bars)
    latest = daily.groupBy("market").agg(F.max("trade_date").alias("last"))
    near = daily.join(latest, "market").where(F.col("trade_date") >= F.date_sub("last", days))
    path = Window.partitionBy("market").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    level = F.exp(F.sum(F.log1p("change")).over(path)) * 1000
    return near.select("market", "trade_date", "n", F.round("change", 9).alias("mean_change"), F.format_string("%.6e", level).cast("double").alias("level"))


def price_trend(bars: DataFrame) -> DataFrame:
    """Sum of the last five daily changes in percent, as a label."""
    w = Window.partitionBy("code").orderBy("trade_date")
    change = F.round(((F.col("close").cast("double") / F.lag("close").over(w).cast("double") - 1) * 100).cast("decimal(20,8)"), 2)
    moves = newest_first(bars.withColumn("pct", change)).where("rn <= 5")
    total = F.sum("pct")
    return moves.groupBy("code").agg(total.cast("double").alias("sum_pct")).withColumn("trend", F.when(F.col("sum_pct") <= -10, "strong_down").when(F.col("sum_pct") <= -5, "down").otherwise("flat_or_up"))


def quantile_close(bars: DataFrame, q: float = 0.9, n: int = 60) -> DataFrame:
    """Linear-interpolated quantile of the last ``n`` closes; null under ten."""
    last = newest_first(bars).where(F.col("rn") <= n)
    value = F.round(F.expr(f"percentile(cast(close as double), {q})").cast("decimal(20,8)"), 6).cast("double")
    return last.groupBy("code").agg(F.when(F.count("*") >= 10, value).alias("quantile_close"))


def range_contraction(bars: DataFrame) -> DataFrame:
    """Ranges of 40 and 10 bars against the latest close, mean volume of bars that close below their open in the last five, mean volume of 50."""
    rn = F.col("rn")
    down = bars.withColumn("down", F.col("close") < F.col("open"))
    spread = lambda k: (F.max(F.when(rn <= k, F.col("high"))) - F.min(F.when(rn <= k, F.col("low")))).cast("double") / F.max(F.when(rn == 1, F.col("close"))).cast("double")
    falling = F.when((rn <= 5) & F.col("down"), F.col("volume"))
    return newest_first(down).groupBy("code").agg(
        F.count("*").alias("n"), spread(40).alias("range40"), spread(10).alias("range10"), F.coalesce(mean_of(falling), F.lit(0.0)).alias("down_volume"), mean_of(F.when(rn <= 50, F.col("volume"))).alias("volume_50")
    ).where("n >= 10").drop("n")


def point_of_control(bars: DataFrame, bins: int = 20, n: int = 120) -> DataFrame:
    """Middle of the close bin with most volume over the last ``n`` bars; the price itself if flat; null under 20 bars."""
    last = newest_first(bars).where(F.col("rn") <= n).select("code", F.col("close").cast("double").alias("close"), "volume")
    span = last.groupBy("code").agg(F.min("close").alias("low"), F.max("close").alias("high"), F.count("*").alias("n"))
    width = (F.col("high") - F.col("low")) / bins
    binned = last.join(span, "code").withColumn("bin", F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("close") - F.col("low")) / width))).cast("int"))
    sums = binned.groupBy("code", "bin", "low", "high", "n").agg(F.sum("volume").alias("v"))
    best = sums.groupBy("code", "low", "high", "n").agg(F.max_by("bin", F.struct(F.col("v"), -F.col("bin"))).alias("bin"))
    mid = F.col("low") + (F.col("bin") + 0.5) * width
    return best.select("code", F.when(F.col("n") >= 20, F.when(F.col("high") == F.col("low"), F.col("low")).otherwise(mid)).alias("poc"))


def benchmark_derived(index: DataFrame) -> DataFrame:
    """For each market's index (market, trade_date, change): latest level, means over 20 and 60 days and their direction over five, 20-day volatility a year, its shock over five, and its rank in 250."""
    w = Window.partitionBy("market").orderBy("trade_date")
    full = lambda n, x: F.when(F.count(x).over(w.rowsBetween(1 - n, 0)) == n, F.avg(x).over(w.rowsBetween(1 - n, 0)))
    twenty = w.rowsBetween(-19, 0)
    vol = F.when(F.count("change").over(twenty) == 20, F.stddev_samp("change").over(twenty) * F.sqrt(F.lit(252.0)))
    marked = index.withColumn("close", F.exp(F.sum(F.log1p("change")).over(w.rowsBetween(Window.unboundedPreceding, 0))) * 1000)
    marked = marked.select("*", full(20, "close").alias("ma20"), full(60, "close").alias("ma60"), vol.alias("vol"))
    before = {f"{c}_before": F.lag(c, 5).over(w) for c in ("ma20", "ma60", "vol")}
    marked = marked.withColumns(before).withColumn("rn", F.row_number().over(Window.partitionBy("market").orderBy(F.desc("trade_date"))))
    last = marked.where("rn = 1").selectExpr("market", "trade_date", "close > ma20 AS above_ma20", "close > ma60 AS above_ma60", "ma20 > ma20_before AS ma20_up", "ma60 < ma60_before AS ma60_down", "vol AS now", "vol / vol_before - 1 AS shock")
    rank = marked.where("rn <= 250 and vol is not null").join(last.select("market", "now"), "market").groupBy("market").agg((F.sum((F.col("vol") <= F.col("now") + 1e-12).cast("int")) * 100.0 / F.count("*")).alias("vol_pct_250"))
    return last.join(rank, "market", "left").select("market", "trade_date", "above_ma20", "above_ma60", "ma20_up", "ma60_down", F.round("now", 6).alias("vol20"), F.round("shock", 6).alias("vol_shock"), F.round("vol_pct_250", 4).alias("vol_pct_250"))


def adaptability(derived: DataFrame, breadth: DataFrame, breakout: DataFrame, turnover: DataFrame) -> DataFrame:
    """Scores of five dimensions (25, 20, 20, 25 and 10 points), their level (70 and 45), and the level after demotions in order: broken trend, volatility shock, failing breakouts."""
    j = derived.join(breadth.select("market", "breadth_pct"), "market", "left").join(breakout.drop("last"), "market", "left").join(turnover.select("market", "turnover_pct"), "market", "left")
    met = "int(above_ma20) + int(above_ma60) + int(coalesce(ma20_up, false))"
    scored = j.selectExpr(
        "*",
        f"CASE WHEN above_ma60 IS NULL THEN 0 ELSE element_at(array(0, 5, 15, 25), {met} + 1) END AS trend",
        "CASE WHEN breadth_pct > 60 THEN 20 WHEN breadth_pct >= 45 THEN 14 WHEN breadth_pct >= 30 THEN 7 ELSE 0 END AS breadth",
        "CASE WHEN vol_pct_250 IS NULL THEN 5 WHEN vol_shock >= 0.3 THEN 0 WHEN vol_pct_250 BETWEEN 30 AND 60 THEN 20 WHEN vol_pct_250 BETWEEN 20 AND 75 THEN 12 ELSE 5 END AS volatility",
        "CASE WHEN coalesce(sample_count, 0) < 20 OR positive_ratio IS NULL THEN 12 WHEN positive_ratio > 65 THEN 25 WHEN positive_ratio >= 50 THEN 18 WHEN positive_ratio >= 35 THEN 8 ELSE 0 END AS breakout",
        "CASE WHEN turnover_pct > 110 THEN 10 WHEN turnover_pct >= 90 THEN 7 WHEN turnover_pct >= 80 THEN 3 ELSE 0 END AS activity",
    )
    total = scored.selectExpr("*", "trend + breadth + volatility + breakout + activity AS total")
    based = total.selectExpr("*", "CASE WHEN total >= 70 THEN 2 WHEN total >= 45 THEN 1 ELSE 0 END AS base")  # 2 favourable, 1 neutral, 0 cautious
    one = based.selectExpr("*", "CASE WHEN NOT above_ma60 AND coalesce(ma60_down, false) THEN least(base, 1) ELSE base END AS l1")
    two = one.selectExpr("*", "CASE WHEN coalesce(vol_shock, 0) >= 0.3 THEN greatest(l1 - 1, 0) ELSE l1 END AS l2")
    final = "CASE WHEN sample_count >= 20 AND positive_ratio < 30 THEN 0 ELSE l2 END"
    name = lambda x: f"element_at(array('cautious', 'neutral', 'favorable'), {x} + 1)"
    return two.selectExpr("market", "trend", "breadth", "volatility", "breakout", "activity", "total", f"{name('base')} AS base_level", f"{name(final)} AS level")
