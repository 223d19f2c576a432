"""Streaming counterparts of the periodic jobs: dedup of seen keys and daily counters, state bounded by watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def timed(stream: DataFrame, time: str) -> DataFrame:
    """Watermarks want a zoned time; zone-less times count in the session's zone."""
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def unseen(stream: DataFrame, key: str, time: str = "ts", horizon: str = "7 days") -> DataFrame:
    """The first row of each key within ``horizon``; later rows than the watermark are dropped."""
    return timed(stream, time).withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])


def daily_counters(stream: DataFrame, metric: str, time: str = "ts", late: str = "1 day") -> DataFrame:
    """(date, metric, value) of each day, emitted once the watermark has passed it in append mode."""
    days = timed(stream, time).withWatermark(time, late).groupBy(F.window(time, "1 day").alias("day"), F.col(metric).alias("metric")).agg(F.count("*").alias("value"))
    return days.select(F.to_date("day.start").alias("date"), "metric", "value")


def recent(stream: DataFrame, time: str = "ts", days: int = 7, now: Column | None = None) -> DataFrame:
    """Rows of the last ``days`` days; rows without a time stay."""
    since = (F.current_timestamp() if now is None else now) - F.make_dt_interval(F.lit(days))
    return stream.where(F.col(time).isNull() | (F.col(time) >= since))


def committed(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived to ``path``, a folder a batch: a batch counts once its write has succeeded, and one tried again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
