"""Dated snapshots of moving averages: one step a day by a join, the last one found by its partition."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import folds
from marlstone.plans.folds import ORACLES as FOLDS
from marlstone.session import fresh_folder
from marlstone.sources.adapters import AS_OF, quotes
from marlstone.sources.sinks import replace_partitions

DAY = "snapshot_date"
STEPS = 5


def ema_columns() -> list[str]:
    return [f"ema{p}" for p in folds.EMA_PERIODS]


def step(before: DataFrame, closes: DataFrame) -> DataFrame:
    """Averages (code, ema...) moved on by closes (code, close); a series without a close stays as it is."""
    close = F.col("close").cast("double")
    moved = [F.coalesce(F.col(f"ema{p}") + (close - F.col(f"ema{p}")) * F.lit(2 / (p + 1)), F.col(f"ema{p}")).alias(f"ema{p}") for p in folds.EMA_PERIODS]
    return before.join(closes.select("code", "close").dropDuplicates(["code"]), "code", "left").select("code", *moved)


def save(averages: DataFrame, path: str, day: date | str) -> None:
    """Write the snapshot of a day, in place of an earlier one of that day."""
    replace_partitions(averages.withColumn(DAY, F.lit(str(day)).cast("date")), path, DAY)


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The snapshot of the last day at ``path``, which the names of its partitions tell; None without one."""
    try:
        stored = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    last = stored.agg(F.max(DAY)).first()[0]
    return None if last is None else stored.where(F.col(DAY) == F.lit(last))


def ema_steps(spark: SparkSession, sf_dir: str, steps: int = STEPS, as_of: str = AS_OF) -> DataFrame:
    """The averages of a day, by so many daily steps from a snapshot of the history before them: each reads the last snapshot, joins that day's closes and writes the next."""
    bars = quotes(spark, sf_dir, as_of)
    days = [r[0] for r in bars.select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(steps).collect()][::-1]
    path = fresh_folder(spark, "ema-snapshots")
    history = folds.ema(bars.where(F.col("trade_date") < F.lit(days[0])), digits=None) if days else folds.ema(bars, digits=None)
    save(history, path, "1900-01-01")
    for day in days:
        save(step(latest(spark, path).drop(DAY), bars.where(F.col("trade_date") == F.lit(day))), path, day)
    return latest(spark, path).select("code", *(F.round(c, 6).alias(c) for c in ema_columns()))


QUERIES = {"ema_steps": ema_steps}
#: Steps end where the whole history does, for series that had enough bars before them.
ORACLES = {"ema_steps": f"SELECT h.* FROM ({FOLDS['ema_history']}) AS h JOIN (SELECT l_suppkey AS code FROM lineitem WHERE l_shipdate >= DATE '{AS_OF}' - 1600 AND l_shipdate < (SELECT min(day) FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_shipdate < DATE '{AS_OF}' + 1 ORDER BY 1 DESC LIMIT {STEPS})) GROUP BY l_suppkey HAVING count(DISTINCT CAST(l_shipdate AS DATE)) >= 20) AS b ON b.code = h.code"}
