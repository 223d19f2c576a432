"""Round trips through the sinks: each query writes a keyed table twice and returns what is stored then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources import sinks
from marlstone.sources.adapters import CLOSED_TRADES, NEWS, QUOTES, USAGE, closed_trades, news, quotes, usage, with_views

SPLIT = "2001-05-01"


def _bars(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored bars, and incoming ones that overlap them: some without a name, all with one more unit of volume."""
    q = quotes(spark, sf_dir).select("code", "trade_date", F.col("close").cast("double").alias("close"), "volume", "name", "market")
    late = q.where(F.col("trade_date") >= F.date_sub(F.lit(SPLIT).cast("date"), 60))
    return q.where(F.col("trade_date") < SPLIT), late.withColumns({"volume": F.col("volume") + 1, "name": F.when(F.col("code") % 2 == 0, "").otherwise(F.concat("name", F.lit("*")))})


def _stored(spark: SparkSession, df: DataFrame, name: str, *by: str) -> tuple[str, DataFrame]:
    path = sinks.scratch(spark, name)
    df.write.partitionBy(*by).parquet(path)
    return path, spark.read.parquet(path).select(*df.columns)


def quote_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert on (code, trade_date) that keeps a stored name where the new one is empty; markets are replaced one partition each."""
    first, late = _bars(spark, sf_dir)
    _, stored = _stored(spark, first, "bars", "market")
    path = sinks.scratch(spark, "bars-after")
    sinks.replace_partitions(sinks.upsert(stored, late, ["code", "trade_date"], keep_old=("name",)), path, "market")
    return spark.read.parquet(path).where(F.col("trade_date") >= F.date_sub(F.lit(SPLIT).cast("date"), 90)).select(*first.columns)


def quote_upsert_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert that overwrites all measures."""
    first, late = _bars(spark, sf_dir)
    path, stored = _stored(spark, first, "bars", "market")
    after = sinks.upsert(stored, late, ["code", "trade_date"])
    return after.groupBy("market", "name").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


def url_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append of articles whose address is not stored; the oldest of each address wins."""
    n = news(spark, sf_dir).select("id", "url", "source")
    path = sinks.scratch(spark, "urls")
    n.where("id % 3 = 0").groupBy("url").agg(F.min("id").alias("id"), F.min_by("source", "id").alias("source")).select("id", "url", "source").write.parquet(path)
    sinks.append(sinks.insert_ignore(spark.read.parquet(path), n, "url", "id"), path)
    return spark.read.parquet(path)


def event_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events upserted by coalescing; the time moves only with a material change."""
    n = news(spark, sf_dir).where("related_to_id is null")
    stored = n.where("id % 4 != 0").selectExpr("id", "title", "status", "published AS updated")
    incoming = n.where("id % 3 = 0").selectExpr("id", "CASE WHEN id % 2 = 0 THEN title || '!' END AS title", "'stable' AS status", "published + 3600 AS updated", "id % 5 = 0 AS material")
    path = sinks.scratch(spark, "events")
    stored.write.parquet(path)
    return sinks.upsert_material(spark.read.parquet(path), incoming, "id", "updated", "material")


def version_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append of versions that are not stored under (event, version)."""
    n = news(spark, sf_dir).selectExpr("coalesce(related_to_id, id) AS event_id", "id - coalesce(related_to_id, id) + 1 AS version", "id", "concat_ws(':', coalesce(related_to_id, id), id - coalesce(related_to_id, id) + 1) AS k")
    path = sinks.scratch(spark, "versions")
    n.where("version = 1").write.parquet(path)
    sinks.append(sinks.insert_ignore(spark.read.parquet(path), n, "k", "id"), path)
    return spark.read.parquet(path).drop("k")


def counter_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by (date, metric), with deltas added to what is stored."""
    u = usage(spark, sf_dir).groupBy("date", "metric").agg(F.sum("value").alias("value"))
    path = sinks.scratch(spark, "counters")
    u.write.parquet(path)
    return sinks.add_counters(spark.read.parquet(path), u.where("metric = 'click'").withColumn("value", F.col("value") * 10), ["date", "metric"])


def partition_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of a list by day and market: the second replaces its own partitions only."""
    q = quotes(spark, sf_dir).where("trade_date >= date '2001-07-01'").select("code", "trade_date", "volume", "market")
    path = sinks.scratch(spark, "lists")
    sinks.replace_partitions(q, path, "trade_date", "market")
    sinks.replace_partitions(q.where("trade_date >= date '2001-07-20' and volume >= 30").withColumn("volume", -F.col("volume")), path, "trade_date", "market")
    return spark.read.parquet(path).select("code", F.col("trade_date").cast("date").alias("trade_date"), "volume", "market")


def trade_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades exported as CSV and imported again, good rows and a count of the bad ones by rule."""
    path = sinks.scratch(spark, "trade-csv")
    sinks.export_csv(closed_trades(spark, sf_dir).where("status = 'closed'").selectExpr("trade_id", "market", "amount", "CASE WHEN trade_id % 50 = 0 THEN 'n/a' ELSE cast(pnl_pct as string) END AS pnl_pct"), path, "trade_id")
    good, bad = sinks.import_csv(spark, path, "trade_id long, market string, amount double, pnl_pct double", {"amount": "amount > 1000", "pnl": "pnl_pct is not null and pnl_pct between -50 and 50"})
    return bad.groupBy("failed").agg(F.count("*").alias("n")).unionByName(good.select(F.lit("none").alias("failed")).groupBy("failed").agg(F.count("*").alias("n")))


QUERIES = {f.__name__: f for f in (quote_upsert, quote_upsert_plain, url_insert_ignore, event_upsert, version_insert, counter_upsert, partition_replace, trade_csv)}

_BARS = f""",
q AS (SELECT code, trade_date, CAST(close AS DOUBLE) AS close, volume, name, market FROM quotes),
x AS (SELECT *, 0 AS new FROM q WHERE trade_date < DATE '{SPLIT}' UNION ALL SELECT code, trade_date, close, volume + 1 AS volume, CASE WHEN code % 2 = 0 THEN '' ELSE name || '*' END AS name, market, 1 AS new FROM q WHERE trade_date >= DATE '{SPLIT}' - 60),
r AS (SELECT *, row_number() OVER (PARTITION BY code, trade_date ORDER BY new DESC) AS rn, max(CASE WHEN new = 0 THEN name END) OVER (PARTITION BY code, trade_date) AS old_name FROM x)"""
ORACLES = {
    "quote_upsert": with_views(QUOTES, sql=_BARS + f" SELECT code, trade_date, close, volume, coalesce(nullif(name, ''), old_name) AS name, market FROM r WHERE rn = 1 AND trade_date >= DATE '{SPLIT}' - 90"),
    "quote_upsert_plain": with_views(QUOTES, sql=_BARS + " SELECT market, name, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume FROM r WHERE rn = 1 GROUP BY ALL"),
    "url_insert_ignore": with_views(NEWS, sql=", s AS (SELECT url, min(id) AS id FROM news WHERE id % 3 = 0 GROUP BY url), o AS (SELECT url, min(id) AS id FROM news WHERE url NOT IN (SELECT url FROM s) GROUP BY url), k AS (SELECT * FROM s UNION ALL SELECT * FROM o) SELECT k.id, k.url, news.source FROM k JOIN news ON news.id = k.id"),
    "event_upsert": with_views(
        NEWS,
        sql=""", n AS (SELECT * FROM news WHERE related_to_id IS NULL), s AS (SELECT id, title, status, published AS updated FROM n WHERE id % 4 != 0), i AS (SELECT id, CASE WHEN id % 2 = 0 THEN title || '!' END AS title, published + 3600 AS updated, id % 5 = 0 AS material FROM n WHERE id % 3 = 0)
SELECT coalesce(i.id, s.id) AS id, coalesce(i.title, s.title) AS title, CASE WHEN i.id IS NOT NULL THEN 'stable' ELSE s.status END AS status, CASE WHEN s.id IS NOT NULL AND NOT coalesce(material, false) THEN s.updated ELSE coalesce(i.updated, s.updated) END AS updated FROM s FULL JOIN i ON i.id = s.id""",
    ),
    "version_insert": with_views(NEWS, sql=" SELECT coalesce(related_to_id, id) AS event_id, id - coalesce(related_to_id, id) + 1 AS version, min(id) AS id FROM news GROUP BY ALL"),
    "counter_upsert": with_views(USAGE, sql=" SELECT date, metric, CAST(sum(value) * CASE WHEN metric = 'click' THEN 11 ELSE 1 END AS BIGINT) AS value FROM usage GROUP BY date, metric"),
    "partition_replace": with_views(
        QUOTES,
        sql=""", q AS (SELECT code, trade_date, volume, market FROM quotes WHERE trade_date >= DATE '2001-07-01'), s AS (SELECT * FROM q WHERE trade_date >= DATE '2001-07-20' AND volume >= 30)
SELECT q.* FROM q ANTI JOIN s USING (trade_date, market) UNION ALL SELECT code, trade_date, -volume AS volume, market FROM s""",
    ),
    "trade_csv": with_views(CLOSED_TRADES, sql=", c AS (SELECT CASE WHEN trade_id % 50 = 0 THEN 'parse' WHEN amount <= 1000 THEN 'amount' WHEN pnl_pct IS NULL THEN 'pnl' ELSE 'none' END AS failed FROM closed_trades WHERE status = 'closed') SELECT failed, count(*) AS n FROM c GROUP BY failed"),
}
