"""Streams run over the given tables until all has arrived, beside batch queries that say what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans.dialect import duck_query
from marlstone.plans.refinement import FAR, article_faces, fingerprints, masks
from marlstone.session import fresh_folder, table
from marlstone.sources import adapters
from marlstone.streaming import similarity, windows


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of files."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")


def arrived(stream: DataFrame) -> DataFrame:
    """All rows that ``stream`` gives for what is there now."""
    spark = stream.sparkSession
    path, checkpoint = (fresh_folder(spark, n) for n in ("stream", "stream-state"))
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def fingerprint_stream(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """(id, at, hi, lo) of a stream of documents."""
    return article_faces(spark, adapters.news(spark, sf_dir, docs)).withColumnRenamed("published", "at")


def near_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(older, newer, distance): each article with the first of each near fingerprint of the 24 hours before it."""
    links = similarity.near_fingerprints(fingerprint_stream(spark, sf_dir, read(spark, sf_dir, "documents")), masks(), FAR)
    path, checkpoint = (fresh_folder(spark, n) for n in ("links", "links-state"))
    similarity.run_to_table(links, path, checkpoint).awaitTermination()
    return spark.read.schema(similarity.LINK).parquet(path).select("older", "newer", F.col("distance").cast("int").alias("distance"))


QUERIES = {
    "stream_first_visits": lambda s, d: arrived(windows.unseen(read(s, d, "events").select("user_id", "ts"), "user_id").select("user_id")),
    "stream_daily_counters": lambda s, d: arrived(windows.daily_counters(read(s, d, "events").select("event_type", "ts"), "event_type")),
    "stream_near_articles": near_articles,
}

ORACLES = {
    "stream_first_visits": "SELECT DISTINCT user_id FROM events",
    "stream_daily_counters": "SELECT date, metric, count(*) AS value FROM (SELECT CAST(ts AS DATE) AS date, event_type AS metric FROM events) AS e GROUP BY date, metric HAVING date + INTERVAL 2 DAY <= (SELECT max(ts) FROM events)",
    "stream_near_articles": duck_query(
        lambda d: f"""WITH RECURSIVE {fingerprints(d)},
c AS (SELECT hi, lo, min(published) AS since FROM f GROUP BY hi, lo UNION ALL SELECT hi, lo, since FROM (SELECT c.hi, c.lo, min(f.published) OVER (PARTITION BY c.hi, c.lo) AS since, row_number() OVER (PARTITION BY c.hi, c.lo) AS rn FROM c JOIN f ON f.hi = c.hi AND f.lo = c.lo AND f.published > c.since + {similarity.DAY}) WHERE rn = 1),
k AS (SELECT f.* FROM f JOIN c ON c.hi = f.hi AND c.lo = f.lo AND c.since = f.published)
SELECT k.id AS older, f.id AS newer, CAST({d.bits(d.xor("k.hi", "f.hi"))} + {d.bits(d.xor("k.lo", "f.lo"))} AS INT) AS distance FROM k JOIN f ON f.published > k.published AND f.published - k.published <= {similarity.DAY}
WHERE {d.bits(d.xor("k.hi", "f.hi"))} + {d.bits(d.xor("k.lo", "f.lo"))} <= {FAR}""",
        "news",
    ),
}
