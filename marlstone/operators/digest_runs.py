"""Digests one after the other: each starts where the last successful one ended, tells nothing twice, and counts once its end is written.

Three tables in a folder, parted by the digest's end: ``links`` (event, version, section),
``quiet`` (topics that were important and have nothing new), and ``ends``, whose row is
written last. A run that breaks off before leaves no end, and is done again from the same
start; its links are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Score from which on an event must be known; events of a digest; lengths of titles, of other texts and of summaries in a reply; confidences.
MUST, MOST = 8, 40
TITLE, TEXT, SUMMARY = 200, 300, 500
CONFIDENCES = ("high", "medium", "low")
END = "digest_end"
LINKS = f"event_id long, version long, section string, {END} long"
ENDS = f"start long, articles long, events long, {END} long"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return spark.createDataFrame([], schema)
        raise
    return spark.read.schema(schema).parquet(path)


def _put(df: DataFrame, path: str, end: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{END}={end}")


def events_of(articles: DataFrame, start: int, end: int) -> DataFrame:
    """(event_id, version, resolved, score, n_articles) of events with an article in [start, end); a version is the number of sources so far."""
    root = F.coalesce("related_to_id", "id")
    fresh = F.count_if(F.col("published") >= start)
    seen = articles.where(F.col("published") < end).groupBy(root.alias("event_id")).agg(F.count_distinct("source").alias("version"), F.max("ai_score").alias("score"), fresh.alias("n_articles"), F.max(F.when(F.col("id") == root, F.col("status") == "resolved")).alias("resolved"))
    return seen.where("n_articles > 0")


def told(events: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new ones, quiet ones) of ``events``, given the links (event_id, version, section) of the digest before: an event whose version has not moved is left out unless it is resolved; where it had to be known it is a quiet topic."""
    last = before.select("event_id", F.col("version").alias("told_version"), F.col("section").alias("told_section"))
    met = events.join(last, "event_id", "left")
    fresh = F.col("told_version").isNull() | (F.col("version") > F.col("told_version")) | F.coalesce("resolved", F.lit(False))
    quiet = met.where(~fresh & (F.col("told_section") == "must_know"))
    return met.where(fresh).drop("told_version", "told_section"), quiet.select("event_id", "version")


def run(articles: DataFrame, folder: str, end: int, first_start: int, most: int = MOST) -> int | None:
    """Write the digest that ends at ``end``; the start of it, or None where one is there already."""
    spark = articles.sparkSession
    ends = _stored(spark, f"{folder}/ends", ENDS)
    if not ends.where(F.col(END) == end).isEmpty():
        return None
    last = ends.where(F.col(END) < end).agg(F.max(END)).first()[0]
    start = first_start if last is None else last
    before = _stored(spark, f"{folder}/links", LINKS).where(F.col(END) == F.lit(last if last is not None else -1).cast("long"))
    events = events_of(articles, start, end)
    fresh, quiet = told(events, before)
    section = F.when(F.col("score") >= MUST, "must_know").otherwise("worth_watching")
    _put(fresh.orderBy(F.desc("score"), "event_id").limit(most).select("event_id", "version", section.alias("section")), f"{folder}/links", end)
    _put(quiet, f"{folder}/quiet", end)
    n = events.agg(F.coalesce(F.sum("n_articles"), F.lit(0)).alias("articles"), F.count("*").alias("events"))
    _put(n.select(F.lit(start).cast("long").alias("start"), "articles", "events"), f"{folder}/ends", end)
    return start


def links(spark: SparkSession, folder: str) -> DataFrame:
    """The links of digests whose end is written."""
    return _stored(spark, f"{folder}/links", LINKS).join(_stored(spark, f"{folder}/ends", ENDS).select(END), END, "left_semi")


ENTRY = "array<struct<event_id:string,title:string,latest_change:string,why_important:string,confidence:string,watch_next:string>>"
REPLY = f"struct<period_summary:string,must_know:{ENTRY},worth_watching:{ENTRY},cross_event_signals:array<struct<title:string,summary:string,event_ids:array<string>>>>"


def _parsed(replies: DataFrame) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace(F.trim("reply"), r"^```[^\n]*\n", ""), r"\s*`+\s*$", "")
    return replies.select("digest", F.from_json(bare, REPLY).alias("r")).where("length(r.period_summary) > 0")


def clean_entries(replies: DataFrame, sent: DataFrame) -> DataFrame:
    """(digest, section, place, event_id, title, latest_change, why_important, confidence, watch_next) of replies (digest, reply) about events that were sent (digest, event_id); those made up go."""
    parsed = _parsed(replies)
    of = lambda name: parsed.select("digest", F.lit(name).alias("section"), F.posexplode(f"r.{name}").alias("place", "e"))
    cut = lambda c, n: F.substring(F.coalesce(F.col(f"e.{c}"), F.lit("")), 1, n).alias(c)
    entries = of("must_know").unionByName(of("worth_watching")).where("e IS NOT NULL")
    sure = F.when(F.col("e.confidence").isin(*CONFIDENCES), F.col("e.confidence")).otherwise("medium").alias("confidence")
    rows = entries.select("digest", "section", "place", F.col("e.event_id").try_cast("bigint").alias("event_id"), cut("title", TITLE), cut("latest_change", TEXT), cut("why_important", TEXT), sure, cut("watch_next", TEXT))
    return rows.join(sent.select("digest", "event_id").distinct(), ["digest", "event_id"], "left_semi")


def clean_signals(replies: DataFrame, sent: DataFrame) -> DataFrame:
    """(digest, place, title, summary, event_ids) of the signals with a title; events that were not sent go from their lists."""
    signals = _parsed(replies).select("digest", F.posexplode("r.cross_event_signals").alias("place", "s")).where("length(s.title) > 0")
    named = signals.select("digest", "place", F.posexplode("s.event_ids").alias("spot", "e")).withColumn("event_id", F.col("e").try_cast("bigint"))
    known = named.join(sent.select("digest", "event_id").distinct(), ["digest", "event_id"], "left_semi").groupBy("digest", "place").agg(F.array_sort(F.collect_list(F.struct("spot", "event_id"))).alias("k"))
    ids = F.coalesce(F.col("k.event_id"), F.array().cast("array<bigint>"))
    return signals.join(known, ["digest", "place"], "left").select("digest", "place", F.substring("s.title", 1, TITLE).alias("title"), F.substring(F.coalesce("s.summary", F.lit("")), 1, SUMMARY).alias("summary"), ids.alias("event_ids"))
