"""Events made of a root article and the articles linked to it: ranking, roll-ups and source quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gravity(score: Column, hours: Column, power: Column, boost: Column) -> Column:
    """Points less one over a power of the age; scores above 10 are on the scale to 100."""
    points = F.greatest(F.when(score > 10, score / 10).otherwise(score), F.lit(0.0)) + F.greatest(boost, F.lit(0.0))
    return F.round(F.greatest(points - 1, F.lit(0.0)) / F.pow(F.greatest(hours, F.lit(0.0)) + 2, power), 4)


def event_board(news: DataFrame, now: int) -> DataFrame:
    """One row a root: articles, distinct sources, freshness and rank at ``now`` (seconds). One aggregation by root replaces correlated subqueries."""
    root = F.coalesce("related_to_id", "id")
    child = F.col("id") != root
    sums = news.groupBy(root.alias("id")).agg(F.count("*").alias("n_articles"), F.count_distinct("source").alias("n_sources"), F.max(F.when(child, F.col("published"))).alias("latest_child"))
    joined = news.where("related_to_id is null").select("id", "title", "ai_score", "published").join(sums, "id")
    fresh = F.greatest("published", "latest_child")
    power = F.when(F.col("n_articles") > 1, 1.2).otherwise(1.8)
    rank = gravity(F.col("ai_score"), (F.lit(now) - fresh) / 3600.0, power, F.least(F.col("n_sources") * 0.5, F.lit(2.0)))
    return joined.select("id", "title", "n_articles", "n_sources", fresh.alias("fresh"), rank.alias("rank"))


def children_list(news: DataFrame, most: int = 12) -> DataFrame:
    """Ids of the newest ``most`` children of each root, newest first."""
    w = Window.partitionBy("related_to_id").orderBy(F.desc("published"), F.desc("id"))
    near = news.where("related_to_id is not null and related_to_id != id").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    lists = near.groupBy(F.col("related_to_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rn", F.col("id").alias("child")))).alias("c"))
    return lists.select("id", F.array_join(F.transform("c", lambda x: x["child"].cast("string")), ",").alias("children"))


def hot_tags(news: DataFrame, now: int, least_score: float = 7.0, top: int = 8) -> DataFrame:
    """The most frequent tags of well-scored articles of the last 24 hours before ``now`` (seconds)."""
    tags = news.where(F.col("published").between(now - 86400, now) & (F.col("ai_score") >= least_score)).select(F.explode("tags").alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(top)


def source_quality(news: DataFrame, tier_d_rate: float = 0.03, tier_d_samples: int = 200) -> DataFrame:
    """Rates of each source and its tier: D for a low rate over many samples, C under 10 %, A from 30 %, else B."""
    share = lambda cond: F.sum(F.when(cond, 1).otherwise(0)) / F.count("*")
    score = F.col("ai_score")
    out = news.groupBy("source").agg(F.count("*").alias("samples"), F.round(F.avg(score), 6).alias("mean_score"), F.round(share(score >= 5), 6).alias("pass_rate"), F.round(share(score >= 6), 6).alias("display_rate"), F.round(share(F.col("is_highlight")), 6).alias("highlight_rate"), F.round(share(F.col("related_to_id").isNotNull()), 6).alias("duplicate_rate"))
    rate = F.col("display_rate")
    return out.withColumn("tier", F.when((rate < tier_d_rate) & (F.col("samples") >= tier_d_samples), "D").when(rate < 0.10, "C").when(rate >= 0.30, "A").otherwise("B"))


def normal_url(url: Column) -> Column:
    """Trimmed, without fragment, path parameters, tracking parameters and trailing slashes; a root path keeps its slash."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    site = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    path = F.regexp_replace(F.regexp_extract(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?]*)?([^?]*)", 1), ";[^/]*$", "")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    kept = F.array_join(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: ~p.rlike("^(utm_|feed_item)")), "&")
    return F.concat(site, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def distinct_urls(news: DataFrame) -> DataFrame:
    """The first article of each normalised address, with the digest of it."""
    return news.groupBy(normal_url(F.col("url")).alias("url")).agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumn("url_hash", F.sha2("url", 256))
