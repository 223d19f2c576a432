"""Feeds of each source, written from the given articles as RSS or Atom and read again; the SQL states what has to come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans.dialect import DuckSql, duck_query, run_text
from marlstone.plans.relational import NOW
from marlstone.sources import adapters
from marlstone.sources.feeds import read_feeds

#: Articles of a feed document, by the time in which they appeared.
SLOT = 1800




def articles(d) -> str:
    """Articles as their feeds have them: some without a title, a link or a text, some whose date is no date."""
    title = d.sub("coalesce(title, '')", "[^A-Za-z0-9 ]+", "")
    return f"""SELECT id, source, CAST(floor(published / {SLOT}) AS BIGINT) AS slot, CASE WHEN id % 23 = 0 THEN '' ELSE trim({title}) END AS title, CASE WHEN id % 19 = 0 THEN '' ELSE {d.sub("coalesce(content, '')", "[^A-Za-z0-9 .,]+", " ")} END AS content,
  CASE WHEN id % 29 = 0 THEN '' ELSE 'https://feed.example.com/' || id END AS url, CASE WHEN id % 31 = 0 THEN NULL ELSE published - (id % 3) * 86400 END AS published, id % 17 = 0 AS dotted FROM news"""


#: Settings by source: every third source has tags, every second one an age limit of a day.
BINDINGS = "SELECT source AS feed, 'feed ' || source AS source, CASE WHEN length(source) % 2 = 0 THEN 'markets' ELSE 'technology' END AS category, length(source) % 3 != 0 AS with_tags, CASE WHEN length(source) % 2 = 0 THEN 1 END AS max_age_days FROM (SELECT DISTINCT source FROM news WHERE source IS NOT NULL) AS s"


def documents(found: DataFrame) -> DataFrame:
    """(feed, body): for each source and slot one document, RSS in even slots and Atom in odd ones."""
    escape = lambda x: F.replace(F.replace(F.replace(F.col(x) if isinstance(x, str) else x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    time = F.timestamp_seconds("published")
    body = escape(F.concat(F.lit("<p> "), F.col("content"), F.lit(" </p><!-- x --><br/>")))
    tags = [F.lit("a"), F.lit(""), F.concat(F.lit("t"), (F.col("id") % 4).cast("string")), F.lit("b"), F.lit("c")]
    rfc = F.coalesce(F.concat(F.date_format(time, "EEE, dd MMM yyyy HH:mm:ss"), F.when(F.col("dotted"), F.lit(" +0000")).otherwise(F.lit(" GMT"))), F.lit("soon"))
    item = F.concat(F.lit("<item><title> "), escape("title"), F.lit(" </title><link>"), F.col("url"), F.lit("</link><description>"), body, F.lit("</description><pubDate>"), rfc, F.lit("</pubDate>"), *(F.concat(F.lit("<category>"), t, F.lit("</category>")) for t in tags), F.lit("</item>"))
    iso = F.coalesce(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("soon"))
    dated = F.when(F.col("dotted"), F.concat(F.lit("<updated>"), iso, F.lit("</updated>"))).otherwise(F.concat(F.lit("<updated>2001-01-01T00:00:00Z</updated><published>"), iso, F.lit("</published>")))
    entry = F.concat(F.lit('<entry><title type="text">'), escape("title"), F.lit('</title><link rel="self" href="https://self.example.com"/>'), F.concat(F.lit('<link rel="alternate" href="'), F.col("url"), F.lit('"/>')), F.lit('<summary type="html">'), body, F.lit("</summary>"), dated, *(F.concat(F.lit('<category term="'), t, F.lit('"/>')) for t in tags), F.lit("</entry>"))
    rss = F.col("slot") % 2 == 0
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", F.when(rss, item).otherwise(entry).alias("x")))), lambda r: r["x"]), "")
    whole = F.when(rss, F.concat(F.lit('<rss version="2.0"><channel><title>f</title>'), F.col("items"), F.lit("</channel></rss>"))).otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>'), F.col("items"), F.lit("</feed>")))
    return found.groupBy("source", "slot").agg(texts.alias("items")).select(F.col("source").alias("feed"), whole.alias("body"))


def rss_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article of the feeds; tags joined by commas."""
    news = adapters.news(spark, sf_dir)
    read = read_feeds(documents(run_text(spark, articles, news=news)), run_text(spark, lambda d: BINDINGS, news=news), NOW)
    return read.withColumn("tags", F.array_join("tags", ","))


def rss_sql(d) -> str:
    content = f"trim({d.sub('content', '^ +| +$', '')})"
    time = "CASE WHEN slot % 2 != 0 AND NOT dotted AND published IS NULL THEN 978307200 ELSE published END"
    return f"""WITH a AS ({articles(d)}), b AS ({BINDINGS}), r AS (SELECT a.*, {time} AS t, {content} AS c FROM a)
SELECT b.feed, b.source, b.category, r.title, CASE WHEN c = '' THEN r.title ELSE c END AS content, r.url, t AS published, CASE WHEN with_tags THEN 'a,t' || (id % 4) || ',b' ELSE '' END AS tags
FROM r JOIN b ON b.feed = r.source WHERE r.title != '' AND r.url != '' AND (max_age_days IS NULL OR t IS NULL OR t >= {NOW} - max_age_days * 86400)"""


QUERIES = {"rss_articles": rss_articles}
ORACLES = {"rss_articles": duck_query(lambda d: rss_sql(d) if isinstance(d, DuckSql) else "", "news")}
