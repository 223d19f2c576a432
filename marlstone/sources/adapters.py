"""Canonical relations over the driver's tables, with the same views as DuckDB text.

The operators only know the canonical schemas; these views bind them to Parquet.
``quotes`` is a daily bar for each supplier and ship date, ``news`` the documents
with a title, a time and a score, ``usage`` daily counters of the event stream,
``trades`` the orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.session import table

MONEY = "decimal(18,2)"
#: The day that queries take for today unless told otherwise, and how many days before it they read.
AS_OF, DAYS = "2001-08-01", 1600


def quotes(spark: SparkSession, sf_dir: str, as_of: str | None = AS_OF, days: int | None = DAYS) -> DataFrame:
    """(code, trade_date, open, high, low, close, volume, amount, name, market), one row a series and day; prices decimal. Only days in [as_of - days, as_of] are read, where these are given: the predicate reaches the scan."""
    line = table(spark, sf_dir, "lineitem")
    if as_of:
        day = F.lit(as_of).cast("date")
        line = line.where(F.col("l_shipdate") >= F.date_sub(day, days)) if days else line
        line = line.where(F.col("l_shipdate") < F.date_add(day, 1))
    price = F.col("l_extendedprice").cast(MONEY)
    order = F.struct("l_orderkey", "l_linenumber", "l_extendedprice")
    bars = line.groupBy(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("trade_date")).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum(F.col("l_quantity").cast("long")).alias("volume"),
        F.sum(price).cast(MONEY).alias("amount"),
    )
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    names = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return bars.join(names.select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.col("r_name").alias("market")), "code")


def every_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bars of all days, for what has no lower bound of days: valuations of trades, ratings of past days."""
    return quotes(spark, sf_dir, None)


def _quotes_sql(name: str, where: str = "") -> str:
    return f"""
{name}_bars AS (
  SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS trade_date,
    arg_min(CAST(l_extendedprice AS DECIMAL(18,2)), (l_orderkey, l_linenumber, l_extendedprice)) AS open,
    max(CAST(l_extendedprice AS DECIMAL(18,2))) AS high, min(CAST(l_extendedprice AS DECIMAL(18,2))) AS low,
    arg_max(CAST(l_extendedprice AS DECIMAL(18,2)), (l_orderkey, l_linenumber, l_extendedprice)) AS close,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS amount
  FROM lineitem {where} GROUP BY ALL),
{name} AS (
  SELECT {name}_bars.*, s_name AS name, r_name AS market FROM {name}_bars JOIN supplier ON s_suppkey = code
  JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
"""


QUOTES = _quotes_sql("quotes", f"WHERE l_shipdate >= DATE '{AS_OF}' - {DAYS} AND l_shipdate < DATE '{AS_OF}' + 1")
EVERY_QUOTE = _quotes_sql("every_quote")


def title_of(text: str) -> Column:
    """The first sentence of a text, 120 characters at most."""
    return F.substring(F.regexp_extract(text, r"^([^.]*)", 1), 1, 120)


def news(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """(id, title, content, source, url, tags, published, ai_score, related_to_id, is_highlight, status); of ``docs``, which may be a stream, where given, with the columns ``also`` of them. What comes from the documents alone is made before labels are joined, so that texts that are not asked for don't travel."""
    docs, labels = table(spark, sf_dir, "documents") if docs is None else docs, table(spark, sf_dir, "labels")
    id_ = F.col("doc_id")
    made = docs.select(
        id_,
        title_of("text").alias("title"),
        F.col("text").alias("content"),
        "source",
        F.concat(F.lit("https://"), "source", F.lit(".example.com/2024/a/"), (id_ - id_ % 4).cast("string"), F.lit("/?utm_source=feed&id="), (id_ % 3).cast("string"), F.lit("#top")).alias("url"),
        F.array("lang", "source", F.concat(F.lit("topic"), (id_ % 7).cast("string"))).alias("tags"),
        *also,
    )
    tenths = F.coalesce("quality", F.lit(0)) * 40 + (id_ % 11) * 6 - F.coalesce("toxic", F.lit(0)) * 20
    score = F.greatest(F.lit(0), F.least(F.lit(100), tenths)) / F.lit(10.0)
    return made.join(labels, "doc_id", "left").select(
        id_.alias("id"),
        *("title", "content", "source", "url", "tags"),
        (F.lit(1704067200) + id_ * 60).cast("long").alias("published"),
        score.cast("double").alias("ai_score"),
        F.when((id_ % 5).isin(1, 2) | (id_ % 10 == 3), id_ - id_ % 5).alias("related_to_id"),
        (score >= 8).alias("is_highlight"),
        F.element_at(F.array(F.lit("new"), F.lit("developing"), F.lit("stable"), F.lit("resolved")), (id_ % 4 + 1).cast("int")).alias("status"),
        *also,
    )


NEWS = """
news AS (
  SELECT d.doc_id AS id, substr(regexp_extract(text, '^([^.]*)', 1), 1, 120) AS title, text AS content, source,
    'https://' || source || '.example.com/2024/a/' || (d.doc_id - d.doc_id % 4) || '/?utm_source=feed&id=' || (d.doc_id % 3) || '#top' AS url,
    [lang, source, 'topic' || (d.doc_id % 7)] AS tags, 1704067200 + d.doc_id * 60 AS published,
    CAST(greatest(0, least(100, coalesce(quality, 0) * 40 + (d.doc_id % 11) * 6 - coalesce(toxic, 0) * 20)) AS DOUBLE) / 10.0 AS ai_score,
    CASE WHEN d.doc_id % 5 IN (1, 2) OR d.doc_id % 10 = 3 THEN d.doc_id - d.doc_id % 5 END AS related_to_id,
    greatest(0, least(100, coalesce(quality, 0) * 40 + (d.doc_id % 11) * 6 - coalesce(toxic, 0) * 20)) >= 80 AS is_highlight,
    ['new', 'developing', 'stable', 'resolved'][CAST(d.doc_id % 4 + 1 AS INT)] AS status
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, metric, dimension, value): counters by day, kind and user."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("metric"), F.col("user_id").cast("string").alias("dimension")).agg(F.count("*").alias("value"))


USAGE = """
usage AS (SELECT CAST(ts AS DATE) AS date, event_type AS metric, CAST(user_id AS VARCHAR) AS dimension, count(*) AS value FROM events GROUP BY ALL)
"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trade_id, code, action, shares, price, trade_date): filled orders sell, others buy."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("trade_id"),
        (F.col("o_custkey") % 50).alias("code"),
        F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy").alias("action"),
        (F.col("o_orderkey") % 9 + 1).alias("shares"),
        F.col("o_totalprice").cast(MONEY).alias("price"),
        F.to_date("o_orderdate").alias("trade_date"),
    )


TRADES = """
trades AS (
  SELECT o_orderkey AS trade_id, o_custkey % 50 AS code, CASE WHEN o_orderstatus = 'F' THEN 'sell' ELSE 'buy' END AS action,
    o_orderkey % 9 + 1 AS shares, CAST(o_totalprice AS DECIMAL(18,2)) AS price, CAST(o_orderdate AS DATE) AS trade_date FROM orders)
"""


def closed_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trade_id, market, status, amount, pnl_pct, followed_rule, exit_date): each trade with a result of its own."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    closed = F.col("o_orderstatus") == "F"
    return o.select(
        key.alias("trade_id"),
        F.element_at(F.array(F.lit("CN"), F.lit("HK"), F.lit("US")), (F.col("o_custkey") % 3 + 1).cast("int")).alias("market"),
        F.when(closed, "closed").otherwise("open").alias("status"),
        F.col("o_totalprice").cast(MONEY).alias("amount"),
        F.when(closed & (key % 19 != 0), ((key % 41 - 18) / 2.0).cast("double")).alias("pnl_pct"),
        F.when(key % 7 != 0, key % 5 != 0).alias("followed_rule"),
        F.when(closed, F.to_date("o_orderdate")).alias("exit_date"),
    )


CLOSED_TRADES = """
closed_trades AS (
  SELECT o_orderkey AS trade_id, ['CN', 'HK', 'US'][CAST(o_custkey % 3 + 1 AS INT)] AS market, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
    CASE WHEN o_orderstatus = 'F' AND o_orderkey % 19 != 0 THEN CAST((o_orderkey % 41 - 18) / 2.0 AS DOUBLE) END AS pnl_pct, CASE WHEN o_orderkey % 7 != 0 THEN o_orderkey % 5 != 0 END AS followed_rule,
    CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END AS exit_date FROM orders)
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, started, user_id, kind, value, props): one row an event, ``props`` a JSON map of numbers."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("run_id"), F.to_date("ts").alias("started"), "user_id", F.col("event_type").alias("kind"), "value", "props")


RUNS = """
runs AS (SELECT event_id AS run_id, CAST(ts AS DATE) AS started, user_id, event_type AS kind, value, props FROM events)
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, embedding) of the given vectors."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")


VECTORS = """
vectors AS (SELECT vec_id AS id, label, embedding FROM embeddings)
"""


def with_views(*views: str, sql: str) -> str:
    """A DuckDB query over some of the views above; ``sql`` may go on with further CTEs after a comma."""
    return "WITH " + ", ".join(v.strip() for v in views) + sql
