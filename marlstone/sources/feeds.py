"""Articles out of RSS and Atom documents: one reader for all feeds, whose differences are rows of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: RSS 2.0 (channel.item), RSS 1.0 (item) and Atom (entry) in one schema; fields that a shape lacks stay null.
_ITEM = "STRUCT<title: STRING, link: STRING, guid: STRUCT<_VALUE: STRING, _isPermaLink: STRING>, description: STRING, pubDate: STRING, date: STRING, category: ARRAY<STRING>>"
_ENTRY = "STRUCT<title: STRING, link: ARRAY<STRUCT<_href: STRING, _rel: STRING>>, summary: STRING, content: STRING, published: STRING, updated: STRING, category: ARRAY<STRUCT<_term: STRING>>>"
SCHEMA = f"channel STRUCT<item: ARRAY<{_ITEM}>>, item ARRAY<{_ITEM}>, entry ARRAY<{_ENTRY}>"

#: Zones that RFC 822 names; most tags of an article.
ZONES = {"GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
MOST_TAGS = 3
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def feed_time(text: Column) -> Column:
    """Time of an RFC 822 or ISO 8601 date; null for anything else. Names of days are not read, a date without a zone is in UTC."""
    plain = F.trim(F.regexp_replace(text, r"^\s*[A-Za-z]+,\s*", ""))
    zoned = plain
    for name, offset in ZONES.items():
        zoned = F.regexp_replace(zoned, rf"(?<=[0-9]) ?\b{name}$", f" {offset}")
    rfc = [F.try_to_timestamp(zoned, F.lit(f"d MMM yyyy HH:mm{s} Z")) for s in (":ss", "")]
    iso = F.when(plain.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9:.]+ ?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"), F.regexp_replace(plain, r"([+-][0-9]{2})([0-9]{2})$", "$1:$2").try_cast("timestamp"))
    return F.coalesce(iso, *rfc)


def strip_markup(text: Column) -> Column:
    """Text between the tags, each piece trimmed, joined by a space; comments, scripts and styles go, character references are decoded."""
    shown = F.regexp_replace(text, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "<>")
    pieces = F.transform(F.split(shown, r"<[^>]*>"), lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", "")))
    flat = F.array_join(F.filter(pieces, lambda p: p != ""), " ")
    for name, char in ENTITIES.items():
        flat = F.replace(flat, F.lit(name), F.lit(char))
    return F.trim(flat)


def _items(items: Column) -> Column:
    """RSS items as (title, url, body, time, tags). A guid that is a permanent link stands for a missing link."""
    guid = lambda i: F.when(F.coalesce(F.lower(i["guid"]["_isPermaLink"]), F.lit("true")) != "false", i["guid"]["_VALUE"])
    return F.transform(items, lambda i: F.struct(i["title"].alias("title"), F.coalesce(F.nullif(F.trim(i["link"]), F.lit("")), guid(i)).alias("url"), i["description"].alias("body"), F.coalesce(feed_time(i["pubDate"]), feed_time(i["date"])).alias("time"), i["category"].alias("tags")))


def _entries(entries: Column) -> Column:
    """Atom entries likewise; the alternate link counts, else the first one; the summary, else the content."""
    alternate = lambda e: F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    url = lambda e: F.coalesce(F.get(alternate(e), 0)["_href"], F.get(e["link"], 0)["_href"])
    return F.transform(entries, lambda e: F.struct(e["title"].alias("title"), url(e).alias("url"), F.coalesce(F.nullif(e["summary"], F.lit("")), e["content"]).alias("body"), F.coalesce(feed_time(e["published"]), feed_time(e["updated"])).alias("time"), F.transform(e["category"], lambda c: c["_term"]).alias("tags")))


def read_feeds(documents: DataFrame, bindings: DataFrame, now: int) -> DataFrame:
    """(feed, source, category, title, content, url, published, tags) of every entry with a title and a link.

    ``documents`` has (feed, body), a body a whole RSS or Atom document; ``bindings``
    has one row a feed: (feed, source, category, with_tags, max_age_days). Feeds
    without a binding go, as do entries older than their feed's limit (null: none; an
    entry without a time stays). A body that is no XML has no entries. An empty content
    becomes the title. ``bindings`` is a table of settings, a row a source.
    """
    parsed = documents.select("feed", F.from_xml("body", F.lit(SCHEMA), {"ignoreNamespace": "true", "mode": "PERMISSIVE"}).alias("x"))
    none = F.array()
    every = F.concat(*(F.coalesce(part, none) for part in (_items(F.col("x.channel.item")), _items(F.col("x.item")), _entries(F.col("x.entry")))))
    rows = parsed.select("feed", F.explode(every).alias("e")).select("feed", F.trim("e.title").alias("title"), F.trim("e.url").alias("url"), strip_markup(F.coalesce("e.body", F.lit(""))).alias("content"), F.col("e.time").alias("time"), F.col("e.tags").alias("tags"))
    rows = rows.where("title != '' and url != ''").join(bindings, "feed")
    published = F.unix_timestamp("time")
    fresh = F.col("max_age_days").isNull() | F.col("time").isNull() | (published >= F.lit(now) - F.col("max_age_days") * 86400)
    tags = F.when(F.col("with_tags"), F.slice(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit("")) != ""), 1, MOST_TAGS)).otherwise(F.array().cast("array<string>"))
    return rows.where(fresh).select("feed", "source", "category", "title", F.when(F.col("content") == "", F.col("title")).otherwise(F.col("content")).alias("content"), "url", published.alias("published"), tags.alias("tags"))
