"""Feeds of all shapes through the one reader."""

import calendar

from pyspark.sql import functions as F

from marlstone.sources.feeds import feed_time, read_feeds, strip_markup

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>Name</title>
<item><title> One &amp; two </title><link>https://x.example.com/1</link><description>&lt;p&gt;First&lt;/p&gt;&lt;p&gt; a &amp;amp; b&lt;/p&gt;</description><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate><category>c1</category><category></category><category>c2</category><category>c3</category><category>c4</category></item>
<item><title>No text</title><guid isPermaLink="true">https://x.example.com/2</guid><dc:date>2024-01-02T03:04:05+08:00</dc:date></item>
<item><title>No link</title><guid isPermaLink="false">17</guid></item>
<item><link>https://x.example.com/3</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>Name</title>
<entry><title>Both</title><link rel="edit" href="https://x.example.com/e"/><link href="https://x.example.com/4"/><content type="html">&lt;b&gt;Bold&lt;/b&gt;</content><updated>2024-01-03T00:00:00Z</updated><published>2024-01-02T00:00:00Z</published><category term="t"/></entry>
<entry><title>Updated only</title><link rel="alternate" href="https://x.example.com/5"/><summary>s</summary><updated>2023-01-03T00:00:00Z</updated></entry></feed>"""


def seconds(*parts):
    return calendar.timegm((*parts, 0, 0, 0))


def test_two_shapes_one_reader(spark):
    documents = spark.createDataFrame([("r", RSS), ("a", ATOM), ("bad", "<rss><channel>"), ("none", None), ("unbound", RSS)], "feed string, body string")
    bindings = spark.createDataFrame([("r", "Rss", "x", True, None), ("a", "Atom", "y", False, 30), ("bad", "b", "y", True, None), ("none", "n", "y", True, None)], "feed string, source string, category string, with_tags boolean, max_age_days int")
    now = seconds(2024, 1, 10, 0, 0, 0)
    found = {r.url: r for r in read_feeds(documents, bindings, now).collect()}
    assert sorted(found) == [f"https://x.example.com/{i}" for i in (1, 2, 4)]  # 5 is too old for its feed
    one, two, four = (found[f"https://x.example.com/{i}"] for i in (1, 2, 4))
    assert (one.title, one.content, one.source, one.tags, one.published) == ("One & two", "First a & b", "Rss", ["c1", "c2", "c3"], seconds(2024, 1, 2, 3, 4, 5))
    assert (two.content, two.published) == ("No text", seconds(2024, 1, 1, 19, 4, 5))
    assert (four.content, four.published, four.tags, four.category) == ("Bold", seconds(2024, 1, 2, 0, 0, 0), [], "y")
    assert {r.url[-1] for r in read_feeds(documents, bindings.withColumn("max_age_days", F.lit(None).cast("int")), now).where("feed = 'a'").collect()} == {"4", "5"}


def test_times(spark):
    want = {
        "Tue, 2 Jan 2024 03:04:05 +0100": seconds(2024, 1, 2, 2, 4, 5),
        "02 Jan 2024 03:04 EST": seconds(2024, 1, 2, 8, 4, 0),
        "Wed, 03 Jul 2024 03:04:05 PDT": seconds(2024, 7, 3, 10, 4, 5),
        "2024-01-02T03:04:05.250Z": seconds(2024, 1, 2, 3, 4, 5),
        "2024-01-02T03:04:05-0500": seconds(2024, 1, 2, 8, 4, 5),
        "2024-01-02": seconds(2024, 1, 2, 0, 0, 0),
        "yesterday": None,
        "": None,
        "2024-13-02T00:00:00Z": None,
    }
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", F.unix_timestamp(feed_time(F.col("t"))).alias("s")).collect()
    assert {r.t: r.s for r in rows} == want


def test_markup(spark):
    html = "<div> a <!-- no --> b</div><script>var x = '<p>';</script><style>p {}</style>\n<p>c&nbsp;&lt;d&gt;</p>"
    assert spark.range(1).select(strip_markup(F.lit(html)).alias("x")).first().x == "a b c <d>"
