"""Events above articles and events that are due again, by hand."""

from marlstone.plans.events import due_again, event_ids, last_ancestors

ARTICLE = "id long, title string, related_to_id long, ai_score double, source string, is_highlight boolean, published long"


def articles(spark, rows):
    return spark.createDataFrame([(i, t, r, s, "x", False, 0) for i, t, r, s in rows], ARTICLE)


def test_every_depth_finds_the_last_root_with_a_title(spark):
    chain = [(100 + k, "t", 99 + k, 5.0) for k in range(1, 40)]
    rows = [(100, "top", None, 5.0), *chain, (1, "  ", None, 9.0), (2, "t", 1, 9.0), (3, "low", None, 1.9), (4, "t", 3, 9.0), (5, "t", 77, 9.0), (6, "a", 7, 9.0), (7, "b", 6, 9.0), (8, "c", 7, 9.0), (9, None, None, 9.0)]
    found = {r.id: r.event_id for r in event_ids(articles(spark, rows)).collect()}
    assert all(found[100 + k] == 100 for k in range(40))
    assert {i: found[i] for i in range(1, 10)} == dict.fromkeys(range(1, 10))  # no title, low score, missing parent, cycle
    assert len(found) == len(rows)


def test_no_links(spark):
    assert last_ancestors(spark.createDataFrame([(1, None)], "id long, parent long")).collect() == []
    assert event_ids(articles(spark, [])).collect() == []


def test_an_event_is_due_again_only_once_it_has_grown(spark):
    def news(*rows):
        return spark.createDataFrame([(i, f"t{i}", r, s, src, high, at) for i, r, s, src, high, at in rows], ARTICLE)

    start = [(1, None, 3.0, "a", False, 0), (2, 1, 3.0, "b", False, 10_000), (3, None, 3.0, "a", False, 0), (4, 3, 1.0, "a", False, 100)]
    none = spark.createDataFrame([], "event_id long, article_count long")
    first = due_again(spark, news(*start), none, now=10_000, hours=1)
    assert [(r.event_id, r.article_count, r.source_count, r.told) for r in first.collect()] == [(1, 2, 2, None)]  # 3 has nothing new in the window
    stored = spark.createDataFrame([(r.event_id, r.article_count) for r in first.collect()], none.schema)
    assert due_again(spark, news(*start), stored, now=10_000, hours=1).collect() == []
    more = [*start, (5, 1, 0.0, "b", False, 10_500)]
    again = due_again(spark, news(*more), stored, now=11_000, hours=1).collect()
    assert [(r.event_id, r.article_count, r.source_count, r.told) for r in again] == [(1, 3, 2, 2)]
    assert due_again(spark, news(*more), stored, now=11_000, hours=1, least_sources=9).collect() == []
    high = [(1, None, 3.0, "a", True, 0), *more[1:]]
    assert [r.event_id for r in due_again(spark, news(*high), stored, now=11_000, hours=1, least_sources=9).collect()] == [1]
