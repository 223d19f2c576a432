"""State of digests, feed entries and windows of the backtest against values worked out by hand."""

from collections import Counter

import pytest

from marlstone.plans import digests
from marlstone.plans.dialect import run_text

B = digests.BEGIN
NEWS = "id long, title string, source string, status string, published long, related_to_id long, ai_score double"


@pytest.fixture(scope="module")
def news(spark):
    made = lambda i, status, published, root=None, score=8.0, title="t": (i, title, "s", status, published, root, score)
    rows = [
        made(4, "resolved", B - 3600),  # updated 7200 s later, told at the same version
        made(6, "new", B + 100),  # told before as must-know, at the same version
        made(10, "developing", B - 3600),  # told before, updated before the period
        made(12, "stable", B - 100),  # told before as must-know
        made(13, "new", B - 3600),  # updated in the period to a later version
        made(15, "new", B + 2000, title="x" * 300),  # not told before
        made(16, "new", B + 50, score=4.0),
        made(17, "new", B + 50, root=15),
        made(18, "new", digests.END),
    ]
    return spark.createDataFrame(rows, NEWS)


def test_changes_of_a_period(news):
    got = {r.event_id: (r.change_type, r.updated_in_period) for r in run_text(news.sparkSession, digests.digest_changes, news=news).collect()}
    assert got == {4: ("RESOLVED", True), 6: ("NEW_EVENT", False), 13: ("MATERIAL_UPDATE", True), 15: ("NEW_EVENT", False)}


def test_what_was_told_is_left_out_unless_resolved(news):
    got = {r.event_id: r.verdict for r in run_text(news.sparkSession, digests.digest_repeats, news=news).collect()}
    assert got == {4: "kept", 6: "quiet", 13: "kept", 15: "kept"}


def test_untouched_events_go_on_or_are_quiet(news):
    got = {r.event_id: (r.state, r.version) for r in run_text(news.sparkSession, digests.digest_ongoing, news=news).collect()}
    assert got == {10: ("ongoing", 1), 12: ("quiet", 3)}


def test_an_event_is_in_its_first_section_only(news):
    got = {r.event_id: (r.section, r.title) for r in run_text(news.sparkSession, digests.digest_sections, news=news).collect()}
    assert got == {4: ("worth_watching", "reply 4"), 6: ("must_know", "reply 6"), 13: ("ongoing_updates", "reply 13"), 15: ("must_know", "x" * 200)}


def test_entries_by_several_names(spark):
    rows = [(i, "Head line", "s", "new", 1000 + i, None, 1.0) for i in range(5)]
    got = {r.id: r[1:] for r in run_text(spark, digests.feed_rows, news=spark.createDataFrame(rows, NEWS)).collect()}
    base = "https://feed.example.com/"
    assert got == {
        0: ("Head line", "body", f"{base}detail/1", 1000),
        1: ("Head line", "Head line", f"{base}detail/a1", 1001),
        2: ("Head line", "Head line", f"{base}2", None),
    }


def test_form_and_company(spark):
    rows = [(i, "A title", "Acme", "new", 0, None, 1.0) for i in range(4)]
    got = {r.id: (r.form, r.company) for r in run_text(spark, digests.filing_tags, news=spark.createDataFrame(rows, NEWS)).collect()}
    assert got == {0: ("8-K", "Some - Name 0"), 1: ("10-K/A", "Corp Acme"), 2: (None, None), 3: (None, None)}


@pytest.mark.parametrize(("bars", "ends"), [(89, []), (90, [90]), (101, [90, 95, 100])])
def test_windows_hold_ninety_bars(spark, bars, ends):
    quotes = spark.range(bars).selectExpr("7L AS code", "date_add(DATE '2001-01-01', CAST(id AS INT)) AS trade_date", "id AS high", "id AS low", "id AS close", "id AS volume")
    got = [(r.code, r.close) for r in run_text(spark, digests.frames, quotes=quotes).collect()]
    assert Counter(c for c, _ in got) == {7 * digests.KEY + e: 90 for e in ends}
    for e in ends:
        assert sorted(x for c, x in got if c == 7 * digests.KEY + e) == list(range(e - 90, e))
