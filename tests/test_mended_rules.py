"""Rules by hand over small tables: what both engines may get wrong alike."""

import datetime as dt
from decimal import Decimal

import pytest

from marlstone.plans import ledger, relational, screening
from marlstone.plans.dialect import run_text
from marlstone.plans.news import HOT_NOW

NEWS = "id long, title string, content string, source string, url string, tags array<string>, published long, ai_score double, related_to_id long, is_highlight boolean, status string"


def news(spark, *rows):
    defaults = {"title": "t", "content": "", "source": "s", "url": "https://x.example.com", "tags": [], "published": 0, "ai_score": 5.0, "related_to_id": None, "is_highlight": False, "status": "new"}
    names = [x.split()[0] for x in NEWS.split(", ")]
    return spark.createDataFrame([tuple(({"id": i} | defaults | r)[n] for n in names) for i, r in rows], NEWS)


def text_of(name):
    return (relational.FOUND | screening.FOUND)[name][0]


@pytest.mark.parametrize(
    ("item", "root", "new"),
    [
        ("美联储宣布维持联邦基金利率不变，符合预期", "美联储宣布维持联邦基金利率不变", False),
        ("美联储宣布维持联邦基金利率在5.25%不变", "美联储宣布维持联邦基金利率不变", True),
        ("公司A营收增长，大华公司参与其中", "公司A营收增长", True),
        ("公司A营收增长，随后裁员", "公司A营收增长", True),
        ("公司A本月营收增长", "公司A营收增长", True),
        ("公司A营收增长5%", "公司A营收增长5亿", True),
    ],
)
def test_what_a_follow_up_adds(spark, item, root, new):
    df = news(spark, (1, {"title": "公司发布", "content": root}), (2, {"title": "公司发布", "content": item, "related_to_id": 1}))
    got = {r.id: r for r in run_text(spark, text_of("prefilter_decision"), news=df).collect()}
    assert got[2].no_news == (not new) and not got[1].no_news


def test_articles_of_an_event(spark):
    rows = [(k, {"published": 100 - k if k > 10 else k, "ai_score": float(k % 7), "related_to_id": 1 if k > 1 else None}) for k in range(1, 13)]
    df = news(spark, *rows, (50, {"published": 3}), (51, {"published": 1, "related_to_id": 50}))
    got = {r.id: r.articles.split(",") for r in run_text(spark, text_of("article_selection"), news=df).collect()}
    time = {i: r["published"] for i, r in rows}
    newest = sorted(time, key=lambda i: -time[i])[:2]
    rest = sorted((i for i in time if i not in newest), key=lambda i: (-(i % 7), -time[i]))[:6]
    assert got[1] == [str(i) for i in sorted(newest + rest, key=time.get)]
    assert got[50] == ["51", "50"]


def test_alerts(spark):
    old, fresh = HOT_NOW - 90_000, HOT_NOW - 100
    event = lambda i, *children, **root: [(i, {"ai_score": 9.0, "published": old} | root), *((i + k, {"related_to_id": i, "published": fresh} | c) for k, c in enumerate(children, 1))]
    df = news(
        spark,
        *event(10, {"source": "b", "title": "change"}),
        *event(20, {"source": "s"}),  # one source
        *event(30, {"source": "Fed"}),  # an official one
        *event(40, {"source": "b"}, ai_score=7.9),
        *event(50, {"source": "b", "published": old}),  # nothing since
        *event(60, {"source": "b", "title": " "}),  # no change told
        *event(70),
    )
    got = {r.id: r for r in run_text(spark, text_of("alert_selection"), news=df).collect()}
    assert set(got) == {10, 30} and (got[10].version, got[10].latest_change, got[10].source_count, got[10].official) == (2, "change", 2, False) and got[30].official


def test_the_age_gate(spark):
    day = 86_400
    df = news(spark, (1, {"published": HOT_NOW - day}), (2, {"published": HOT_NOW - day - 1}), (3, {"published": None, "source": "src2"}), (4, {"source": "src2"}), (5, {"source": "SEC filings"}), (6, {"source": "src2", "related_to_id": 1, "content": "rose 5%"}), (7, {"source": "src2", "related_to_id": 1}))
    got = {r.id: r.gate for r in run_text(spark, text_of("age_gate"), news=df).collect()}
    assert got == {1: "young", 2: "keep", 3: "young", 4: "drop", 5: "official", 6: "new_fact", 7: "drop"}


def test_an_account_marks_what_it_holds(spark):
    trades = spark.createDataFrame([(1, 7, "buy", 10, Decimal(100), dt.date(2000, 1, 1)), (2, 7, "buy", 10, Decimal(50), dt.date(2000, 1, 2)), (3, 8, "buy", 2, Decimal(30), dt.date(2000, 1, 2))], "trade_id long, code long, action string, shares long, price decimal(18,2), trade_date date")
    closed = spark.createDataFrame([(1, "US", "open", None), (2, "US", "closed", 10.0), (3, "US", "open", None)], "trade_id long, market string, status string, pnl_pct double")
    quotes = spark.createDataFrame([(7, dt.date(2000, 1, 3), Decimal(40)), (7, dt.date(2000, 1, 2), Decimal(90))], "code long, trade_date date, close decimal(18,2)")
    (r,) = run_text(spark, text_of("account_state"), closed_trades=closed, trades=trades, every_quote=quotes).collect()
    assert (r.realized_pnl, r.holdings, r.cash, r.total, r.breaker) == (50.0, 460.0, 1e10 - 1060 + 50, 1e10 - 550, False)


def test_hot_topics(spark):
    now = HOT_NOW
    df = news(
        spark,
        (1, {"published": now - 50, "title": "root"}),
        *((k, {"related_to_id": 1, "published": now - 40 + k, "source": f"s{k % 3}", "title": f"c{k}"}) for k in range(2, 11)),
        (20, {"published": now - 90_000}),
        (21, {"related_to_id": 20, "source": "z"}),
        (30, {"published": now - 10, "ai_score": 4.0}),
        (31, {"related_to_id": 30}),
        (40, {"published": now - 10}),
    )
    (r,) = run_text(spark, text_of("hot_topics"), news=df).collect()
    assert (r.id, r.source_count, r.children, r.child_sources, r.child_titles) == (1, 4, 9, "s0,s1,s2", "c2,c3,c4,c5,c6,c7")


def test_no_close_is_lost(spark):
    got = ledger.QUERIES["close_as_of"](spark, "/root/testdata/sf0.1")
    assert (got.count(), got.where("close is not null").count()) == (150_000, 149_673)
