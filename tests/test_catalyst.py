"""The catalyst board over small tables, by hand."""

import pytest

from marlstone.plans import catalyst
from marlstone.plans.dialect import run_text

NEWS = "id long, title string, ai_score double, tags array<string>, entity string, kind string, sentiment double, published long"


@pytest.fixture
def board(spark):
    def run(news, entities, vcp=(), trend=(), rating=(), move=()):
        frames = {
            "news": spark.createDataFrame([(i, t, float(s), tags, e, k, x, catalyst.DAY + 60) for i, (t, s, tags, e, k, x) in enumerate(news)], NEWS),
            "entities": spark.createDataFrame(list(entities), "entity string, code string"),
            "vcp": spark.createDataFrame(list(vcp), "code long, vcp_score double"),
            "trend": spark.createDataFrame(list(trend), "code long, trend_score double"),
            "rating": spark.createDataFrame(list(rating), "code long, name string, rs_rating int"),
            "move": spark.createDataFrame(list(move), "code long, sum_pct double"),
        }
        return {r.code: r for r in run_text(spark, catalyst.board, **frames).collect()}

    return run


def test_news_are_gathered_by_code(board):
    news = [("Q1 profit up", 9, ["宁德时代"], "", "earnings", 4.0), ("new battery", 8, ["宁德时代 "], "", "product", 3.0), ("cars", 7, ["比亚迪"], "", "product", 2.0), ("too low", 6, ["比亚迪"], "", "x", 5.0)]
    got = board(news, [("宁德时代", "300750.SZ"), ("比亚迪", "002594.SZ")])
    assert set(got) == {"300750.SZ", "002594.SZ"}
    r = got["300750.SZ"]
    assert (r.news_count, r.top_score, r.avg_score, r.kinds, r.titles, r.avg_sentiment) == (2, 9, 8.5, "earnings,product", "Q1 profit up,new battery", 3.5)
    assert r.heat_score == 2 * 9 + 7 and r.confirm_level == "catalyst_only" and r.name is None
    assert got["002594.SZ"].news_count == 1


def test_what_names_no_company_is_left_out(board):
    news = [("n", 8, ["1", "12345", "宁", "A股", "GDP", "abc"], "ETF", "", None), ("m", 8, ["某非上市公司"], "", "", None)]
    names = ["1", "12345", "宁", "A股", "GDP", "abc", "ETF"]
    assert board(news, [*((n, "000001.SZ") for n in names), ("某非上市公司", None)]) == {}
    assert set(board([("n", 8, [], "宁德时代", "", None)], [("宁德时代", "300750.SZ")])) == {"300750.SZ"}


def test_codes_in_tags_and_sets_of_codes(board):
    got = board([("n", 8, ["300750.sz", "see 600519.SH", "1300750.SZ"], "宁德时代", "", None)], [("宁德时代", "300750.SZ")])
    assert {c: r.news_count for c, r in got.items()} == {"300750.SZ": 1, "600519.SH": 1}
    assert got["300750.SZ"].avg_sentiment is None and got["300750.SZ"].heat_score == 8.0
    assert board([], []) == {}


@pytest.mark.parametrize(("vcp", "trend", "rs", "level"), [(1, 0, 50, "double_confirmed"), (0, 1, 50, "double_confirmed"), (1, 1, 95, "double_confirmed"), (0, 0, 85, "strong_rs"), (0, 0, 80, "strong_rs"), (0, 0, 79, "catalyst_only"), (0, 0, None, "catalyst_only")])
def test_levels(board, vcp, trend, rs, level):
    got = board([("n", 8, ["acme corp"], "", "", 1.0)], [("acme corp", "000012.SZ")], [(12, 0.5)] * vcp, [(12, 0.7)] * trend, [(12, "Acme", rs)] if rs else [])["000012.SZ"]
    assert (got.confirm_level, got.in_vcp, got.in_trend, got.rs_rating) == (level, bool(vcp), bool(trend), rs)
    assert got.name == ("Acme" if vcp or trend else None)


@pytest.mark.parametrize(("sum_pct", "sentiment", "left", "warning"), [(-10.0, 5.0, 1.5, "strong_down"), (-5.0, 5.0, 3.0, "down"), (-4.9, 5.0, 5.0, None), (-20.0, -2.0, -2.0, "strong_down"), (-20.0, None, None, None)])
def test_a_fall_tempers_good_news(board, sum_pct, sentiment, left, warning):
    got = board([("n", 7, ["acme corp"], "", "", sentiment), ("o", 7, ["acme corp"], "", "", sentiment)], [("acme corp", "000012")], move=[(12, sum_pct)])["000012"]
    assert (got.avg_sentiment, got.warning, got.heat_score) == (left, warning, 14 + 2 * max(left or 0, 0))
