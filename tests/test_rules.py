"""Rules against values worked out by hand."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marlstone.operators import cross_section as cs
from marlstone.operators import folds, ledger
from marlstone.operators.news import hot_tags, normal_url
from marlstone.plans import relational, screening
from marlstone.plans.dialect import run_text
from marlstone.sources import sinks
from marlstone.sources.adapters import quotes

DAY = dt.date(2001, 1, 1)
BAR = "code long, trade_date date, open decimal(18,2), high decimal(18,2), low decimal(18,2), close decimal(18,2), volume long, amount decimal(18,2), name string, market string"


def bars(spark, closes, volumes=None, code=1, name="n", market="m", opens=None, amount=None):
    volumes, opens = volumes or [100] * len(closes), opens or closes
    dec = lambda x: Decimal(str(x))
    rows = [(code, DAY + dt.timedelta(days=i), dec(o), dec(max(c, o)), dec(min(c, o)), dec(c), v, dec(amount[i] if amount else c * v), name, market) for i, (c, v, o) in enumerate(zip(closes, volumes, opens, strict=True))]
    return spark.createDataFrame(rows, BAR)


def test_turnover_counts_all_names_and_the_25th_day_back(spark):
    amounts = [1000] + [100] * 24 + [250]  # 25 days before the last one is the first, of 1000
    both = bars(spark, [1] * 26, amount=amounts).unionByName(bars(spark, [1] * 26, code=2, name="ST x", amount=amounts))
    (r,) = cs.turnover_ratio(both).collect()
    assert (r.n_before, r.turnover_pct) == (25, round(250 / ((1000 + 24 * 100) / 25) * 100, 2))


def test_breakouts_need_their_window_and_a_later_bar(spark):
    closes, volumes = [10.0] * 100, [100] * 100
    closes[80], volumes[80] = 11.0, 123  # 1.2 times the mean that includes it, 19 days before the end
    closes[85], volumes[85] = 11.5, 500
    closes[99], volumes[99] = 12.0, 300
    weak = bars(spark, closes, [100] * 100, code=2)  # a new high without volume
    st = bars(spark, closes, volumes, code=3, name="*ST x")
    (r,) = cs.breakout_efficacy(bars(spark, closes, volumes).unionByName(weak).unionByName(st)).collect()
    assert (r.sample_count, r.positive_ratio, r.breakout_today) == (2, 50.0, 1)  # 11 -> 11.5 gains, 11.5 -> 10 does not


def test_contraction_takes_bars_below_their_open(spark):
    b = bars(spark, [10] * 11 + [12, 11], opens=[10] * 11 + [13, 10], volumes=[100] * 11 + [40, 70])
    (r,) = cs.range_contraction(b).collect()
    assert r.down_volume == 40.0  # the last bar falls against the day before, not against its open


def test_index_leaves_out_st_and_compounds(spark):
    b = bars(spark, [100, 110, 121]).unionByName(bars(spark, [100, 50, 10], code=2, name="ST"))
    got = [(r.n, r.level) for r in cs.equal_weight_index(b).orderBy("trade_date").collect()]
    assert got == [(1, pytest.approx(1100)), (1, pytest.approx(1210))]


def test_equal_high_is_a_new_high_and_volume_includes_today(spark):
    b = bars(spark, [10.0] * 60, volumes=[100] * 59 + [300])
    (r,) = folds.trend_signals(b).collect()
    assert r.t3 and r.t4 and r.volume_ratio == round(300 / (2200 / 20), 2)
    (s,) = folds.trend_screen(b).collect()
    assert (s.liquid, s.fresh, s.long_enough, s.t1) == (False, True, True, False)


def test_nav_skips_codes_sold_beyond_what_was_bought(spark):
    rows = [(1, 1, "buy", 10, Decimal("5"), DAY), (2, 2, "sell", 3, Decimal("7"), DAY)]
    t = spark.createDataFrame(rows, "trade_id long, code long, action string, shares long, price decimal(18,2), trade_date date")
    (r,) = ledger.nav(t, bars(spark, [6.0]), 1000.0).collect()
    assert (r.codes, r.cash, r.holdings, r.assets, r.nav) == (1, 971.0, 60.0, 1031.0, 1.031)


def test_kpi_uses_a_trades_own_result(spark):
    rows = [("m", "closed", 10.0, True), ("m", "closed", 6.0, None), ("m", "closed", -4.0, False), ("m", "open", None, None), ("w", "closed", 1.0, True)]
    got = {r.market: r for r in ledger.trade_kpi(spark.createDataFrame(rows, "market string, status string, pnl_pct double, followed_rule boolean")).collect()}
    m = got["m"]
    assert (m.sample_size, m.discipline_rate, m.avg_win_pct, m.avg_loss_pct, m.profit_loss_ratio, m.win_rate, m.passed) == (3, 50.0, 8.0, 4.0, 2.0, 66.7, False)
    assert got["w"].profit_loss_ratio is None and got["w"].avg_loss_pct == 0.0


@pytest.mark.parametrize(("url", "want"), [(" https://a.com/ ", "https://a.com/"), ("https://a.com", "https://a.com"), ("https://a.com/b//?utm_x=1&q=2#f", "https://a.com/b?q=2"), ("https://a.com/b;v=1?feed_item=3", "https://a.com/b")])
def test_normal_urls(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(normal_url(F.col("u"))).first()[0] == want


def test_hot_tags_of_a_day(spark):
    n = spark.createDataFrame([(["a"], 100, 9.0), (["a", "b"], 90_000, 8.0), (["b"], 90_001, 6.0)], "tags array<string>, published long, ai_score double")
    assert [tuple(r) for r in hot_tags(n, 90_000).collect()] == [("a", 1), ("b", 1)]


def test_contraction_pattern(spark):
    closes = [50 + 50 * i / 24 for i in range(25)] + [88, 95, 92, 97, 94] + [99] * 15
    detected = bars(spark, [round(c, 2) for c in closes], volumes=[5000 - 100 * i for i in range(45)])
    rising = bars(spark, [10 + i for i in range(45)], code=2)
    alternating = bars(spark, [100, 90] * 22, code=3)
    short = bars(spark, [100, 90, 95], code=4)
    every = detected.unionByName(rising).unionByName(alternating).unionByName(short)
    got = {r.code: r for r in run_text(spark, screening.vcp, quotes=every).collect()}
    assert (got[1].detected, got[1].contractions, got[1].pivot, got[1].near_pivot) == (True, 3, 100.0, True)
    assert not any(got[c].detected for c in (2, 3, 4))


def test_chains_and_cycles_end(spark):
    news = spark.createDataFrame([(i,) for i in range(12)], "id long")
    got = {r.id: (r.root, r.depth) for r in run_text(spark, screening.flatten, news=news).collect()}
    assert got[3] == (0, 3) and got[5] == (5, 0) and got[8] == (5, 3)
    assert got[4] == (4, 0)  # its own parent


def test_dates_are_pruned_at_the_scan(spark):
    plan = quotes(spark, "/root/testdata/sf0.001", "2001-01-01", 30)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
    days = [r.trade_date for r in quotes(spark, "/root/testdata/sf0.001", "2001-01-01", 30).collect()]
    assert days and min(days) >= dt.date(2000, 12, 2) and max(days) <= dt.date(2001, 1, 1)


def test_stale_at_five_not_four(spark):
    b = bars(spark, [1, 2, 2, 2, 2, 3]).unionByName(bars(spark, [1, 2, 2, 2, 2, 2], code=2)).unionByName(bars(spark, [2, 2], code=3))
    got = {r.code: r.stale for r in run_text(spark, relational.FOUND["stale_series"][0], quotes=b).collect()}
    assert got == {1: False, 2: True, 3: False}


def test_upsert_keeps_an_old_name_only_where_the_new_is_empty(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, name string, v int")
    new = spark.createDataFrame([(1, "", 5), (2, "c", None), (3, None, 9)], "k int, name string, v int")
    got = sorted(map(tuple, sinks.upsert(stored, new, ["k"], keep_old=("name",)).collect()))
    assert got == [(1, "a", 5), (2, "c", None), (3, None, 9)]
