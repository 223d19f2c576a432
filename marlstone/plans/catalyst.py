"""Catalyst board: the day's high-scored news by the series that their entities stand for, set against screens and ratings.

Entities come from a dictionary table (entity, code), codes with or without a market's
suffix; tags may also be codes themselves. Written once for both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import cross_section as cs
from marlstone.operators import folds as fold_ops
from marlstone.plans import cross_section, folds, screening
from marlstone.plans.dialect import DuckSql, run_text
from marlstone.session import settle, table
from marlstone.sources.adapters import NEWS, news, quotes, with_views

#: Least score of the news, most news of a day, titles shown; rating from which on a series is strong; falls of five bars, in per cent, that temper good news, and what is left of it then.
LEAST, MOST, TITLES, STRONG = 7, 100, 5, 80
FALL, STEEP, TEMPERED, STEEPLY = -5, -10, 0.6, 0.3
#: Tags that name no company.
NO_COMPANY = ["A股", "港股", "美股", "沪深", "创业板", "科创板", "北交所", "利好", "利空", "涨停", "跌停", "大盘", "行情", "机构", "基金", "ETF", "央行", "财政部", "证监会", "交易所", "宏观", "GDP", "CPI", "PMI", "LPR", "MLF"]
#: Local midnight of the day, in seconds; the given news start then.
DAY = 1704067200 - 28800
BARE = "CAST(split_part(code, '.', 1) AS BIGINT)"
CODE = r"(?i)\b([0-9]{6}\.(?:SZ|SH|BJ))\b"


def _meant(d, day: int, least: float, most: int) -> str:
    """CTEs up to m(id, code): the day's news and the codes that they stand for."""
    excluded = ", ".join(map(d.lit, NO_COMPANY))
    return f"""WITH h AS (SELECT * FROM news WHERE published >= {day} AND published < {day + 86400} AND ai_score >= {least} ORDER BY ai_score DESC, id LIMIT {most}),
g AS (SELECT id, trim(tag) AS tag FROM (SELECT id, {d.unnest("tags")} AS tag FROM h) AS u),
k AS (SELECT id, tag FROM g WHERE length(tag) >= 2 AND tag NOT IN ({excluded}) AND NOT {d.rx("tag", "^[0-9]+$")} AND NOT (length(tag) <= 3 AND {d.rx("tag", "^[ -~]*$")})
  UNION ALL SELECT id, trim(entity) AS tag FROM h WHERE length(trim(entity)) >= 2 AND trim(entity) NOT IN ({excluded})),
m AS (SELECT DISTINCT id, code FROM (SELECT k.id, e.code FROM k JOIN entities e ON e.entity = k.tag WHERE e.code IS NOT NULL UNION ALL SELECT id, upper({d.one("tag", CODE)}) AS code FROM g WHERE {d.rx("tag", CODE)}) AS u)"""


def board(d, day: int = DAY, least: float = LEAST, most: int = MOST) -> str:
    """Over news (id, title, ai_score, tags, entity, kind, sentiment, published), entities (entity, code), vcp (code, vcp_score), trend (code, trend_score), rating (code, name, rs_rating) and move (code, sum_pct)."""
    tenth = lambda x: f"CAST(round(CAST({x} AS DECIMAL(20,8)), 1) AS DOUBLE)"
    return f"""{_meant(d, day, least, most)},
n AS (SELECT m.code, h.*, row_number() OVER (PARTITION BY m.code ORDER BY h.ai_score DESC, h.id) AS rn FROM m JOIN h ON h.id = m.id),
t AS (SELECT code, {d.gather("substring(title, 1, 80)", "rn")} AS titles FROM n WHERE rn <= {TITLES} GROUP BY code),
c AS (SELECT code, {d.gather("kind", "kind")} AS kinds FROM (SELECT DISTINCT code, kind FROM n WHERE kind != '') AS u GROUP BY code),
a AS (SELECT code, {BARE} AS bare, count(*) AS news_count, max(ai_score) AS top_score, {tenth("sum(CAST(ai_score AS DECIMAL(8,4))) * 1e0 / count(*)")} AS avg_score, {tenth("sum(CAST(sentiment AS DECIMAL(8,4))) * 1e0 / count(sentiment)")} AS raw FROM n GROUP BY code),
j AS (SELECT a.*, v.code IS NOT NULL AS in_vcp, v.vcp_score, w.code IS NOT NULL AS in_trend, w.trend_score, r.rs_rating, CASE WHEN v.code IS NOT NULL OR w.code IS NOT NULL THEN r.name END AS name, p.sum_pct,
  CASE WHEN p.sum_pct <= {STEEP} THEN 'strong_down' WHEN p.sum_pct <= {FALL} THEN 'down' END AS warning
  FROM a LEFT JOIN vcp v ON v.code = a.bare LEFT JOIN trend w ON w.code = a.bare LEFT JOIN rating r ON r.code = a.bare LEFT JOIN move p ON p.code = a.bare),
s AS (SELECT *, CASE WHEN raw > 0 AND warning = 'strong_down' THEN {tenth(f"raw * {STEEPLY}e0")} WHEN raw > 0 AND warning = 'down' THEN {tenth(f"raw * {TEMPERED}e0")} ELSE raw END AS avg_sentiment FROM j)
SELECT s.code, name, news_count, top_score, avg_score, kinds, titles, avg_sentiment, CASE WHEN raw IS NOT NULL THEN warning END AS warning, round(sum_pct, 2) AS pct_5d, in_vcp, vcp_score, in_trend, trend_score, rs_rating,
  round(news_count * top_score + greatest(coalesce(avg_sentiment, 0e0), 0e0) * 2, 2) AS heat_score, CASE WHEN in_vcp OR in_trend THEN 'double_confirmed' WHEN rs_rating >= {STRONG} THEN 'strong_rs' ELSE 'catalyst_only' END AS confirm_level
FROM s JOIN t ON t.code = s.code LEFT JOIN c ON c.code = s.code"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, code): what a tag stands for; a source is named like a supplier."""
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("entity"), F.concat(F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.lit(".SZ")).alias("code"))


def catalyst_board(spark: SparkSession, sf_dir: str, day: int = DAY) -> DataFrame:
    bars = settle(quotes(spark, sf_dir))  # read once for all that follows
    told = news(spark, sf_dir).withColumns({"entity": F.lit(""), "kind": F.element_at("tags", 3), "sentiment": F.col("ai_score") - 5})
    # A row a series each; settled before they are filtered, as a filter would be pushed into their folds and run them again.
    # Screens and moves are of a series each: only those that the board names are computed. Ratings take all.
    dictionary = entities(spark, sf_dir)
    named = run_text(spark, lambda d: f"{_meant(d, day, LEAST, MOST)} SELECT DISTINCT {BARE} AS code FROM m", news=told, entities=dictionary)
    few = settle(bars.join(F.broadcast(settle(named)), "code", "left_semi"))  # a few codes for each of at most ``MOST`` articles
    funnel = settle(run_text(spark, screening.stage2, quotes=few).select("code", "vcp_score"))
    vcp = settle(run_text(spark, screening.vcp, quotes=few).select("code", "detected")).where("detected").select("code").join(funnel, "code", "left")
    trend = settle(fold_ops.trend_screen(few, newest=bars.agg(F.max("trade_date").alias("newest")))).where("liquid AND fresh AND long_enough AND t1 AND t2 AND t3 AND t4 AND t5").select("code", F.col("score").alias("trend_score"))
    frames = {"news": told, "entities": dictionary, "vcp": vcp, "trend": trend, "rating": cs.rs_rating(bars).select("code", "name", "rs_rating"), "move": cs.price_trend(few).select("code", "sum_pct")}
    frames |= {n: settle(frames[n]) for n in ("rating", "move")}
    return run_text(spark, lambda d: board(d, day), **frames)


def catalyst_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many series of the board each level has, and their mean heat."""
    return catalyst_board(spark, sf_dir).groupBy("confirm_level").agg(F.count("*").alias("n"), F.round(F.avg("heat_score"), 4).alias("mean_heat"))


QUERIES = {"catalyst_board": catalyst_board, "catalyst_stats": catalyst_stats}

_BOARD = with_views(
    NEWS.replace("news AS (", "plain AS (", 1),
    sql=f""", news AS (SELECT *, '' AS entity, tags[3] AS kind, ai_score - 5 AS sentiment FROM plain),
entities AS (SELECT 'src' || s_suppkey AS entity, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.SZ' AS code FROM supplier),
funnel AS ({screening.ORACLES["stage2_funnel"]}), vd AS ({screening.ORACLES["vcp_detect"]}), td AS ({folds.ORACLES["trend_screen"]}), rating AS ({cross_section.ORACLES["rs_rating"]}), move AS ({cross_section.ORACLES["price_trend"]}),
vcp AS (SELECT vd.code, vcp_score FROM vd LEFT JOIN funnel ON funnel.code = vd.code WHERE detected), trend AS (SELECT code, score AS trend_score FROM td WHERE liquid AND fresh AND long_enough AND t1 AND t2 AND t3 AND t4 AND t5), """
    + board(DuckSql()).removeprefix("WITH "),
)
ORACLES = {"catalyst_board": _BOARD, "catalyst_stats": f"SELECT confirm_level, count(*) AS n, round(avg(heat_score), 4) AS mean_heat FROM ({_BOARD}) AS b GROUP BY confirm_level"}
