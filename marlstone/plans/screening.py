"""Pattern detection and screening funnels, article prefilter, event signals and scalar functions, written once for both engines."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import features as fx
from marlstone.operators import cross_section as cs
from marlstone.operators.text_marks import Marked, marked
from marlstone.plans.cross_section import ORACLES as CROSS
from marlstone.plans.dialect import SparkSql, both, run_text
from marlstone.plans.events import roots_within
from marlstone.plans.news import HOT_NOW
from marlstone.plans.relational import ROOTS
from marlstone.session import settle, table
from marlstone.sources.adapters import AS_OF, DAYS, QUOTES, news, quotes, title_of

#: Fixed values of the contraction pattern: reversal, contractions, decay of amplitude and volume, last amplitude, exceptions, bars.
REVERSAL, FEWEST, MOST, AMP_DECAY, VOLUME_DECAY, LAST_AMP, ALLOWED, LEAST_BARS, WINDOW = 0.02, 2, 5, 0.90, 0.95, 0.08, 1, 40, 120
#: Pairs of equal titles whose ids may go to all tasks; more are joined by a shuffle.
FEW = 100_000


def spark(d) -> bool:
    return type(d).__name__ == "SparkSql"


def state(d, t: str, i: str, v: str, p: str) -> str:
    return f"named_struct('t', {t}, 'i', {i}, 'v', {v}, 'p', {p})" if spark(d) else f"{{'t': {t}, 'i': {i}, 'v': {v}, 'p': {p}}}"


def pivots(d, reversals: tuple[float, ...] = (), gathered: bool = False) -> str:
    """CTEs up to z(code, n, h, l, w, p): highs, lows and volumes of the last bars of a series and its turning points, each as its bar, positive for a high.

    One fold over the closes holds the direction, the extreme and its bar, and
    the turning points confirmed by a reversal; the last extreme is added. With
    ``reversals`` a series gathered once is folded for each of them, in a column ``reversal``.
    With ``gathered`` the series come as ``windows``, a row each, instead of as bars.
    """
    limit, also = ("reversal", "reversal, ") if reversals else (REVERSAL, "")
    listed_g, spread = ("g0", f"\ng AS (SELECT *, {d.unnest(d.array(*(f'{r!r}e0' for r in reversals)))} AS reversal FROM g0),") if reversals else ("g", "")
    same = state(d, "a.t", "a.i", "a.v", "a.p")
    move = lambda t: state(d, t, "x.i", "x.v", "a.p")
    add = "concat(a.p, array({}))" if spark(d) else "list_concat(a.p, [{}])"
    turn = lambda t, sign: state(d, t, "x.i", "x.v", add.format(f"{sign}a.i"))
    fall, rise = f"(a.v - x.v) / a.v >= {limit}", f"(x.v - a.v) / a.v >= {limit}"
    step = f"""CASE WHEN a.t = 0 THEN CASE WHEN x.v > a.v THEN {move("0")} WHEN {fall} THEN {turn("-1", "")} WHEN x.v < a.v THEN {move("0")} ELSE {same} END
  WHEN a.t = 1 THEN CASE WHEN x.v > a.v THEN {move("1")} WHEN {fall} THEN {turn("-1", "")} ELSE {same} END
  ELSE CASE WHEN x.v < a.v THEN {move("-1")} WHEN {rise} THEN {turn("1", "-")} ELSE {same} END END"""
    item = state(d, "0", "CAST(k AS BIGINT)", "CAST(close AS DOUBLE)", "CAST(array() AS ARRAY<BIGINT>)" if spark(d) else "CAST([] AS BIGINT[])")
    if spark(d):
        listed = lambda x: f"transform(array_sort(collect_list(struct(k, {x} AS y))), z -> z.y)"
        folded = f"aggregate(slice(s, 2, greatest(size(s) - 1, 0)), s[0], (a, x) -> {step})"
        last, empty = "abs(element_at(f.p, -1))", "size(f.p) = 0"
        grown = "CASE WHEN size(f.p) = 0 THEN array(CASE WHEN element_at(s, -1).v >= s[0].v THEN 1L ELSE -1L END) WHEN abs(element_at(f.p, -1)) != f.i THEN concat(f.p, array(CASE WHEN f.t < 0 THEN -f.i ELSE f.i END)) ELSE f.p END"
    else:
        listed = lambda x: f"list({x} ORDER BY k)"
        folded = f"list_reduce(s, lambda a, x: {step})"
        grown = "CASE WHEN len(f.p) = 0 THEN [CASE WHEN s[len(s)].v >= s[1].v THEN 1 ELSE -1 END] WHEN abs(f.p[len(f.p)]) != f.i THEN list_concat(f.p, [CASE WHEN f.t < 0 THEN -f.i ELSE f.i END]) ELSE f.p END"
    fold = f"""f AS (SELECT code, {also}n, h, l, w, c, s, {folded} AS f FROM g),
z AS (SELECT code, {also}n, h, l, w, c, {grown} AS p FROM f)"""
    if gathered:
        return f"""{listed_g} AS (SELECT * FROM windows),{spread}
{fold}"""
    return f"""b AS (SELECT code, high, low, close, volume, count(*) OVER (PARTITION BY code) - row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) + 1 AS k, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS back FROM quotes),
c AS (SELECT code, high, low, close, volume, CAST(row_number() OVER (PARTITION BY code ORDER BY k) AS BIGINT) AS k FROM b WHERE back <= {WINDOW}),
{listed_g} AS (SELECT code, count(*) AS n, {listed("CAST(high AS DOUBLE)")} AS h, {listed("CAST(low AS DOUBLE)")} AS l, {listed("volume")} AS w, {listed("CAST(close AS DOUBLE)")} AS c, {listed(item)} AS s FROM c GROUP BY code),{spread}
{fold}"""


def contractions(d, reversals: tuple[float, ...] = (), gathered: bool = False) -> str:
    """From z: the stretch of turning points from the highest high on, and its high-low-high legs as amplitude and mean volume."""
    if spark(d):
        return pivots(d, reversals, gathered) + """,
q AS (SELECT *, array_max(transform(filter(p, y -> y > 0), y -> h[int(y) - 1])) AS peak FROM z),
m AS (SELECT *, slice(p, greatest(array_position(transform(p, y -> CASE WHEN y > 0 THEN h[int(y) - 1] ELSE 0D END), peak), 1), 1000) AS base FROM q),
e AS (SELECT *, int(greatest(floor((size(base) - 1) / 2), 0)) AS legs FROM m),
o AS (SELECT *, CASE WHEN legs > 0 THEN transform(sequence(1, legs), j -> round((h[int(base[2 * j - 2]) - 1] - l[int(-base[2 * j - 1]) - 1]) / h[int(base[2 * j - 2]) - 1], 4)) ELSE CAST(array() AS ARRAY<DOUBLE>) END AS amps,
  CASE WHEN legs > 0 THEN transform(sequence(1, legs), j -> filter(slice(w, int(base[2 * j - 2]), int(-base[2 * j - 1] - base[2 * j - 2] + 1)), y -> y > 0)) ELSE CAST(array() AS ARRAY<ARRAY<BIGINT>>) END AS parts FROM e),
v AS (SELECT *, transform(parts, y -> CASE WHEN size(y) > 0 THEN round(aggregate(y, 0L, (a, x) -> a + x) / size(y), 2) ELSE 0D END) AS vols, element_at(c, -1) AS last FROM o)"""
    return pivots(d, reversals, gathered) + """,
q AS (SELECT *, list_max(list_transform(list_filter(p, lambda y: y > 0), lambda y: h[y])) AS peak FROM z),
m AS (SELECT *, p[greatest(coalesce(list_position(list_transform(p, lambda y: CASE WHEN y > 0 THEN h[y] ELSE 0e0 END), peak), 0), 1):] AS base FROM q),
e AS (SELECT *, CAST(greatest((len(base) - 1) // 2, 0) AS INT) AS legs FROM m),
o AS (SELECT *, list_transform(range(1, legs + 1), lambda j: round((h[base[2 * j - 1]] - l[-base[2 * j]]) / h[base[2 * j - 1]], 4)) AS amps,
  list_transform(range(1, legs + 1), lambda j: list_filter(w[base[2 * j - 1]:-base[2 * j]], lambda y: y > 0)) AS parts FROM e),
v AS (SELECT *, list_transform(parts, lambda y: CASE WHEN len(y) > 0 THEN round(CAST(list_sum(y) AS DOUBLE) / len(y), 2) ELSE 0e0 END) AS vols, c[len(c)] AS last FROM o)"""


def violations(d, x: str, ratio: float | str) -> str:
    """How many items exceed ``ratio`` times the one before."""
    if spark(d):
        return f"size(filter(sequence(1, greatest(size({x}) - 1, 1)), j -> j < size({x}) AND {x}[j] > {x}[j - 1] * {ratio}))"
    return f"len(list_filter(range(1, greatest(len({x}), 1)), lambda j: {x}[j + 1] > {x}[j] * {ratio}))"


def vcp(d, gathered: bool = False) -> str:
    last_amp = f"{'element_at(amps, -1)' if spark(d) else 'amps[len(amps)]'} <= {LAST_AMP}"
    structural = f"n >= {LEAST_BARS} AND legs BETWEEN {FEWEST} AND {MOST} AND {violations(d, 'amps', AMP_DECAY)} <= {ALLOWED} AND {violations(d, 'vols', VOLUME_DECAY)} <= {ALLOWED}"
    text = f"""WITH {contractions(d, gathered=gathered)}
SELECT code, n AS bars, legs AS contractions, round(peak, 4) AS pivot, legs >= 2 AND {violations(d, "amps", AMP_DECAY)} <= {ALLOWED} AS decay_ok, legs >= 2 AND {violations(d, "vols", VOLUME_DECAY)} <= {ALLOWED} AS volume_ok,
  round((last - peak) / peak * 100, 2) AS pivot_distance_pct, abs((last - peak) / peak) <= 0.05 AS near_pivot, {structural} AS detected, CASE WHEN {structural} AND NOT ({last_amp if spark(d) else f"coalesce({last_amp}, false)"}) THEN 'wide_final' ELSE 'standard' END AS variant FROM v"""
    return text


STAGE2 = """
ex AS (SELECT code, CAST(min(CASE WHEN rn <= 120 THEN low END) AS DOUBLE) AS low_120, CAST(max(CASE WHEN rn <= 60 THEN high END) AS DOUBLE) AS high_60, CAST(max(CASE WHEN rn = 1 THEN close END) AS DOUBLE) AS close, count(*) AS n,
  CAST(max(CASE WHEN rn <= 40 THEN high END) - min(CASE WHEN rn <= 40 THEN low END) AS DOUBLE) / CAST(max(CASE WHEN rn = 1 THEN close END) AS DOUBLE) AS range40, CAST(max(CASE WHEN rn <= 10 THEN high END) - min(CASE WHEN rn <= 10 THEN low END) AS DOUBLE) / CAST(max(CASE WHEN rn = 1 THEN close END) AS DOUBLE) AS range10,
  coalesce(CAST(sum(CASE WHEN rn <= 5 AND close < open THEN volume END) AS DOUBLE) / nullif(count(CASE WHEN rn <= 5 AND close < open THEN 1 END), 0), 0) AS down_volume, CAST(sum(CASE WHEN rn <= 50 THEN volume END) AS DOUBLE) / count(CASE WHEN rn <= 50 THEN 1 END) AS volume_50 FROM r GROUP BY code),"""


def stage2(d) -> str:
    """Boolean of each stage for every series, so that a stage's count is the number of rows where all up to it hold."""
    fold = lambda p: f"aggregate(c, c[0], (a, x) -> a + (x - a) * {2 / (p + 1)!r}D)" if spark(d) else f"list_reduce(c, lambda a, x: a + (x - a) * (2e0 / {p + 1}))"
    closes = "transform(array_sort(collect_list(struct(trade_date, CAST(close AS DOUBLE) AS y))), z -> z.y)" if spark(d) else "list(CAST(close AS DOUBLE) ORDER BY trade_date)"
    quantile = "percentile(CAST(close AS DOUBLE), 0.9)" if spark(d) else "quantile_cont(CAST(close AS DOUBLE), 0.9)"
    best = "max_by(bin, struct(v, -bin))" if spark(d) else "arg_max(bin, (v, -bin))"
    return f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn FROM quotes),{STAGE2}
ec AS (SELECT code, {closes} AS c FROM quotes GROUP BY code), ema AS (SELECT code, {fold(20)} AS e20, {fold(50)} AS e50, {fold(120)} AS e120 FROM ec),
qc AS (SELECT code, CASE WHEN count(*) >= 10 THEN {quantile} END AS q90 FROM r WHERE rn <= 60 GROUP BY code),
pl AS (SELECT code, CAST(close AS DOUBLE) AS close, volume FROM r WHERE rn <= 120), ps AS (SELECT code, min(close) AS low, max(close) AS high, count(*) AS n FROM pl GROUP BY code),
pb AS (SELECT pl.code, low, high, n, CASE WHEN high = low THEN 0 ELSE CAST(least(19, floor((close - low) / ((high - low) / 20))) AS INT) END AS bin, sum(volume) AS v FROM pl JOIN ps ON pl.code = ps.code GROUP BY 1, 2, 3, 4, 5),
pm AS (SELECT code, low, high, n, {best} AS bin FROM pb GROUP BY code, low, high, n), poc AS (SELECT code, CASE WHEN n >= 20 THEN CASE WHEN high = low THEN low ELSE low + (bin + 0.5) * ((high - low) / 20) END END AS poc FROM pm),
s AS (SELECT ex.code, e20 > e50 AND e50 > e120 AS a1, close >= low_120 * 1.30 AS a2, close >= high_60 * 0.85 AS a3, poc IS NULL OR close > poc AS b1, q90 IS NULL OR close > q90 AS b2,
  ex.n < 10 OR range10 <= range40 * 0.6 AND range10 <= 0.15 AND down_volume < volume_50 AS c1, CASE WHEN ex.n >= 10 THEN round(1 - range10 / range40, 3) END AS vcp_score FROM ex JOIN ema ON ema.code = ex.code LEFT JOIN poc ON poc.code = ex.code LEFT JOIN qc ON qc.code = ex.code)
SELECT code, a1, a2, a3, b1, b2, c1, a1 AND a2 AND a3 AND b1 AND b2 AND c1 AS passed, vcp_score FROM s"""


def stage2_counts(d) -> str:
    stages = ["a1", "a2", "a3", "b1", "b2", "c1"]
    counts = ", ".join(f"count(CASE WHEN {' AND '.join(stages[: i + 1])} THEN 1 END) AS n_{s}" for i, s in enumerate(stages))
    head, _, tail = stage2(d).rpartition("\nSELECT ")
    return f"{head}\nSELECT {counts} FROM s"


ARTICLE = "a AS (SELECT id, source, url, related_to_id, ai_score, is_highlight, status, published, tags, coalesce(title, '') AS title, coalesce(content, '') AS content, coalesce(title, '') || ' ' || coalesce(content, '') AS body, lower(coalesce(title, '') || ' ' || coalesce(content, '')) AS low_body FROM news)"


def prefilter(d, marked: bool = False) -> str:
    """Action for each article: official and major ones are scored, low-value ones dropped, copies of their root inherit, then the tier and the score decide; of those to drop, one in twenty by id is audited.

    With ``marked``, ``articles`` are those whose texts were tested before, and ``silent`` the ids of those that add nothing to a root of equal title.
    """
    tier = "CASE WHEN official THEN 'A' WHEN rate < 0.03 AND samples >= 200 THEN 'D' WHEN rate < 0.1 THEN 'C' WHEN rate >= 0.3 THEN 'A' ELSE 'B' END"
    score = fx.prefilter_score(d, "t.body", "t.low_body", "t.tier")
    beside = f"""p AS (SELECT t.*, {score} AS score, r.title AS root_title, r.body AS root_body FROM t LEFT JOIN a AS r ON r.id = t.related_to_id),
n AS (SELECT *, root_title IS NOT NULL AND root_title = title AND NOT {fx.news_beside(d, "body", "coalesce(root_body, '')")} AS no_news FROM p),"""
    if marked:
        beside = f"n AS (SELECT t.*, {score} AS score, s.id IS NOT NULL AS no_news FROM t LEFT JOIN silent AS s ON s.id = t.id),"
    return f"""WITH {"a AS (SELECT * FROM articles)" if marked else ARTICLE}, q AS (SELECT source, count(*) AS samples, count(CASE WHEN ai_score >= 6 THEN 1 END) * 1e0 / count(*) AS rate FROM {"articles" if marked else "news"} GROUP BY source),
h AS (SELECT a.*, {fx.official(d, "a.source", "a.url")} AS official, {fx.hard_signal(d, "body", "low_body")} AS hard, samples, rate FROM a JOIN q ON q.source = a.source),
t AS (SELECT *, {tier} AS tier, {fx.low_value(d, "title", "content", "hard")} AS low, {fx.has(d, "low_body", fx.MAJOR)} AS major FROM h),
{beside}
x AS (SELECT *, CASE WHEN official OR major THEN 'score' WHEN low IS NOT NULL THEN 'drop' WHEN no_news THEN 'inherit' WHEN tier = 'D' OR tier = 'C' AND hard < 2 OR score <= 1 THEN 'drop' ELSE 'score' END AS action FROM n)
SELECT id, official, tier, hard, low, score, no_news, CASE WHEN action = 'drop' AND id % 20 = 0 THEN 'audit' ELSE action END AS action FROM x"""


def silent_copies(articles: DataFrame, texts: DataFrame) -> DataFrame:
    """(id) of the articles (id, title, related_to_id) that have their root's title and add nothing to its text; of ``texts`` (id, body) only those of such pairs of equal titles are compared."""
    roots = articles.select(F.col("id").alias("root"), F.col("title").alias("root_title"))
    pairs = settle(articles.join(roots, F.col("root") == F.col("related_to_id")).where("title = root_title").select("id", "root").distinct())
    asked = pairs.select(F.col("id").alias("key"), "id", F.lit(False).alias("of_root")).unionByName(pairs.select(F.col("id").alias("key"), F.col("root").alias("id"), F.lit(True).alias("of_root")))
    told = texts.join(F.broadcast(asked) if pairs.count() <= FEW else asked, "id").groupBy("key")
    both = told.agg(F.max(F.when(~F.col("of_root"), F.col("body"))).alias("body"), F.max(F.when(F.col("of_root"), F.col("body"))).alias("root_body"))
    return both.where(f"NOT {fx.news_beside(SparkSql(), 'body', 'root_body')}").select(F.col("key").alias("id"))


def prefilter_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``prefilter``: whole texts are tested where they are read, and of each article only the tests, its title and its start go on."""
    d = Marked()
    prefilter(d, True)
    docs = table(spark, sf_dir, "documents")
    texts = docs.select("*", F.coalesce(title_of("text"), F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("content"))
    # The first 120 characters tell the title, and a content of 80 or more is long for every rule of low value.
    found = marked(texts.select("doc_id", "lang", "source", F.substring("text", 1, 120).alias("text"), "title", "content"), d.tests)
    start = F.substring(F.coalesce("content", F.lit("")), 1, 80).alias("content")
    articles = settle(news(spark, sf_dir, found, tuple(d.tests.values())).select("id", "source", "url", "related_to_id", "ai_score", F.coalesce("title", F.lit("")).alias("title"), start, *d.tests.values()))
    silent = silent_copies(articles, texts.select(F.col("doc_id").alias("id"), F.concat_ws(" ", "title", "content").alias("body")))
    return run_text(spark, lambda _: prefilter(d, True), articles=articles, silent=silent)


def signals(d) -> str:
    """Five signals of each event from 0 to 10, their boost up to 3, and the rank with it."""
    clamp = lambda x, low=0: f"CAST({'bround' if spark(d) else 'round_even'}(greatest({low}e0, least(10e0, {x})), 0) AS INT)"
    add = lambda cond, n: f"CASE WHEN {cond} THEN {n}e0 ELSE 0e0 END"
    raw = "4e0 + " + " + ".join([add("official", 3), add("sources >= 3", 2), add("sources = 2", 1), add("quantified", 1)]) + " - " + " - ".join([add("uncertain", 2), add("anonymous", 2), add("conflict", 2)])
    return f"""WITH {ROOTS}, g AS (SELECT root, count(DISTINCT source) AS sources FROM roots GROUP BY root),
e AS (SELECT n.id, ai_score, is_highlight, status, sources, n.id % 3 = 0 AS updated, n.id % 4 = 1 AS watched, n.id % 7 = 2 AS uncertain, n.id % 11 = 3 AS anonymous, n.id % 13 = 4 AS conflict, n.id % 5 = 0 AND n.id % 2 = 0 AS official, {d.rx("coalesce(title, '')", "[0-9]")} AS quantified, n.id % 6 = 0 AS confirmed FROM news n JOIN g ON g.root = n.id WHERE related_to_id IS NULL),
c AS (SELECT *, {raw} AS confidence_raw FROM e),
s AS (SELECT id, {clamp("least(ai_score, 10e0) + " + add("updated", 2.5).replace("2.5e0", "2.5e0") + " + " + add("is_highlight", 2))} AS impact,
  {clamp("CASE status WHEN 'new' THEN 9e0 WHEN 'developing' THEN 7e0 WHEN 'stable' THEN 4e0 WHEN 'resolved' THEN 2e0 ELSE 6e0 END + " + add("updated", 2))} AS novelty,
  {clamp("CASE status WHEN 'new' THEN 8e0 WHEN 'developing' THEN 9e0 WHEN 'stable' THEN 4e0 WHEN 'resolved' THEN 1e0 ELSE 6e0 END + " + add("updated", 1.5) + " + " + add("watched", 1.5))} AS urgency,
  {clamp("CASE WHEN status = 'resolved' THEN greatest(confidence_raw, 8e0) + " + add("confirmed", 1) + " ELSE confidence_raw END")} AS confidence,
  {clamp("3e0 + " + " + ".join([add("watched", 3), add("is_highlight", 2), add("status IN ('new', 'developing')", 2)]) + " - " + add("status = 'resolved'", 2), 1)} AS relevance FROM c)
SELECT *, round(greatest(0e0, least(3e0, 0.12e0 * impact + 0.14e0 * novelty + 0.16e0 * urgency + 0.10e0 * confidence + 0.08e0 * relevance - 3e0)), 4) AS boost FROM s"""


CHAIN = "SELECT id, CASE WHEN id % 5 IN (1, 2, 3) THEN id - 1 WHEN id % 5 = 4 AND id % 10 = 4 THEN id END AS parent FROM news"


def flatten(d) -> str:
    """The last root of each article, at most ten steps up; a cycle ends at the least id on it."""
    return f"""WITH RECURSIVE up AS ({CHAIN}), walk AS (SELECT id, id AS spot, parent, 0 AS depth FROM up UNION ALL SELECT w.id, u.id AS spot, u.parent, w.depth + 1 AS depth FROM walk w JOIN up u ON u.id = w.parent WHERE w.depth < 10 AND u.id != w.spot),
last AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth DESC) AS rn FROM walk)
SELECT id, spot AS root, depth FROM last WHERE rn = 1"""


SCALARS = {
    "year_from_url": (lambda d: f"SELECT id, CASE WHEN CAST({d.one('url', '(?:^|[/_.-])([0-9]{4})(?:[/_.-]|$)')} AS INT) BETWEEN 2000 AND 2099 THEN CAST({d.one('url', '(?:^|[/_.-])([0-9]{4})(?:[/_.-]|$)')} AS INT) END AS year FROM news", "news"),
    "clean_titles": (lambda d: f"""SELECT id, {d.sub(d.sub("title", "[【\\[][^\\]】]*[】\\]]", ""), "[，。！？、；：“”‘’（）\\s.,!?;:\"'()\\-　]", "")} AS clean, length({d.sub(d.sub("title || substring(content, 1, 200)", "[【\\[][^\\]】]*[】\\]]", ""), "\\s+", "")}) <= 150 AS short_lane FROM news""", "news"),
    "number_entities": (lambda d: f"SELECT id, {d.join(d.distinct(d.every(d.sub('substring(content, 1, 2000)', '[0-9]{1,2}月[0-9]{1,2}日|[0-9]{1,4}年|[0-9]{1,2}月', ''), '[0-9]+(?:[.][0-9]+)?(?:%|万户|亿|万亿|万|个基点|bps|bp)')), ',')} AS numbers FROM news", "news"),
    "language_ratio": (
        lambda d: f"WITH c AS (SELECT id, length({d.sub('content', '[^一-鿿]', '')}) AS cn, length({d.sub('content', '[^A-Za-z]', '')}) AS en FROM news) SELECT id, CASE WHEN cn + en = 0 THEN 0e0 ELSE cn * 1e0 / (cn + en) END AS ratio, CASE WHEN cn + en = 0 OR cn * 1e0 / (cn + en) >= 0.3 THEN false WHEN cn = 0 THEN true END AS english FROM c",
        "news",
    ),
    "tickers": (
        lambda d: f"WITH t AS (SELECT code, upper(trim(substring(name, 10 + CAST(code % 7 AS INT)))) AS raw FROM (SELECT DISTINCT code, name FROM quotes) AS q) SELECT code, raw, CASE WHEN {d.rx('raw', '^[0-9]{6}$')} OR {d.rx('raw', '^[0-9]{5}$')} THEN raw WHEN {d.rx('raw', '^[0-9]{4}$')} THEN '0' || raw WHEN {d.rx('raw', '^[A-Z]{3,5}([.][A-Z])?$')} THEN raw END AS ticker FROM t",
        "quotes",
    ),
    "text_tickers": (lambda d: f"WITH t AS (SELECT id, {d.distinct(d.filter(d.every('substring(content, 1, 5000)', '[A-Z]{3,5}|[0-9]{6}'), 'y', chr(121) + ' NOT IN (' + ', '.join(repr(x) for x in ('THE', 'AND', 'CEO', 'IPO', 'GDP', 'USA')) + ')'))} AS found FROM news) SELECT id, {d.join('found', ',')} AS tickers FROM t", "news"),
    "preview_length": (lambda d: f"SELECT id, CASE WHEN {d.rx('title || content', '(?i)earnings|guidance|regulat|policy|acqui|财报|业绩|监管|政策|并购|公告')} THEN 400 WHEN length(title) >= 24 AND {d.rx('title', '[0-9]')} THEN 120 ELSE 250 END AS chars FROM news", "news"),
    "string_lists": (lambda d: f"SELECT id, {d.join(d.filter(d.distinct('tags'), 't', 'length(trim(t)) > 0'), '|')} AS tags FROM news", "news"),
    "query_terms": (lambda d: f"SELECT id, substring(trim({d.sub(d.sub('title', '[^A-Za-z0-9_一-鿿 .-]', ' '), ' +', ' ')}), 1, 200) AS terms FROM news", "news"),
    "html_strip": (lambda d: f"SELECT id, trim({d.sub(d.sub('replace(' + chr(39) + '<p>' + chr(39) + ' || title || ' + chr(39) + '</p><script>x</script>' + chr(39) + ', ' + chr(39) + '&amp;' + chr(39) + ', ' + chr(39) + '&' + chr(39) + ')', '(?is)<(script|style)[^>]*>.*?</(script|style)>|<[^>]+>', ' '), '\\s+', ' ')}) AS plain FROM news", "news"),
    "market_links": (lambda d: f"SELECT DISTINCT code, CASE WHEN market = 'ASIA' THEN 'https://example.com/S/' || CASE WHEN CAST(code AS {d.string}) LIKE '6%' THEN 'SH' WHEN CAST(code AS {d.string}) LIKE '4%' OR CAST(code AS {d.string}) LIKE '8%' THEN 'BJ' ELSE 'SZ' END || code ELSE 'https://example.com/stock/' || code || '-US' END AS link FROM quotes", "quotes"),
    "quarter_ends": (lambda d: "WITH l AS (SELECT market, max(trade_date) AS today FROM quotes GROUP BY market), q AS (SELECT DISTINCT market, today, CAST(date_trunc('quarter', trade_date) AS DATE) - 1 AS quarter_end FROM quotes JOIN l USING (market)), r AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY quarter_end DESC) AS rn FROM q WHERE quarter_end <= today - 60) SELECT market, quarter_end FROM r WHERE rn <= 3", "quotes"),
    "hybrid_search": (
        lambda d: f"""WITH m AS (SELECT id, title, ai_score, published, {d.size(d.every("lower(title)", "(?:the|and|in)"))} AS a, {d.size(d.every("lower(substring(content, 1, 400))", "(?:the|and|in)"))} AS b, {d.has("tags", "'topic1'")} AS tagged FROM news),
s AS (SELECT *, CASE WHEN a + b > 0 THEN (a * 1e0 + b * 0.4e0) / (a + b + 5) ELSE 0.1e0 END AS cover FROM m WHERE a + b > 0 OR tagged)
SELECT id, round(cover * ln(ai_score + 1) / sqrt(greatest(({HOT_NOW} - published) / 3600e0, 0e0) + 2), 8) AS score, {d.sub("lower(title)", "(the|and)", "<b>$1</b>" if spark(d) else chr(92) + "1 ").replace(chr(92) + "1 ", "<b>" + chr(92) + "1</b>")} AS marked FROM s ORDER BY score DESC, id LIMIT 30""",
        "news",
    ),
    "heat_score": (
        lambda d: f"""WITH t AS (SELECT DISTINCT id, tag, ai_score FROM (SELECT id, {d.unnest("tags")} AS tag, ai_score FROM news) AS u), g AS (SELECT tag, count(*) AS n, max(ai_score) AS top, avg(ai_score) - 5 AS sentiment, max(id) AS newest FROM t GROUP BY tag),
w AS (SELECT *, CASE newest % 3 WHEN 0 THEN 'strong_down' WHEN 1 THEN 'down' END AS warning FROM g),
a AS (SELECT *, CASE WHEN sentiment > 0 AND warning = 'strong_down' THEN round(sentiment * 0.3, 1) WHEN sentiment > 0 AND warning = 'down' THEN round(sentiment * 0.6, 1) ELSE sentiment END AS adjusted FROM w)
SELECT tag, n, top, round(n * top + 2 * greatest(adjusted, 0e0), 2) AS heat, CASE WHEN newest % 4 = 0 OR newest % 5 = 0 THEN 'double_confirmed' WHEN newest % 100 >= 80 THEN 'strong_rs' ELSE 'catalyst_only' END AS confirm_level FROM a""",
        "news",
    ),
    "catalyst_levels": (lambda d: "WITH l AS (SELECT CASE WHEN id % 4 = 0 OR id % 5 = 0 THEN 'double_confirmed' WHEN id % 100 >= 80 THEN 'strong_rs' ELSE 'catalyst_only' END AS level FROM news) SELECT level, count(*) AS n FROM l GROUP BY level", "news"),
    "risk_sizing": (
        lambda d: "WITH x AS (SELECT trade_id, price, shares, CASE WHEN trade_id % 3 = 0 THEN price * 0.95 ELSE price * 0.93 END AS at_stop FROM trades), p AS (SELECT trade_id, CAST(price AS DOUBLE) AS entry, shares, CAST(at_stop AS DOUBLE) AS stop, CAST(round((price - at_stop) * shares, 2) AS DOUBLE) AS loss FROM x) SELECT trade_id, round(stop, 4) AS stop, round((stop - entry) / entry * 100, 2) AS stop_pct, greatest(loss, 0e0) AS max_loss, stop < entry AS stop_valid, greatest(loss, 0e0) / 1e7 * 100 > 1.5 AS over_limit, (entry - 150000) / 150000 * 100 <= 5 AS near_pivot FROM p",
        "trades",
    ),
    "trade_close": (lambda d: "SELECT trade_id, CAST(round(amount * CAST(pnl_pct AS DECIMAL(8,2)) * 0.01, 4) AS DOUBLE) AS pnl_amount, round(pnl_pct, 2) AS pnl_pct FROM closed_trades WHERE status = 'closed' AND pnl_pct IS NOT NULL", "closed_trades"),
    "entry_gates": (lambda d: "SELECT trade_id, CASE WHEN shares <= 0 THEN 'size' WHEN price <= 1000 THEN 'price' WHEN action != 'buy' THEN 'side' WHEN shares * price > 1500000 THEN 'position' WHEN trade_id % 10 = 0 THEN 'rules' ELSE 'open' END AS gate FROM trades", "trades"),
    "auto_stabilise": (lambda d: f"SELECT id, CASE WHEN status = 'developing' AND {HOT_NOW} - published > 48 * 3600 THEN 'stable' ELSE status END AS status FROM news WHERE related_to_id IS NULL", "news"),
    "alert_selection": (
        lambda d: f"""
WITH {ROOTS}, o AS (SELECT *, CASE WHEN {fx.official(d, "source", "url")} THEN 1 ELSE 0 END AS official FROM roots),
g AS (SELECT root, count(DISTINCT source) AS sources, max(official) AS official, count(*) AS version, count(CASE WHEN published < {HOT_NOW} - 86400 THEN 1 END) AS alerted FROM o WHERE published <= {HOT_NOW} GROUP BY root),
l AS (SELECT root, title AS latest_change, row_number() OVER (PARTITION BY root ORDER BY published DESC, id DESC) AS rn FROM roots WHERE published <= {HOT_NOW} AND id != root)
SELECT n.id, g.version, n.title, l.latest_change, n.ai_score, g.sources AS source_count, g.official = 1 AS official FROM news n JOIN g ON g.root = n.id JOIN l ON l.root = n.id AND l.rn = 1
WHERE n.related_to_id IS NULL AND n.ai_score >= 8 AND (g.official = 1 OR g.sources >= 2) AND length(trim(coalesce(l.latest_change, ''))) > 0 AND g.version > g.alerted""",
        "news",
    ),
    "version_step": (lambda d: f"WITH {ROOTS}, g AS (SELECT root, count(*) - 1 AS children, min(published) AS first, max(published) AS last FROM roots GROUP BY root) SELECT n.id, CASE WHEN children = 0 THEN 1 ELSE 1 + children END AS version, CASE WHEN status IN ('resolved', 'stable') THEN round((last - first) / 3600e0, 2) END AS hours FROM news n JOIN g ON g.root = n.id WHERE n.related_to_id IS NULL", "news"),
    "inherited_scores": (lambda d: "SELECT n.id, r.ai_score AS score FROM news n JOIN news r ON r.id = n.related_to_id WHERE n.title = r.title OR n.id % 2 = 0", "news"),
    "tier_validation": (lambda d: f"WITH k AS (SELECT DISTINCT code FROM quotes), s AS (SELECT DISTINCT code, CASE WHEN code % 3 = 0 THEN 'S' ELSE 'X' END AS tier FROM trades) SELECT k.code, coalesce(s.tier, 'A') AS tier FROM k LEFT JOIN s ON s.code = k.code", "quotes", "trades"),
    "model_agreement": (lambda d: "WITH m AS (SELECT id, ai_score AS a, (CAST(floor(ai_score * 10) AS INT) + id % 3 - 1) / 10e0 AS b FROM news) SELECT count(*) AS n, round(avg(abs(a - b)), 6) AS mae, round(count(CASE WHEN (a >= 6) = (b >= 6) THEN 1 END) * 1e0 / count(*), 6) AS agree6, round(count(CASE WHEN (a >= 8) = (b >= 8) THEN 1 END) * 1e0 / count(*), 6) AS agree8 FROM m", "news"),
    "embedding_backfill": (lambda d: f"SELECT n.id FROM news n {'LEFT ANTI' if spark(d) else 'ANTI'} JOIN (SELECT id FROM vectors) AS v ON v.id = n.id WHERE n.related_to_id IS NULL", "news", "vectors"),
    "hamming_pairs": (lambda d: f"SELECT a.id AS a, b.id AS b, CAST({d.bits('xor(a.id * 7919, b.id * 7919)' if not spark(d) else '(a.id * 7919) ^ (b.id * 7919)')} AS INT) AS distance FROM news a JOIN news b ON b.id = a.id + 1", "news"),
    "previous_digest": (lambda d: "WITH g AS (SELECT CAST(floor((published - 1704067200) / 14400) AS BIGINT) AS slot, min(published) AS start, max(published) AS stop, count(*) AS n FROM news GROUP BY CAST(floor((published - 1704067200) / 14400) AS BIGINT)) SELECT slot, coalesce(lag(stop) OVER (ORDER BY slot), start) AS start, stop, n FROM g", "news"),
    "batch_symbols": (lambda d: f"WITH s AS (SELECT DISTINCT upper(trim(' x' || CAST(code AS {d.string}) || ' ')) AS symbol FROM trades), k AS (SELECT DISTINCT 'X' || CAST(code AS {d.string}) AS symbol FROM quotes WHERE code % 2 = 0) SELECT s.symbol, CASE WHEN length(s.symbol) > 16 THEN 'failed' WHEN k.symbol IS NOT NULL THEN 'skipped' ELSE 'added' END AS result FROM s LEFT JOIN k ON k.symbol = s.symbol", "trades", "quotes"),
}

FOUND = {
    "vcp_detect": (vcp, "quotes"),
    "stage2_funnel": (stage2, "quotes"),
    "stage2_counts": (stage2_counts, "quotes"),
    "prefilter_decision": (prefilter, "news"),
    "event_signals": (signals, "news"),
    "root_flatten": (flatten, "news"),
    **SCALARS,
}

QUERIES, ORACLES = both(FOUND)


def root_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``flatten`` by joins, as Spark's recursion ends with an error at a million rows."""
    return roots_within(run_text(spark, lambda d: CHAIN, news=news(spark, sf_dir)))


QUERIES["root_flatten"] = root_flatten
QUERIES["prefilter_decision"] = prefilter_decision

#: Fixed value: a contraction score from which on a series is watched closely.
WATCHED = 0.8
SUMMARY = """t AS (SELECT m.market, x.code, x.vcp_score, w.code IS NULL AS fresh FROM today x JOIN m AS m ON m.code = x.code LEFT JOIN (SELECT code FROM before AS v WHERE passed) AS w ON w.code = x.code WHERE x.passed),
y AS (SELECT m.market, count(*) AS n FROM before x JOIN m AS m ON m.code = x.code WHERE x.passed GROUP BY m.market), g AS (SELECT market, count(*) AS base, count(CASE WHEN vcp_score >= {watched} THEN 1 END) AS watched, count(CASE WHEN fresh THEN 1 END) AS fresh FROM t GROUP BY market), k AS (SELECT DISTINCT market FROM m AS q)
SELECT k.market, coalesce(g.base, 0) AS base_count, coalesce(g.watched, 0) AS observe_count, coalesce(b.breakout_today, 0) AS breakout_confirm, CASE WHEN y.n > 0 THEN coalesce(g.fresh, 0) ELSE 0 END AS new_count, coalesce(y.n > 0, false) AS has_yesterday
FROM k LEFT JOIN g ON g.market = k.market LEFT JOIN y ON y.market = k.market LEFT JOIN breakout b ON b.market = k.market""".format(watched=WATCHED)


def filter_summary(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> DataFrame:
    """Each market's list on a day: its length, those watched closely, breakouts of the day, and those that the list of the day before lacks."""
    last = date.fromisoformat(as_of)
    both_days = settle(quotes(spark, sf_dir, as_of, DAYS + 1))  # a bar is of one day, so the lists of both days are cut from one pass
    bars = both_days.where(F.col("trade_date") >= F.lit(last - timedelta(days=DAYS)))
    on = lambda listed: settle(run_text(spark, stage2, quotes=listed).select("code", "passed", "vcp_score"))
    frames = {"today": on(bars), "before": on(both_days.where(F.col("trade_date") < F.lit(last))), "m": bars.select("code", "market").distinct(), "breakout": cs.breakout_efficacy(bars).select("market", "breakout_today")}
    return run_text(spark, lambda d: "WITH " + SUMMARY, **frames)


QUERIES["filter_summary"] = filter_summary
ORACLES["filter_summary"] = f"""WITH today AS ({ORACLES["stage2_funnel"]}), before AS ({ORACLES["stage2_funnel"].replace(AS_OF, str(date.fromisoformat(AS_OF) - timedelta(days=1)))}), {QUOTES.strip()}, m AS (SELECT DISTINCT code, market FROM quotes),
breakout AS ({CROSS["breakout_efficacy"]}), {SUMMARY}"""
