"""Relative strength of every day at once, copied to days without trade, and the board of a day; written once for both engines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marlstone.operators.cross_section import PERIODS, WEIGHTS
from marlstone.plans.dialect import both, run_text
from marlstone.session import settle
from marlstone.sources import adapters

#: Days before a day whose bars its rating may use.
LOOKBACK = adapters.DAYS
#: Days of a block that is rated at once, and what its rows hold of a bar.
BLOCK, RATED = 4, ["code", "name", *PERIODS, "score"]


def _periods(template: str, glue: str = ", ") -> str:
    return glue.join(template.format(p=p, k=k - 1, w=f"{WEIGHTS[p]}e0") for p, k in PERIODS.items())


BARS = "v AS (SELECT code, name, trade_date, CAST(close AS DOUBLE) AS close FROM every_quote WHERE close > 0)"


def daily_ratings(d, lookback: int = LOOKBACK) -> str:
    """CTEs up to rated: the cross-section of each day on which anything was traded.

    A bar stands for its series from its own day to the day before the next one, for as
    long as the lookback lets it, so that each (series, day) comes from one bar and no
    day is computed for itself.
    """
    return f"""{BARS},
t AS (SELECT DISTINCT trade_date AS day FROM v),
{_lagged()},
x AS (SELECT *, {d.days("trade_date", f"least(coalesce(later - 1, (SELECT max(day) FROM t)), trade_date + {lookback})")} AS day FROM l WHERE c_p3 IS NOT NULL),
{_scored(d, lookback)}"""


def _lagged() -> str:
    return f"""l AS (SELECT *, {_periods("lag(close, {k}) OVER w AS c_{p}, lag(trade_date, {k}) OVER w AS d_{p}")}, lead(trade_date) OVER w AS later FROM v WINDOW w AS (PARTITION BY code ORDER BY trade_date))"""


SCORE = f"""CAST(round(CAST(({_periods("CASE WHEN {p} IS NULL THEN 0e0 ELSE {p} * {w} END", " + ")}) / ({_periods("CASE WHEN {p} IS NULL THEN 0e0 ELSE {w} END", " + ")}) AS DECIMAL(20,8)), 4) AS DOUBLE) AS score"""


def _scored(d, lookback: int) -> str:
    """From x, the bars that may stand for a day: CTEs up to rated."""
    return f"""y AS (SELECT x.code, x.name, x.day, x.trade_date, {_periods(f"CASE WHEN d_{{p}} >= x.day - {lookback} THEN CAST(round(CAST((close / c_{{p}} - 1) * 100 AS DECIMAL(20,8)), 2) AS DOUBLE) END AS {{p}}")} FROM x JOIN t ON t.day = x.day WHERE d_p3 >= x.day - {lookback}),
scored AS (SELECT *, {SCORE} FROM y),
rated AS (SELECT *, CAST(greatest(1, least(99, {d.even("CAST((rank() OVER (PARTITION BY day ORDER BY score) + (count(*) OVER (PARTITION BY day, score) - 1) / 2.0) / count(*) OVER (PARTITION BY day) * 98 + 1 AS DECIMAL(12,6))")})) AS INT) AS rs_rating FROM scored)"""


def backfill(d, start: str | None = None, end: str | None = None, lookback: int = LOOKBACK) -> str:
    """A rating for each series and calendar day from ``start`` to ``end``: that of the day itself, or of the last day of trade before it."""
    first, last = (f"DATE '{x}'" if x else f"(SELECT {f}(day) FROM t)" for x, f in ((start, "min"), (end, "max")))
    return f"""WITH {daily_ratings(d, lookback)},
cal AS (SELECT {d.days(f"least({first}, (SELECT min(day) FROM t))", last)} AS day),
src AS (SELECT cal.day, max(t.day) OVER (ORDER BY cal.day ROWS UNBOUNDED PRECEDING) AS source_day FROM cal LEFT JOIN t ON t.day = cal.day)
SELECT rated.code, rated.name, src.day AS trade_date, {_periods("rated.{p}")}, rated.score, rated.rs_rating, src.day != src.source_day AS copied FROM src JOIN rated ON rated.day = src.source_day WHERE src.day >= {first}"""


def board(d, day: str = adapters.AS_OF, top: int = 200, least: int = 1, lookback: int = LOOKBACK) -> str:
    """The ratings of ``day``, or of the last day rated before it, from ``least`` on, with that day's close and change: best first, ``top`` of them. Names with a mark are left out."""
    return f"""WITH {daily_ratings(d, lookback)},
{_best(day, top, least)}"""


def _best(day: str, top: int, least: int) -> str:
    return f"""p AS (SELECT max(day) AS day FROM rated WHERE day <= DATE '{day}'),
q AS (SELECT code, trade_date, close, close - lag(close) OVER (PARTITION BY code ORDER BY trade_date) AS change, lag(close) OVER (PARTITION BY code ORDER BY trade_date) AS before FROM v),
b AS (SELECT rated.code, rated.name, rated.day AS trade_date, {_periods("rated.{p}")}, rated.score, rated.rs_rating, q.close, round(q.change, 4) AS change, round(q.change / q.before * 100, 4) AS pct_change
  FROM rated JOIN p ON p.day = rated.day LEFT JOIN q ON q.code = rated.code AND q.trade_date = rated.day WHERE rated.name NOT LIKE '%ST%' AND rated.rs_rating >= {least})
SELECT * FROM b ORDER BY rs_rating DESC, pct_change DESC NULLS LAST, close DESC NULLS LAST, code LIMIT {top}"""


QUERIES, ORACLES = both({"rs_backfill": (backfill, "every_quote"), "rs_board": (board, "every_quote")})


def bars_and_days(spark, every_quote):
    """The bars v and the days of trade t of ``daily_ratings``, each computed once, as the text names them many times."""
    bars = settle(run_text(spark, lambda d: f"WITH {BARS} SELECT * FROM v", every_quote=every_quote))
    return {"bars": bars, "days": settle(bars.select(F.col("trade_date").alias("day")).distinct())}


def rs_board(spark, sf_dir, day: str = adapters.AS_OF, top: int = 200, least: int = 1, lookback: int = LOOKBACK):
    """``board``, rating no day but its own: bars stand for spans of days, so the last day rated is the last day of trade in the latest span."""
    frames = bars_and_days(spark, adapters.every_quote(spark, sf_dir))
    text = lambda d: f"""WITH v AS (SELECT * FROM bars), t AS (SELECT * FROM days),
{_lagged()},
u AS (SELECT *, least(coalesce(later - 1, (SELECT max(day) FROM t)), trade_date + {lookback}, d_p3 + {lookback}) AS until FROM l WHERE c_p3 IS NOT NULL AND trade_date <= DATE '{day}'),
o AS (SELECT max(day) AS day FROM t WHERE day <= (SELECT max(least(until, DATE '{day}')) FROM u WHERE until >= trade_date)),
x AS (SELECT u.*, o.day FROM u JOIN o ON u.trade_date <= o.day AND u.until >= o.day),
{_scored(d, lookback)},
{_best(day, top, least)}"""  # noqa: E731
    return run_text(spark, text, **frames)


QUERIES["rs_board"] = rs_board


def _spans(lookback: int) -> str:
    """From l: CTEs up to s, the stretches of days for which a bar stands with the same changes and score, so that these are computed once a bar instead of once a day.

    The longer a period, the older its bar and the sooner it leaves the lookback.
    """
    names = sorted(PERIODS, key=PERIODS.get)
    until = {p: f"least(until, coalesce(d_{p} + {lookback}, trade_date - 1))" for p in names}
    spans = [f"named_struct('n', {n}, 'start', {f'greatest(trade_date, {until[names[n]]} + 1)' if n < len(names) else 'trade_date'}, 'stop', {until[p]})" for n, p in enumerate(names, 1)]
    valid = {p: f"CASE WHEN span.n >= {n} THEN CAST(round(CAST((close / c_{p} - 1) * 100 AS DECIMAL(20,8)), 2) AS DOUBLE) END AS {p}" for n, p in enumerate(names, 1)}
    return f"""u AS (SELECT *, least(coalesce(later - 1, (SELECT max(day) FROM t)), trade_date + {lookback}) AS until FROM l WHERE c_p3 IS NOT NULL),
o AS (SELECT *, explode(filter(array({", ".join(spans)}), x -> x.start <= x.stop)) AS span FROM u),
y AS (SELECT code, name, span.start AS start, span.stop AS stop, {", ".join(valid[p] for p in PERIODS)} FROM o),
s AS (SELECT *, {SCORE} FROM y)"""


def ranked(scores: np.ndarray) -> np.ndarray:
    """Ratings from 1 to 99 of sorted scores by their mean rank, rounded to six digits and then to the even whole number, as ``even`` does to decimals, in whole numbers."""
    n = len(scores)
    twice = np.searchsorted(scores, scores, "left") + 1 + np.searchsorted(scores, scores, "right")
    millionths = (98_000_000 * twice + n) // (2 * n) + 1_000_000
    whole, part = millionths // 1_000_000, millionths % 1_000_000
    return np.clip(whole + ((part > 500_000) | ((part == 500_000) & (whole % 2 == 1))), 1, 99).astype(np.int32)


def _days_of_block(block: pa.Table) -> pa.Table:
    """The rows of each day of trade in a block of days, from the spans (code, name, p3 ..., score, start, stop) that reach into it."""
    block = block.sort_by("score")
    number = lambda c: block.column(c).to_numpy()
    start, stop, score = number("first"), number("last"), number("score")
    parts = []
    for day in sorted(block.column("days")[0].as_py()) if len(score) else []:
        rows = np.flatnonzero((start <= day) & (stop >= day))
        if len(rows):
            parts.append(block.select(RATED).take(pa.array(rows)).append_column("day", pa.array(np.full(len(rows), day, np.int32))).append_column("rs_rating", pa.array(ranked(score[rows]))))
    return pa.concat_tables(parts) if parts else pa.schema([*(block.schema.field(c) for c in RATED), pa.field("day", pa.int32()), pa.field("rs_rating", pa.int32())]).empty_table()


def rated_days(spark, every_quote, lookback: int = LOOKBACK, start: str | None = None, end: str | None = None):
    """``backfill`` of these bars: spans of days go to the blocks of days that they reach into, whose days of trade are rated by arrays, each day of its own."""
    days = settle(run_text(spark, lambda d: f"WITH {BARS} SELECT DISTINCT trade_date AS day FROM v", every_quote=every_quote))
    number = "datediff({}, DATE '1970-01-01')".format
    spans = f"""WITH {BARS}, t AS (SELECT * FROM days),
{_lagged()},
{_spans(lookback)},
k AS (SELECT {", ".join(RATED)}, {number("start")} AS first, {number("stop")} AS last FROM s),
x AS (SELECT *, explode(sequence(first DIV {BLOCK}, last DIV {BLOCK})) AS block FROM k),
b AS (SELECT {number("day")} DIV {BLOCK} AS block, collect_list({number("day")}) AS days FROM t GROUP BY 1)
SELECT /*+ BROADCAST(b) */ x.*, b.days FROM x JOIN b ON b.block = x.block"""
    met = run_text(spark, lambda d: spans, every_quote=every_quote, days=days)
    kinds = "code long, name string, " + "".join(f"{p} double, " for p in PERIODS) + "score double, day int, rs_rating int"
    rated = met.groupBy("block").applyInArrow(_days_of_block, kinds)
    first, last = (f"DATE '{x}'" if x else f"(SELECT {f}(day) FROM t)" for x, f in ((start, "min"), (end, "max")))
    text = f"""WITH t AS (SELECT * FROM days),
cal AS (SELECT explode(sequence(least({first}, (SELECT min(day) FROM t)), {last}, INTERVAL 1 DAY)) AS day),
src AS (SELECT cal.day, max(t.day) OVER (ORDER BY cal.day ROWS UNBOUNDED PRECEDING) AS source_day FROM cal LEFT JOIN t ON t.day = cal.day)
SELECT /*+ BROADCAST(src) */ rated.code, rated.name, src.day AS trade_date, {_periods("rated.{p}")}, rated.score, rated.rs_rating, src.day != src.source_day AS copied FROM src JOIN ratings AS rated ON rated.day = {number("src.source_day")} WHERE src.day >= {first}"""
    return run_text(spark, lambda d: text, days=days, ratings=rated)


QUERIES["rs_backfill"] = lambda spark, sf_dir: rated_days(spark, adapters.every_quote(spark, sf_dir))


def ratings_between(spark, sf_dir: str, start: str, end: str, lookback: int = LOOKBACK):
    """``rs_backfill`` of these days, from the bars that they can use."""
    from datetime import date, timedelta

    first = date.fromisoformat(start) - timedelta(days=lookback + 31)
    bars = adapters.quotes(spark, sf_dir, end, (date.fromisoformat(end) - first).days)
    return run_text(spark, lambda d: backfill(d, start, end, lookback), every_quote=bars)
