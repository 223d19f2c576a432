"""Feed parsing, the state of digests, codes in replies and the rolling backtest of contraction patterns, written once for both engines.

Versions, updates and earlier digests, which the given tables lack, are made from ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans.dialect import both, duck_query, run_text
from marlstone.plans.portfolio import rounded
from marlstone.plans.screening import ALLOWED, FEWEST, LEAST_BARS, MOST, VOLUME_DECAY, contractions, vcp, violations
from marlstone.session import settle
from marlstone.sources import adapters

#: Bars of a window of the backtest, and bars from one window to the next.
FRAME, STEP = 90, 5
#: Least score of an event of a digest; characters of a title put in for an empty one.
LEAST_SCORE, TITLE = 5, 200
#: The period of the digest.
BEGIN, END = 1704067200 + 3600, 1704067200 + 9000
KEY = 1_000_000  # above any number of bars

DAYS = "numbered AS (SELECT code, trade_date, high, low, close, volume, row_number() OVER (PARTITION BY code ORDER BY trade_date) AS pos, count(*) OVER (PARTITION BY code) AS total FROM quotes)"


def ahead(bars: int) -> str:
    return f"(CAST(lead(close, {bars}) OVER (PARTITION BY code ORDER BY trade_date) AS DOUBLE) - CAST(close AS DOUBLE)) / CAST(close AS DOUBLE) AS r{bars}"


RETURNS = f"returns AS (SELECT code, trade_date, pos, {', '.join(map(ahead, (5, 10, 20, 60)))} FROM numbered)"


def frames(d) -> str:
    """Bars once for each window of ``FRAME`` bars, every ``STEP`` bars, that holds them, as a series of its own."""
    return f"""WITH {DAYS}, spread AS (SELECT *, {d.unnest(d.array(*map(str, range(0, FRAME, STEP))))} AS step FROM numbered),
ends AS (SELECT *, CAST(ceil(pos / {STEP}.0) * {STEP} + step AS BIGINT) AS stop FROM spread)
SELECT CAST(code AS BIGINT) * {KEY} + stop AS code, trade_date, high, low, close, volume FROM ends WHERE stop >= {FRAME} AND stop < pos + {FRAME} AND stop <= total"""


def windows(bars: DataFrame) -> DataFrame:
    """The windows of ``frames`` as ``screening.pivots`` gathers them, (code, n, h, l, w, c, s): a series is gathered once and cut, so bars are neither repeated nor sorted for each window."""
    series = bars.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("trade_date", F.col("high").cast("double").alias("high"), F.col("low").cast("double").alias("low"), "volume", F.col("close").cast("double").alias("close")))).alias("a"))
    cut = series.where(F.size("a") >= FRAME).select("code", "a", F.explode(F.sequence(F.lit(FRAME), F.size("a"), F.lit(STEP))).alias("stop"))
    cut = cut.select((F.col("code").cast("long") * KEY + F.col("stop")).alias("code"), F.slice("a", F.col("stop") - FRAME + 1, FRAME).alias("a"))
    empty = F.array().cast("array<bigint>")
    start = F.transform("a", lambda x, i: F.struct(F.lit(0).alias("t"), (i + 1).cast("long").alias("i"), x["close"].alias("v"), empty.alias("p")))
    return cut.select("code", F.lit(FRAME).cast("long").alias("n"), F.col("a.high").alias("h"), F.col("a.low").alias("l"), F.col("a.volume").alias("w"), F.col("a.close").alias("c"), start.alias("s"))


def hits(d) -> str:
    """Detected patterns with the returns after them."""
    return f"""WITH {DAYS}, {RETURNS}
SELECT r.code, r.trade_date, f.contractions, f.pivot, f.near_pivot, round(r5 * 100, 2) AS fwd5, round(coalesce(r10, 0e0) * 100, 2) AS fwd10, round(coalesce(r20, 0e0) * 100, 2) AS fwd20, round(r60 * 100, 2) AS fwd60
FROM found f JOIN returns r ON CAST(r.code AS BIGINT) * {KEY} + r.pos = f.code WHERE f.detected AND r5 IS NOT NULL"""


def backtest_sql(d) -> str:
    return hits(d).replace("WITH ", f"WITH framed AS ({frames(d)}), found AS ({vcp(d).replace('FROM quotes', 'FROM framed')}), ", 1)


def vcp_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detected pattern of the windows with the returns after it. Patterns are settled first: a filter on them would be pushed into their fold and repeat it."""
    quotes = adapters.quotes(spark, sf_dir)
    found = settle(run_text(spark, lambda d: vcp(d, gathered=True), windows=windows(quotes)))
    return run_text(spark, hits, quotes=quotes, found=found)


#: Sets of limits (reversal, decay of amplitude) that the backtest compares, and its horizons in bars.
VARIANTS = {"relaxed": (0.02, 0.90), "mid": (0.03, 0.85), "strict": (0.03, 0.80)}
HORIZONS = (5, 10, 20, 60)


def detected_variants(d, gathered: bool = False) -> str:
    """Patterns of each window under each set of limits. A window is gathered once and folded once for each distinct reversal; the sets then share its legs."""
    names = d.array(*(f"'{name}'" for name in VARIANTS))
    pick = lambda i: "CASE variant " + " ".join(f"WHEN '{name}' THEN {limits[i]!r}e0" for name, limits in VARIANTS.items()) + " END"
    return f"""WITH {contractions(d, tuple(sorted({r for r, _ in VARIANTS.values()})), gathered)},
k AS (SELECT *, {d.unnest(names)} AS variant FROM v), i AS (SELECT *, {pick(1)} AS decay FROM k WHERE reversal = {pick(0)})
SELECT code, variant, abs((last - peak) / peak) <= 0.05 AS near_pivot, n >= {LEAST_BARS} AND legs BETWEEN {FEWEST} AND {MOST} AND {violations(d, "amps", "decay")} <= {ALLOWED} AND {violations(d, "vols", VOLUME_DECAY)} <= {ALLOWED} AS detected FROM i"""


def variant_summary(d) -> str:
    """Numbers of hits of each market and set of limits, with the median, the mean and the share of gains after each horizon."""
    after = ", ".join(f"CAST(round(CAST({f'coalesce(r{k}, 0e0)' if k in (10, 20) else f'r{k}'} * 100 AS DECIMAL(20,8)), 2) AS DOUBLE) AS f{k}" for k in HORIZONS)
    stats = ", ".join(f"{rounded(f'median(f{k})', 2)} AS fwd{k}_median, {rounded(f'avg(f{k})', 2)} AS fwd{k}_mean, {rounded(f'count(CASE WHEN f{k} > 0 THEN 1 END) * 100e0 / nullif(count(f{k}), 0)', 1)} AS fwd{k}_win" for k in HORIZONS)
    return f"""WITH {DAYS}, {RETURNS}, m AS (SELECT DISTINCT code, market FROM quotes),
h AS (SELECT m.market, f.variant, f.near_pivot, {after} FROM found f JOIN returns r ON CAST(r.code AS BIGINT) * {KEY} + r.pos = f.code JOIN m ON m.code = r.code WHERE f.detected AND r5 IS NOT NULL)
SELECT market, variant, count(*) AS hits, {stats}, count(CASE WHEN near_pivot THEN 1 END) AS near_pivot_hits FROM h GROUP BY market, variant"""


def variants_sql(d) -> str:
    return variant_summary(d).replace("WITH ", f"WITH framed AS ({frames(d)}), found AS ({detected_variants(d).replace('FROM quotes', 'FROM framed')}), ", 1)


def vcp_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backtest under every set of limits in one pass over the windows."""
    quotes = adapters.quotes(spark, sf_dir)
    found = settle(run_text(spark, lambda d: detected_variants(d, gathered=True), windows=windows(quotes)))
    return run_text(spark, variant_summary, quotes=quotes, found=found)


def vcp_baseline(d) -> str:
    """Returns of a series 20 bars after any evaluated day, detected or not."""
    return f"""WITH {DAYS}, {RETURNS}
SELECT code, count(*) AS n, round(median(r20) * 100, 2) AS median_pct, round(100e0 * count(CASE WHEN r20 > 0 THEN 1 END) / count(*), 1) AS win_pct
FROM returns WHERE pos >= {FRAME} AND (pos - {FRAME}) % {STEP} = 0 AND r20 IS NOT NULL GROUP BY code"""


def within(x: str) -> str:
    return f"coalesce({x} >= {BEGIN} AND {x} < {END}, FALSE)"


EVENTS = f"""events AS (SELECT id AS event_id, title, status, published AS first_seen, CASE WHEN id % 3 != 0 THEN published + (id % 9) * 1800 END AS updated, CASE WHEN id % 11 != 0 THEN id % 5 + 1 END AS version
  FROM news WHERE related_to_id IS NULL AND ai_score >= {LEAST_SCORE}),
chosen AS (SELECT *, CASE WHEN {within("updated")} AND status = 'resolved' THEN 'RESOLVED' WHEN {within("first_seen")} THEN 'NEW_EVENT' ELSE 'MATERIAL_UPDATE' END AS change_type
  FROM events WHERE {within("first_seen")} OR {within("updated")}),
told AS (SELECT event_id AS told_id, version - event_id % 2 AS told_version, CASE event_id % 3 WHEN 0 THEN 'must_know' WHEN 1 THEN 'worth_watching' ELSE 'ongoing_updates' END AS section FROM events WHERE first_seen < {BEGIN + 1800})"""


def digest_changes(d) -> str:
    """Events of the period, new or updated in it, with what changed."""
    return f"WITH {EVENTS} SELECT event_id, change_type, version, {within('updated')} AS updated_in_period FROM chosen"


def digest_repeats(d) -> str:
    """Events told before at this version or a later one are left out unless resolved; those told as must-know count as quiet."""
    again = "coalesce(version <= told_version, FALSE) AND change_type != 'RESOLVED'"
    return f"""WITH {EVENTS} SELECT event_id, change_type, CASE WHEN NOT ({again}) THEN 'kept' WHEN section = 'must_know' THEN 'quiet' ELSE 'dropped' END AS verdict
FROM chosen LEFT JOIN told ON told_id = event_id"""


def digest_ongoing(d) -> str:
    """Events told before that the period does not touch: going on while they develop, else quiet if they were must-know."""
    return f"""WITH {EVENTS}, s AS (SELECT event_id, version, CASE WHEN status = 'developing' THEN 'ongoing' WHEN section = 'must_know' THEN 'quiet' END AS state
  FROM told JOIN events ON event_id = told_id WHERE section IN ('must_know', 'worth_watching') AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.event_id = told_id))
SELECT event_id, state, coalesce(version, 1) AS version FROM s WHERE state IS NOT NULL"""


def digest_sections(d) -> str:
    """Each event once, in the first of its sections; empty titles are filled from the event."""
    sections = d.array("'must_know'", "'worth_watching'", "'worth_watching'", "'ongoing_updates'")
    return f"""WITH {EVENTS}, e AS (SELECT event_id, title, {d.unnest(sections)} AS section FROM chosen),
r AS (SELECT event_id, section, CASE section WHEN 'must_know' THEN 0 WHEN 'worth_watching' THEN 1 ELSE 2 END AS rank, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'reply ' || event_id END AS named, title FROM e
  WHERE section = 'must_know' AND event_id % 3 = 0 OR section = 'worth_watching' AND event_id % 2 = 0 OR section = 'ongoing_updates'),
f AS (SELECT event_id, min(rank) AS rank, max(named) AS named, max(title) AS title FROM r GROUP BY event_id)
SELECT event_id, CASE rank WHEN 0 THEN 'must_know' WHEN 1 THEN 'worth_watching' ELSE 'ongoing_updates' END AS section, CASE WHEN named = '' THEN substring(coalesce(title, ''), 1, {TITLE}) ELSE named END AS title FROM f"""


def first_of(d, *names: str) -> str:
    return f"coalesce({', '.join(d.field('entry', n) for n in names)})"


def feed_rows(d) -> str:
    """Rows of JSON entries whose fields go by several names; seconds since 1970 give the time, anything else none; entries without a title or address go."""
    made = """CASE id % 5 WHEN 0 THEN '{"title": " ' || t || ' ", "content": "body", "id": ' || (id + 1) || ', "ctime": ' || published || '}'
  WHEN 1 THEN '{"brief": "' || t || '", "aid": "a' || id || '", "created_at": "' || published || '"}'
  WHEN 2 THEN '{"title": "", "brief": "' || t || '", "description": "more", "url": "https://feed.example.com/' || id || '", "timestamp": "soon"}'
  WHEN 3 THEN '{"title": "' || t || '"}' ELSE '{"brief": "", "id": 7}' END"""
    return f"""WITH t AS (SELECT id, published, {d.sub("coalesce(title, '')", "[^A-Za-z ]+", "")} AS t FROM news), j AS (SELECT id, {made} AS entry FROM t),
f AS (SELECT id, trim(coalesce({first_of(d, "title", "brief")}, '')) AS title, trim(coalesce({first_of(d, "content", "brief", "description")}, '')) AS content,
  {first_of(d, "id", "aid")} AS item, {d.field("entry", "url")} AS link, TRY_CAST({first_of(d, "ctime", "created_at", "timestamp")} AS BIGINT) AS published FROM j),
u AS (SELECT id, title, content, CASE WHEN item IS NOT NULL THEN 'https://feed.example.com/detail/' || item ELSE coalesce(link, '') END AS url, published FROM f)
SELECT id, title, content, url, published FROM u WHERE title != '' AND url != ''"""


def filing_tags(d) -> str:
    """Form and company of titles such as ``8-K - Name (0000012) (Filer)``; other titles have neither."""
    form, rest = r"[A-Z0-9\-/]+", r"\s*\([0-9]+\)\s*\(Filer\)\s*$"
    made = "CASE id % 4 WHEN 0 THEN '8-K - Some - Name ' || id || ' (000' || id || ') (Filer)' WHEN 1 THEN '10-K/A -  Corp ' || source || '  (12)  (Filer) ' WHEN 2 THEN '8-K - No number (Filer)' ELSE title END"
    whole = rf"^{form}\s*-\s*.+?{rest}"
    return f"""WITH t AS (SELECT id, trim({made}) AS t FROM news)
SELECT id, CASE WHEN {d.rx("t", whole)} THEN {d.one("t", rf"^({form})\s*-\s*.+?{rest}")} END AS form, CASE WHEN {d.rx("t", whole)} THEN trim({d.one("t", rf"^{form}\s*-\s*(.+?){rest}")}) END AS company FROM t"""


def tier_codes(d) -> str:
    """Codes of a reply as the pool writes them: as given, in capitals, in small letters, or without their suffix; unknown ones stay as they are."""
    return f"""WITH c AS (SELECT DISTINCT code, lpad(CAST(code AS {d.string}), 6, '0') AS base FROM quotes),
p AS (SELECT code, base, base || CASE code % 3 WHEN 0 THEN '.SZ' WHEN 1 THEN '.sh' ELSE '.Hk' END AS name FROM c),
k AS (SELECT name, name AS spelt FROM p UNION SELECT name, upper(name) FROM p UNION SELECT name, lower(name) FROM p UNION SELECT name, base FROM p),
g AS (SELECT code, CASE code % 5 WHEN 0 THEN name WHEN 1 THEN lower(name) WHEN 2 THEN base WHEN 3 THEN upper(name) ELSE 'x' || base END AS given FROM p),
t AS (SELECT code, given, given AS spelt, 0 AS place FROM g UNION ALL SELECT code, given, upper(given), 1 FROM g UNION ALL SELECT code, given, lower(given), 2 FROM g),
m AS (SELECT t.code, k.name, row_number() OVER (PARTITION BY t.code ORDER BY t.place, k.name) AS rn FROM t JOIN k ON k.spelt = t.spelt)
SELECT g.code, g.given, coalesce(m.name, g.given) AS mapped, m.name IS NOT NULL AS known FROM g LEFT JOIN m ON m.code = g.code AND m.rn = 1"""


FOUND = {
    "vcp_baseline": (vcp_baseline, "quotes"),
    "digest_changes": (digest_changes, "news"),
    "digest_repeats": (digest_repeats, "news"),
    "digest_ongoing": (digest_ongoing, "news"),
    "digest_sections": (digest_sections, "news"),
    "feed_rows": (feed_rows, "news"),
    "filing_tags": (filing_tags, "news"),
    "tier_codes": (tier_codes, "quotes"),
}
QUERIES, ORACLES = both(FOUND)
QUERIES |= {"vcp_backtest": vcp_backtest, "vcp_variants": vcp_variants}
ORACLES |= {"vcp_backtest": duck_query(backtest_sql, "quotes"), "vcp_variants": duck_query(variants_sql, "quotes")}
