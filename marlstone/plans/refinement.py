"""Lanes of news refinement, the fundamentals filter and the recovery of JSON replies, written once for both engines.

Fingerprints, term weights and vectors give pairs of an older and a newer article;
``operators.dedup`` settles which articles stay.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from marlstone.operators import dedup, pairs
from marlstone.operators import fingerprints as faces
from marlstone.plans.dialect import both, run_text, spark_query
from marlstone.session import settle
from marlstone.sources import adapters

#: Bits that near fingerprints may differ in, days of history; least cosine of term weights, terms a batch, seconds a batch.
FAR, HISTORY, TERM_COSINE, MOST_TERMS, BATCH = 5, 8, 0.65, 5000, 14400
#: Fixed values of the short lane: cosines of a copy, of the grey zone and of one event; minutes of history.
COPY, GREY, EVENT, MINUTES = 0.80, 0.73, 0.67, 90
#: Fixed value: titles of short articles without vectors are alike from this ratio on.
FALLBACK = 0.6
# A number with its unit, and dates, whose numbers do not count.
NUMBERS = r"[0-9]+(?:\.[0-9]+)?(?:%|万户|亿[美元人民币欧元日元英镑]*|万亿|万|个基点|bps|bp)?"
DATES = r"[0-9]{4}年|[0-9]{1,2}月[0-9]{1,2}日|[0-9]{1,2}月|[0-9]{1,2}日"
START = 1704067200


def masks() -> list[tuple[int, int]]:
    """Pairs of seven blocks of a fingerprint, as masks of its halves: of fingerprints with up to five other bits, two blocks at least are equal."""
    edges = [64 * i // 7 for i in range(8)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [((a | b) >> 32, (a | b) & 0xFFFFFFFF) for a, b in combinations(blocks, 2)]


def tokens(d, x: str) -> str:
    return d.filter(d.every(f"lower({x})", r"[\p{L}\p{N}]+"), "y", "length(y) > 1")


WEIGHTED = "title || ' ' || title || ' ' || title || ' ' || substring(content, 1, 200)"
TEXTS = "x AS (SELECT id, source, published, coalesce(title, '') AS title, coalesce(content, '') AS content FROM news)"


def fingerprints(d) -> str:
    """CTEs up to f(id, published, hi, lo): 64 bits in two halves, each bit by the vote of all tokens; articles without tokens have none."""
    return f"""{TEXTS}, w AS (SELECT id, published, {tokens(d, WEIGHTED)} AS ts FROM x),
f AS (SELECT id, published, {d.vote("ts", 1)} AS hi, {d.vote("ts", 9)} AS lo FROM w WHERE {d.size("ts")} > 0)"""


def article_faces(spark, articles):
    """``fingerprints`` of the news ``articles``, which may be a stream; tokens are told by Spark, their votes added up by arrays."""
    return faces.faces(run_text(spark, lambda d: f"WITH {TEXTS} SELECT id, published, {tokens(d, WEIGHTED)} AS ts FROM x", news=articles))


def fingerprint_pairs(d) -> str:
    """CTEs up to p(older, newer, distance) between classes of equal fingerprints of one day, each named by its first article c(hi, lo, day, id)."""
    return f"{fingerprints(d)},\n{near_faces(d)}"


def near_faces(d) -> str:
    """From f(id, published, hi, lo): CTEs up to p, as ``fingerprint_pairs`` has them."""
    keys = masks()
    pick = lambda side: "CASE m " + " ".join(f"WHEN {i} THEN {k[side]}" for i, k in enumerate(keys)) + " END"
    far = d.bits(d.xor("a.hi", "b.hi")) + " + " + d.bits(d.xor("a.lo", "b.lo"))
    return f"""c AS (SELECT hi, lo, CAST(floor((published - {START}) / 86400) AS BIGINT) AS day, min(id) AS id FROM f GROUP BY hi, lo, CAST(floor((published - {START}) / 86400) AS BIGINT)),
m AS (SELECT *, CAST(floor(day / {HISTORY + 1}) AS BIGINT) AS slot, {d.unnest(d.array(*map(str, range(len(keys)))))} AS m FROM c),
k AS (SELECT *, hi & {pick(0)} AS kh, lo & {pick(1)} AS kl FROM m),
o AS (SELECT *, {d.unnest(d.array("slot", "slot + 1"))} AS near FROM k),
p AS (SELECT DISTINCT a.id AS older, b.id AS newer, CAST({far} AS INT) AS distance FROM o a JOIN k b ON a.near = b.slot AND a.m = b.m AND a.kh = b.kh AND a.kl = b.kl AND b.day - a.day <= {HISTORY} AND a.id < b.id AND a.day <= b.day WHERE {far} <= {FAR})"""


def titles(d) -> str:
    """CTEs up to n(id, published, t): cleaned titles of all articles."""
    clean = d.sub(d.sub("title", r"[【\[][^\]】]*[】\]]", ""), r"[，。！？、；：“”‘’（）\s.,!?;:\"'()\-　]", "")
    return f"{TEXTS}, n AS (SELECT id, published, lower({clean}) AS t FROM x)"


def title_classes(d) -> str:
    """CTEs up to c(t, slot, id, first): classes of equal cleaned titles of a two-hour slot."""
    return f"""{titles(d)},
c AS (SELECT t, CAST(floor(published / 7200) AS BIGINT) AS slot, min(id) AS id, min(published) AS first FROM n WHERE length(t) > 0 GROUP BY t, CAST(floor(published / 7200) AS BIGINT))"""


def title_candidates(d) -> str:
    """Pairs of classes of equal titles within two hours that may be alike by length: (older, newer, a, b, within)."""
    return f"""WITH {title_classes(d)},
o AS (SELECT *, {d.unnest(d.array("slot", "slot + 1"))} AS near FROM c),
u AS (SELECT a.id AS older, b.id AS newer, a.t AS a, b.t AS b, contains(a.t, b.t) OR contains(b.t, a.t) AS within FROM o a JOIN c b ON a.near = b.slot AND a.first <= b.first AND b.first - a.first <= 7200 AND a.id < b.id)
SELECT older, newer, a, b, within FROM u WHERE within OR 4 * least(length(a), length(b)) > length(a) + length(b)"""


def term_pairs(d) -> str:
    """Articles of a batch whose term weights have a cosine above the limit.

    Only pairs that share one of their rarest terms, up to where the rest of a
    vector is too short to reach the limit, are compared: no pair above it is lost.
    """
    return f"""WITH {TEXTS}, s AS (SELECT id, CAST(floor((published - {START}) / {BATCH}) AS BIGINT) AS slot, {tokens(d, WEIGHTED)} AS ts FROM x),
n AS (SELECT slot, count(*) AS n FROM s GROUP BY slot), e AS (SELECT id, slot, {d.unnest("ts")} AS term FROM s),
t AS (SELECT id, slot, term, count(*) AS tf FROM e GROUP BY id, slot, term),
v AS (SELECT slot, term, count(*) AS df, row_number() OVER (PARTITION BY slot ORDER BY sum(tf) DESC, term) AS rn FROM t GROUP BY slot, term),
w AS (SELECT t.id, t.slot, t.term, df, tf * (ln((1e0 + n.n) / (1e0 + df)) + 1e0) AS w FROM t JOIN v ON v.slot = t.slot AND v.term = t.term JOIN n ON n.slot = t.slot WHERE v.rn <= {MOST_TERMS}),
u AS (SELECT id, slot, term, df, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w),
r AS (SELECT *, sum(w * w) OVER (PARTITION BY id ORDER BY df DESC, term DESC ROWS UNBOUNDED PRECEDING) AS rest FROM u),
i AS (SELECT id, slot, term FROM r WHERE rest >= {TERM_COSINE**2 - 1e-9}),
c AS (SELECT DISTINCT a.id AS older, b.id AS newer FROM i a JOIN i b ON a.slot = b.slot AND a.term = b.term AND a.id < b.id),
g AS (SELECT older, newer, sum(a.w * b.w) AS cosine FROM c JOIN u a ON a.id = c.older JOIN u b ON b.id = c.newer AND b.term = a.term GROUP BY older, newer)
SELECT older, newer, round(cosine, 6) AS cosine FROM g WHERE cosine > {TERM_COSINE}"""


def numbered(d) -> str:
    """CTEs up to v(id, source, nums): numbers with a unit, or above 100, of the articles that have a vector; dates do not count."""
    numbers = d.filter(d.every(d.sub("title || ' ' || substring(content, 1, 200)", DATES, ""), NUMBERS), "y", f"CASE WHEN {d.rx('y', '[0-9]$')} THEN CAST(y AS DOUBLE) > 100 ELSE TRUE END")
    return f"{TEXTS}, v AS (SELECT y.id, source, CAST(floor(y.id / {MINUTES}) AS BIGINT) AS slot, embedding AS e, {d.distinct(numbers)} AS nums FROM vectors y JOIN x ON x.id = y.id)"


ACTION = f"CASE WHEN same AND (cosine > {COPY} OR cosine > {GREY} AND alike) THEN 'drop' ELSE 'link' END AS action"


def short_pairs(d) -> str:
    """What a newer article does about an older one by the cosine of their vectors: dropped as a copy of its source, or linked; numbers that differ keep it. Vectors come one a minute. Every pair of 90 minutes is compared here; ``short_lane_pairs`` finds the same by signatures."""
    size = lambda x: f"sqrt({d.dot(x, x)})"
    return f"""WITH {numbered(d)}, w AS (SELECT *, {size("e")} AS size FROM v),
o AS (SELECT *, {d.unnest(d.array("slot", "slot + 1"))} AS near FROM w),
c AS (SELECT a.id AS older, b.id AS newer, a.source = b.source AS same, CASE WHEN a.size * b.size = 0 THEN 0e0 ELSE {d.dot("a.e", "b.e")} / (a.size * b.size) END AS cosine,
  {d.size("a.nums")} = 0 OR {d.size("b.nums")} = 0 OR a.nums = b.nums AS alike FROM o a JOIN w b ON a.near = b.slot AND a.id < b.id AND b.id - a.id <= {MINUTES})
SELECT older, newer, round(cosine, 6) AS cosine, {ACTION} FROM c WHERE cosine > {EVENT}"""


def short_lane_pairs(spark, sf_dir):
    """The pairs of ``short_pairs``, found by tables of signatures."""
    found = spark_query(lambda d: f"WITH {numbered(d)} SELECT id, source, e AS embedding, nums FROM v", "vectors", "news")(spark, sf_dir)
    return act_on_vectors(pairs.near_vectors(found.select("id", F.col("id").alias("at"), "embedding"), EVENT, MINUTES), found)


def act_on_vectors(near, articles):
    """(older, newer, cosine, action) of ``near`` (older, newer, cosine) by ``articles`` (id, source, nums)."""
    side = lambda name: articles.select(F.col("id").alias(name), F.col("source").alias(f"{name}_source"), F.col("nums").alias(f"{name}_nums"))
    told = near.join(side("older"), "older").join(side("newer"), "newer").withColumns({"same": F.expr("older_source = newer_source"), "alike": F.expr("size(older_nums) = 0 OR size(newer_nums) = 0 OR older_nums = newer_nums")})
    return told.select("older", "newer", F.round("cosine", 6).alias("cosine"), F.expr(ACTION.removesuffix(" AS action")).alias("action"))


def title_links(spark, sf_dir, ratio: float = dedup.RATIO):
    """(older, newer) of all articles within two hours whose titles are alike or equal."""
    articles = spark_query(lambda d: f"WITH {titles(d)} SELECT id, t, published AS first FROM n WHERE length(t) > 0", "news")(spark, sf_dir)
    return pairs.title_links(articles, ratio).select("older", "newer")


def short_fallback(spark, sf_dir):
    """(older, newer) of short articles that fall together without vectors: a title holds the other, or is like it beyond 0.6 while their numbers do not differ."""
    short = "length(t) > 0 AND length(title) + length(substring(content, 1, 200)) <= 150"
    titles = spark_query(lambda d: f"WITH {title_classes(d)}, a AS (SELECT n.id, n.t, n.published AS first, {d.distinct(d.filter(d.every(d.sub('title || chr(32) || substring(content, 1, 200)', DATES, ''), NUMBERS), 'y', 'CASE WHEN ' + d.rx('y', '[0-9]$') + ' THEN CAST(y AS DOUBLE) > 100 ELSE TRUE END'))} AS nums FROM n JOIN x ON x.id = n.id WHERE {short}) SELECT * FROM a", "news")(spark, sf_dir)
    links = pairs.title_links(titles.select("id", "t", "first"), FALLBACK, MINUTES * 60)
    side = lambda name: titles.select(F.col("id").alias(name), F.col("nums").alias(f"{name}_nums"))
    told = links.join(side("older"), "older").join(side("newer"), "newer")
    return told.where("held OR size(older_nums) = 0 OR size(newer_nums) = 0 OR older_nums = newer_nums").select("older", "newer")


def fundamentals(d) -> str:
    """Verdict on each series by its latest quarters: too much goodwill, losses on little revenue, or earnings without cash fail; a profit or steady revenue passes.

    Revenue is the amount of a quarter; the other figures, which the given tables lack, are made from codes.
    """
    return f"""WITH q AS (SELECT code, CAST(year(trade_date) * 4 + quarter(trade_date) AS BIGINT) AS q, CAST(sum(amount) AS DOUBLE) AS revenue FROM quotes GROUP BY code, CAST(year(trade_date) * 4 + quarter(trade_date) AS BIGINT)),
y AS (SELECT q.code, q.q, q.revenue, CASE WHEN p.revenue > 0 THEN (q.revenue / p.revenue - 1e0) * 100e0 END AS yoy, q.revenue * ((q.code * 3 + q.q) % 9 - 3) / 20e0 AS profit, row_number() OVER (PARTITION BY q.code ORDER BY q.q DESC) AS rn FROM q LEFT JOIN q p ON p.code = q.code AND p.q = q.q - 4),
l AS (SELECT code, max(CASE WHEN rn = 1 THEN revenue END) AS revenue, max(CASE WHEN rn = 1 THEN yoy END) AS yoy, max(CASE WHEN rn = 1 THEN profit END) AS p0, max(CASE WHEN rn = 2 THEN profit END) AS p1,
  CASE WHEN code % 8 != 0 THEN (code % 7 - 3) * 1e0 END AS deducted, (code % 5) * 1e1 AS goodwill, CASE WHEN code % 10 != 0 THEN 1e2 END AS assets, (code % 6 - 1) * 5e-1 AS eps, (code % 4 - 1) * 1e0 AS cash FROM y GROUP BY code),
r AS (SELECT *, CASE WHEN assets > 0 AND goodwill / assets >= {GOODWILL} THEN 'goodwill' WHEN p0 < 0 AND p1 < 0 AND revenue < {LEAST_REVENUE} THEN 'losses' WHEN eps > 0 AND cash < 0 AND cash / greatest(eps, 0.01e0) < {CASH} THEN 'cash'
  WHEN deducted > 0 OR yoy > {DECLINE} OR deducted IS NULL AND yoy IS NULL THEN NULL ELSE 'decline' END AS reason FROM l)
SELECT code, round(yoy, 4) AS yoy, reason IS NULL AS passed, reason FROM r"""


#: Fixed values of the fundamentals filter: share of goodwill, least revenue of a loss, least cash a unit of earnings, decline of revenue in per cent.
GOODWILL, LEAST_REVENUE, CASH, DECLINE = 0.30, 1e8, -0.5, -10.0


def json_recovery(d) -> str:
    """The JSON in a model's reply and how it was found: as it stands once thoughts, fences and filler are gone, after common errors are mended, or as the outermost brackets of the raw reply."""
    fence = "```(?:json)?\\s*\\n?((?s:.*?))\\n?\\s*```"
    raw = "CASE run_id % 7 WHEN 0 THEN props WHEN 1 THEN 'Here: ' || props || ' done' WHEN 2 THEN '<think>a {b} c</think>' || props WHEN 3 THEN '```json ' || props || ' ```' WHEN 4 THEN '[' || props || ', ]' WHEN 5 THEN replace(props, '}', ', \"x\": None,}') ELSE 'nothing [here' END"
    mend = "b"
    for pattern, by in ((r"""(^|[^"':])//[^\n]*""", d.ref), (r",\s*([}\]])", d.ref), (r"\bTrue\b", "true"), (r"\bFalse\b", "false"), (r"\bNone\b", "null")):
        mend = d.sub(mend, pattern, by)
    quotes = f"CASE WHEN contains(m, {d.lit(chr(39))}) AND NOT contains(m, '\"') THEN replace(m, {d.lit(chr(39))}, '\"') ELSE m END"
    return f"""WITH s AS (SELECT run_id, {raw} AS raw FROM runs), t AS (SELECT *, trim({d.sub("raw", "(?s)<think>.*?</think>", "")}) AS t FROM s),
f AS (SELECT *, CASE WHEN {d.rx("t", fence)} THEN trim({d.one("t", fence)}) ELSE t END AS f FROM t),
b AS (SELECT *, CASE WHEN {d.rx("f", "(?s)[\\[{].*[\\]}]")} THEN {d.one("f", "(?s)([\\[{].*[\\]}])")} ELSE f END AS b FROM f),
m AS (SELECT *, {mend} AS m FROM b), q AS (SELECT *, {quotes} AS q, {d.one("raw", "(?s)(\\[.*\\])")} AS k FROM m),
h AS (SELECT *, CASE WHEN {d.is_json("b")} THEN 'as is' WHEN {d.is_json("q")} THEN 'mended' WHEN {d.is_json("k")} THEN 'brackets' END AS how FROM q)
SELECT run_id, how, CASE how WHEN 'as is' THEN b WHEN 'mended' THEN q WHEN 'brackets' THEN k END AS json FROM h"""


PAIRS = "SELECT older, newer, distance FROM p"
CLASSES = f"SELECT f.id, c.id AS class_id FROM f JOIN c ON c.hi = f.hi AND c.lo = f.lo AND c.day = floor((f.published - {START}) / 86400)"

FOUND = {
    "simhash": (lambda d: f"WITH {fingerprints(d)} SELECT id, hi, lo FROM f", "news"),
    "simhash_pairs": (lambda d: f"WITH {fingerprint_pairs(d)} {PAIRS}", "news"),
    "simhash_classes": (lambda d: f"WITH {fingerprint_pairs(d)} {CLASSES}", "news"),
    "title_candidates": (title_candidates, "news"),
    "term_pairs": (term_pairs, "news"),
    "short_pairs": (short_pairs, "vectors", "news"),
    "fundamentals": (fundamentals, "quotes"),
    "json_recovery": (json_recovery, "runs"),
}
QUERIES, ORACLES = both(FOUND)


def simhash(spark, sf_dir):
    """(id, hi, lo) of the articles that have tokens."""
    return article_faces(spark, adapters.news(spark, sf_dir)).select("id", "hi", "lo")


def known_faces(spark, sf_dir):
    """(id, published, hi, lo), computed once."""
    return settle(article_faces(spark, adapters.news(spark, sf_dir)))


def simhash_pairs(spark, sf_dir, found=None):
    """(older, newer, distance) of classes of near fingerprints, of ``found`` where given."""
    return run_text(spark, lambda d: f"WITH f AS (SELECT * FROM faces), {near_faces(d)} {PAIRS}", faces=known_faces(spark, sf_dir) if found is None else found)


def simhash_classes(spark, sf_dir, found=None):
    """(id, class_id) of the articles that have a fingerprint, of ``found`` where given."""
    return run_text(spark, lambda d: f"WITH f AS (SELECT * FROM faces), {near_faces(d)} {CLASSES}", faces=known_faces(spark, sf_dir) if found is None else found)


def long_lane(spark, sf_dir):
    """(id, class_id, kept): an article goes if it is near an earlier one that stays, by fingerprint, title, terms or, from its own source, by vector."""
    found = known_faces(spark, sf_dir)
    links = simhash_pairs(spark, sf_dir, found).select("older", "newer").unionByName(title_links(spark, sf_dir))
    classes = simhash_classes(spark, sf_dir, found)
    copies = short_lane_pairs(spark, sf_dir).where("action = 'drop'")
    return dedup.long_lane(classes, links, QUERIES["term_pairs"](spark, sf_dir).select("older", "newer"), copies)


def short_lane(spark, sf_dir):
    """(id, kept, related_to): copies of a kept article of their source go, others name the first kept article of their event."""
    known = spark_query(lambda d: "SELECT y.id FROM vectors y JOIN news n ON n.id = y.id", "vectors", "news")
    return dedup.short_lane(known(spark, sf_dir), short_lane_pairs(spark, sf_dir))


QUERIES |= {"simhash": simhash, "simhash_pairs": simhash_pairs, "simhash_classes": simhash_classes, "title_links": title_links, "short_lane_pairs": short_lane_pairs, "short_fallback": short_fallback, "long_lane": long_lane, "short_lane": short_lane}
ORACLES["short_lane_pairs"] = ORACLES["short_pairs"]
