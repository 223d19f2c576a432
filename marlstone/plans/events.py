"""Events out of articles: the last root with a title above each article, counts of an event, and events that are due again since they grew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import features as fx
from marlstone.plans.dialect import DuckSql, both, duck_query, run_text
from marlstone.session import settle, stored
from marlstone.sources import adapters

#: Least score from which on a root has an event of its own, given a title.
TITLED = 2
#: Links between articles with links between roots, as older rows hold them.
LINKS = "SELECT id, title, source, coalesce(related_to_id, CASE WHEN id % 10 = 5 THEN id - 5 WHEN id % 50 IN (10, 20) THEN id - 10 END) AS related_to_id, ai_score FROM news"
ROOT = f"related_to_id IS NULL AND trim(coalesce(title, '')) != '' AND ai_score >= {TITLED}"


def last_ancestors(links: DataFrame) -> DataFrame:
    """(id, root) for each row of (id, parent) with a parent: the last ancestor, which may itself be missing from ``links``.

    Each round doubles the length of the steps, so a chain of n links takes log2(n)
    rounds of one join. Rows that lead into a cycle are open after as many rounds as
    the longest possible chain takes, and are left out.
    """
    steps = settle(links.where("parent is not null").select("id", F.col("parent").alias("root")))
    rounds = max(steps.count(), 1).bit_length() + 1
    for _ in range(rounds):
        ahead = steps.select(F.col("id").alias("root"), F.col("root").alias("far"))
        steps = stored(steps.join(ahead, "root", "left").select("id", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("open")))
        if steps.where("open").isEmpty():
            break
        done = steps.select("id", "root")
        steps, ended = done, steps.where("not open").select("id", "root")
    else:
        return ended
    return steps.select("id", "root")


def roots_within(links: DataFrame, most: int = 10) -> DataFrame:
    """(id, root, depth) of (id, parent): where up to ``most`` steps up lead; a step ends at a row whose parent is null, missing or itself.

    Steps of one, two, four ... links are put together, so ten links take five joins, each over a row an id.
    """
    up = links.distinct()
    known = up.select(F.col("id").alias("parent"), F.lit(1).alias("depth")).where("parent is not null")
    moved = F.col("depth").isNotNull() & (F.col("parent") != F.col("id"))
    step = settle(up.join(known, "parent", "left").select("id", F.when(moved, F.col("parent")).otherwise(F.col("id")).alias("root"), F.when(moved, 1).otherwise(0).alias("depth")))

    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        on = second.where("id is not null").select(F.col("id").alias("root"), F.col("root").alias("far"), F.col("depth").alias("further"))
        return settle(first.join(on, "root", "left").select("id", F.coalesce("far", "root").alias("root"), (F.col("depth") + F.coalesce("further", F.lit(0))).alias("depth")))

    done = None
    while most:
        if most & 1:
            done = step if done is None else then(done, step)
        most >>= 1
        step = then(step, step) if most else step
    return done


def event_ids(articles: DataFrame) -> DataFrame:
    """(id, event_id) of (id, title, related_to_id, ai_score): a root with a title is its own event, others take that of their last ancestor; null where that has no title, is missing or is on a cycle."""
    roots = articles.where(ROOT).select(F.col("id").alias("root"))
    above = last_ancestors(articles.select("id", F.col("related_to_id").alias("parent"))).join(roots, "root", "left_semi")
    found = roots.select(F.col("root").alias("id"), "root").unionByName(above.select("id", "root"))
    return articles.select("id").join(found.withColumnRenamed("root", "event_id"), "id", "left")


def event_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_ids(run_text(spark, lambda d: LINKS, news=adapters.news(spark, sf_dir)))


ROOTS_SQL = f"""WITH RECURSIVE a AS ({LINKS}), up AS (SELECT id, related_to_id AS parent FROM a WHERE related_to_id IS NOT NULL UNION ALL SELECT up.id, a.related_to_id FROM up JOIN a ON a.id = up.parent WHERE a.related_to_id IS NOT NULL),
q AS (SELECT id FROM a WHERE {ROOT})
SELECT a.id, coalesce(own.id, max(top.id)) AS event_id FROM a LEFT JOIN q AS own ON own.id = a.id LEFT JOIN up ON up.id = a.id LEFT JOIN q AS top ON top.id = up.parent GROUP BY a.id, own.id"""


def event_counts(d) -> str:
    """Each root with a title as an event: its articles (itself and those directly below it) and their distinct sources."""
    return f"""WITH a AS ({LINKS}), q AS (SELECT id, title FROM a WHERE {ROOT}),
m AS (SELECT id AS event_id, source FROM a UNION ALL SELECT related_to_id AS event_id, source FROM a WHERE related_to_id IS NOT NULL)
SELECT q.id AS event_id, q.title, count(*) AS article_count, count(DISTINCT m.source) AS source_count FROM q JOIN m ON m.event_id = q.id GROUP BY q.id, q.title"""


#: The events known at a run: counts of what was there when the one before ended.
STORED = f"stored AS (SELECT coalesce(related_to_id, id) AS event_id, count(*) AS article_count FROM news WHERE published < {{cutoff}} GROUP BY coalesce(related_to_id, id))"


def due(d, now: int | str, hours: int, least_sources: int, fast_score: float, most: int) -> str:
    """Events with a new article in the window that have more articles than when they were last written (or never were), if enough of them or one that needs no second source: a highlight, a high score or an official source. Most articles first, then the best score."""
    cutoff = f"{now} - {hours * 3600}"
    return f"""fresh AS (SELECT DISTINCT related_to_id AS pid FROM news WHERE related_to_id IS NOT NULL AND published >= {cutoff} AND published <= {now}),
agg AS (SELECT related_to_id AS pid, count(*) AS children FROM news WHERE related_to_id IS NOT NULL AND published <= {now} GROUP BY related_to_id),
src AS (SELECT pid, count(DISTINCT source) AS sources FROM (SELECT related_to_id AS pid, source FROM news WHERE related_to_id IS NOT NULL AND published <= {now} UNION ALL SELECT id AS pid, source FROM news WHERE published <= {now}) AS x GROUP BY pid),
g AS (SELECT p.id, p.title, p.ai_score, agg.children, src.sources, s.article_count AS told FROM news p JOIN fresh ON fresh.pid = p.id JOIN agg ON agg.pid = p.id JOIN src ON src.pid = p.id LEFT JOIN stored s ON s.event_id = p.id
  WHERE p.related_to_id IS NULL AND (s.article_count IS NULL OR agg.children + 1 > s.article_count) AND (agg.children + 1 >= {least_sources} OR p.is_highlight OR p.ai_score >= {fast_score} OR {fx.official(d, "p.source", "''")}))
SELECT id AS event_id, title, children + 1 AS article_count, sources AS source_count, told FROM g ORDER BY children DESC, ai_score DESC, id LIMIT {most}"""


def due_again(spark: SparkSession, news: DataFrame, stored: DataFrame, now: int, hours: int = 4, least_sources: int = 2, fast_score: float = 8.0, most: int = 20) -> DataFrame:
    """``due`` against a table of stored counts (event_id, article_count); its rows (event_id, article_count) are what to store once they are written."""
    return run_text(spark, lambda d: "WITH " + due(d, now, hours, least_sources, fast_score, most), news=news, stored=stored)


def event_retrigger(d, now: int | str = "(SELECT max(published) FROM news)", hours: int = 4, least_sources: int = 2, fast_score: float = 8.0, most: int = 20) -> str:
    return f"WITH {STORED.format(cutoff=f"{now} - {hours * 3600}")}, {due(d, now, hours, least_sources, fast_score, most)}"


QUERIES, ORACLES = both({"event_counts": (event_counts, "news"), "event_retrigger": (event_retrigger, "news")})
QUERIES["event_roots"] = event_roots
ORACLES["event_roots"] = duck_query(lambda d: ROOTS_SQL if isinstance(d, DuckSql) else "", "news")
