"""Digests over the news, one after the other, with their DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import digest_runs as ops
from marlstone.session import fresh_folder
from marlstone.sources.adapters import NEWS, news, with_views

START, PERIOD, RUNS, EVERY = 1704067200, 14400, 4, 1_000_000


def rolling_digests(spark: SparkSession, sf_dir: str, runs: int = RUNS) -> DataFrame:
    """(digest, event_id, version, section) of so many digests, four hours each, each knowing what the one before told."""
    articles, folder = news(spark, sf_dir), fresh_folder(spark, "digests")
    for k in range(1, runs + 1):
        ops.run(articles, folder, START + k * PERIOD, START, EVERY)
    return ops.links(spark, folder).select(((F.col(ops.END) - START) / PERIOD).cast("long").alias("digest"), "event_id", "version", "section")


QUERIES = {"rolling_digests": rolling_digests}

ORACLES = {
    "rolling_digests": with_views(
        NEWS,
        sql=f""",
r AS (SELECT *, coalesce(related_to_id, id) AS root FROM news), k AS (SELECT CAST(unnest(range(1, {RUNS + 1})) AS BIGINT) AS k),
e AS (SELECT k, root, count(DISTINCT source) AS version, max(ai_score) AS score, bool_or(id = root AND status = 'resolved') AS resolved, count(*) FILTER (WHERE published >= {START} + (k - 1) * {PERIOD}) AS n
  FROM r JOIN k ON published < {START} + k * {PERIOD} GROUP BY k, root),
w AS (SELECT k, root, version, score, resolved, n > 0 AS kept FROM e WHERE k = 1 UNION ALL
  SELECT e.k, e.root, e.version, e.score, e.resolved, e.n > 0 AND (NOT coalesce(w.kept, false) OR e.version > w.version OR coalesce(e.resolved, false)) AS kept FROM w JOIN e ON e.k = w.k + 1 AND e.root = w.root),
f AS (SELECT * FROM w UNION ALL SELECT k, root, version, score, resolved, n > 0 FROM e WHERE FALSE),
late AS (SELECT e.root, min(e.k) AS k FROM e GROUP BY e.root HAVING min(e.k) > 1),
v AS (SELECT e.k, e.root, e.version, e.score, e.resolved, e.n > 0 AS kept FROM e JOIN late ON late.root = e.root AND late.k = e.k UNION ALL
  SELECT e.k, e.root, e.version, e.score, e.resolved, e.n > 0 AND (NOT v.kept OR e.version > v.version OR coalesce(e.resolved, false)) AS kept FROM v JOIN e ON e.k = v.k + 1 AND e.root = v.root)
SELECT k AS digest, root AS event_id, version, CASE WHEN score >= {ops.MUST} THEN 'must_know' ELSE 'worth_watching' END AS section FROM (SELECT * FROM f UNION ALL SELECT * FROM v) AS x WHERE kept""",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
}
