"""Search over the news with a table of queries, with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import search as ops
from marlstone.plans.news import HOT_NOW
from marlstone.sources.adapters import NEWS, news, with_views

#: Queries are the first words of the titles of articles whose id is divisible by this, the topic of those by twice as much, and a part of the first word by thrice.
EVERY = 50


def asked(articles: DataFrame) -> DataFrame:
    """(query_id, query)."""
    mine = articles.where(F.col("id") % EVERY == 0)
    first = F.array_join(F.slice(F.split("title", " "), 1, 2), " ")
    query = F.when(F.col("id") % (2 * EVERY) == 0, F.element_at("tags", 3)).when(F.col("id") % (3 * EVERY) == 0, F.substring("title", 2, 4)).otherwise(first)
    return mine.select(F.col("id").alias("query_id"), query.alias("query"))


def search_news(spark: SparkSession, sf_dir: str, queries: DataFrame | None = None, now: int = HOT_NOW, min_score: float = 4, limit: int = 20, offset: int = 0) -> DataFrame:
    """The best articles for each of ``queries`` (query_id, query)."""
    articles = news(spark, sf_dir)
    return ops.search(articles, asked(articles) if queries is None else queries, now, min_score=min_score, limit=limit, offset=offset)


QUERIES = {"search_news": search_news}

ORACLES = {
    "search_news": with_views(
        NEWS,
        sql=rf""",
raw AS (SELECT id AS query_id, CASE WHEN id % {2 * EVERY} = 0 THEN tags[3] WHEN id % {3 * EVERY} = 0 THEN substr(title, 2, 4) ELSE array_to_string(string_split(title, ' ')[1:2], ' ') END AS query FROM news WHERE id % {EVERY} = 0),
ask AS (SELECT query_id, substr(trim(regexp_replace(regexp_replace(trim(query), '[^\p{{L}}\p{{N}}_\s\-.]', '', 'g'), '\s+', ' ', 'g')), 1, 200) AS query FROM raw),
lst AS (SELECT *, list_distinct(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}]+')) AS terms FROM ask WHERE length(query) > 0),
q AS (SELECT * FROM lst WHERE len(terms) > 0), t AS (SELECT query_id, unnest(terms) AS term, len(terms) AS n_terms FROM q),
w AS (SELECT id, regexp_extract_all(lower(coalesce(title, '')), '[\p{{L}}\p{{N}}]+') AS a, regexp_extract_all(lower(coalesce(content, '')), '[\p{{L}}\p{{N}}]+') AS b FROM news),
p AS (SELECT id, unnest(a) AS term, generate_subscripts(a, 1) AS pos, 1.0e0 AS weight FROM w UNION ALL SELECT id, unnest(b), generate_subscripts(b, 1) + len(a), 0.4e0 FROM w),
h AS (SELECT query_id, n_terms, p.* FROM p JOIN t ON t.term = p.term), full_ AS (SELECT query_id, id FROM h GROUP BY query_id, id, n_terms HAVING count(DISTINCT term) = n_terms),
e AS (SELECT h.*, row_number() OVER o AS n, sum(1 / weight) OVER o AS inv FROM h JOIN full_ USING (query_id, id) WINDOW o AS (PARTITION BY query_id, id ORDER BY pos)),
l AS (SELECT e.query_id, e.id, e.n, e.n_terms, max(CASE WHEN e.term = t.term THEN e.n END) OVER (PARTITION BY e.query_id, e.id, t.term ORDER BY e.n) AS last FROM e JOIN t ON t.query_id = e.query_id),
z AS (SELECT query_id, id, n, min(last) AS start FROM l GROUP BY query_id, id, n, n_terms HAVING count(last) = n_terms), c AS (SELECT query_id, id, start, min(n) AS n FROM z GROUP BY ALL),
r AS (SELECT query_id, id, sum(((y.n - x.n + 1) / (y.inv - x.inv + 1 / x.weight)) / (1 + (y.pos - x.pos) - (y.n - x.n))) AS s FROM c JOIN e x USING (query_id, id) JOIN e y USING (query_id, id) WHERE x.n = c.start AND y.n = c.n GROUP BY ALL),
f AS (SELECT query_id, id FROM r UNION SELECT query_id, id FROM q JOIN news ON contains(lower(coalesce(title, '')), lower(query)) OR contains(lower(coalesce(content, '')), lower(query)) UNION SELECT query_id, id FROM lst JOIN news ON list_contains(tags, query)),
s AS (SELECT f.query_id, f.id, title, coalesce(r.s / (1 + r.s), 0.1e0) AS relevance, ai_score, published FROM f JOIN news ON news.id = f.id LEFT JOIN r ON r.query_id = f.query_id AND r.id = f.id WHERE coalesce(ai_score, 0) >= 4),
v AS (SELECT *, round(relevance * ln(greatest(ai_score, 0) + 1) / sqrt(greatest(({HOT_NOW} - published) / 3600.0e0, 0e0) + 2), 8) AS score, count(*) OVER (PARTITION BY query_id) AS n_found FROM s),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM v)
SELECT g.query_id, place, g.id, score, round(relevance, 8) AS relevance, n_found,
  array_to_string(list_transform(regexp_extract_all(title, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+'), lambda x: CASE WHEN list_contains(q.terms, lower(x)) THEN '<mark>' || x || '</mark>' ELSE x END), '') AS marked
FROM g JOIN q ON q.query_id = g.query_id WHERE place <= 20""",
    )
}
