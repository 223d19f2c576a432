"""Validation of a model's replies against the batches that were sent: every item sent gets a verdict.

A reply is a JSON array of objects, also inside an object under one of a few names, or as
the values of an object. Of repeated ids the first counts. An item is scored, below the
limit, or rejected for its score; items without an object or with an id outside the batch
reject nothing that was sent, whose own verdict is then missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.adapters import NEWS, news, with_views

#: Least score that counts, highest score, score that a highlight needs, tags; characters of a title, a summary, a reason, and of a title cut from a summary.
LEAST, HIGHEST, BRIGHT, TAGS, TITLE, SUMMARY, REASON, CUT = 5, 10, 8, 5, 60, 200, 256, 30
#: Names under which an object may hold the array; texts that stand for true.
WRAPPERS, TRUE = ("results", "data", "items", "news"), ("true", "1", "yes")
HAN = "[一-鿿]"
BATCH = 10


def _kind(v: Column, path: str) -> Column:
    """Name of the type of a field: STRING, BIGINT, DECIMAL(2,1), BOOLEAN, ARRAY<...>, OBJECT<...>, VOID; null where it is missing."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _text(v: Column, path: str) -> Column:
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def items(replies: DataFrame) -> DataFrame:
    """(batch_id, at, item) of replies (batch_id, reply): the elements of the arrays, in order; a reply without an array has none."""
    whole = F.try_parse_json(F.concat(F.lit("["), "reply", F.lit("]")))  # the parser stops at the end of a first value; in brackets what follows it shows
    v = F.when(F.try_variant_get("whole", "$[1]", "variant").isNull(), F.try_variant_get("whole", "$[0]", "variant"))
    parsed = replies.withColumn("whole", whole).withColumn("v", v).withColumn("kind", F.schema_of_variant("v"))
    found = F.when(F.startswith("kind", F.lit("ARRAY")), F.col("v").cast("array<variant>"))
    for name in WRAPPERS:
        found = found.when(F.startswith(_kind(F.col("v"), f"$.{name}"), F.lit("ARRAY")), F.try_variant_get("v", f"$.{name}", "array<variant>"))
    values = F.map_values(F.try_variant_get("v", "$", "map<string,variant>"))
    nested = F.forall(values, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))
    found = found.when(F.startswith("kind", F.lit("OBJECT")) & nested, values)
    return parsed.select("batch_id", F.posexplode(found).alias("at", "item"))


def validate(sent: DataFrame, replies: DataFrame, least: int = LEAST, chinese: bool = True) -> DataFrame:
    """(batch_id, id, verdict, score, is_highlight, tags, title, summary, why, n_given) of every item of ``sent`` (batch_id, id: from 1 on).

    ``n_given``: how often the reply named the id. With ``chinese`` titles and summaries
    must hold a Chinese character, and a missing title is cut from the summary.
    """
    sizes = sent.groupBy("batch_id").agg(F.max("id").alias("size"))
    v = F.col("item")
    kind = _kind(v, "$.id")
    given = F.when(kind == "BIGINT", F.try_variant_get(v, "$.id", "bigint")).when(kind == "STRING", F.try_variant_get(v, "$.id", "string").try_cast("bigint"))
    named = items(replies).join(sizes, "batch_id").where(F.startswith(F.schema_of_variant("item"), F.lit("OBJECT"))).withColumn("id", given).where("id BETWEEN 1 AND size")
    first = named.groupBy("batch_id", "id").agg(F.min_by("item", "at").alias("item"), F.count("*").alias("n_given"))
    score_kind = _kind(v, "$.score")
    number = F.when(score_kind == "STRING", F.try_variant_get(v, "$.score", "string").try_cast("bigint")).when(score_kind == "BIGINT", F.try_variant_get(v, "$.score", "bigint"))
    number = number.when(score_kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$.score", "double").cast("bigint")).when(score_kind.isNull(), 0)
    bright_kind = _kind(v, "$.is_highlight")
    bright = F.when(bright_kind == "BOOLEAN", F.try_variant_get(v, "$.is_highlight", "boolean")).when(bright_kind == "STRING", F.lower(F.trim(F.try_variant_get(v, "$.is_highlight", "string"))).isin(*TRUE)).otherwise(F.lit(False))
    tags = F.filter(F.transform(F.when(F.startswith(_kind(v, "$.tags"), F.lit("ARRAY")), F.try_variant_get(v, "$.tags", "array<variant>")), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.trim(x.try_cast("string")))), lambda x: x.isNotNull() & (x != ""))
    cut = lambda path, n: F.substring(F.coalesce(_text(v, path), F.lit("")), 1, n)
    title, summary = (cut("$.chinese_title", TITLE), cut("$.chinese_summary", SUMMARY)) if chinese else (F.lit(""), cut("$.summary", SUMMARY))
    read = first.select("batch_id", "id", "n_given", number.alias("score"), bright.alias("bright"), tags.alias("tags"), title.alias("title"), summary.alias("summary"), cut("$.why_it_matters", REASON).alias("why"))
    if chinese:
        read = read.withColumns({c: F.when(F.col(c).rlike(HAN), F.col(c)).otherwise("") for c in ("title", "summary")})
        read = read.withColumn("title", F.when((F.col("title") == "") & (F.col("summary") != ""), F.regexp_replace(F.substring("summary", 1, CUT), "[，。、；：]+$", "")).otherwise(F.col("title")))
    verdict = F.when(F.col("n_given").isNull(), "missing").when(F.col("score").isNull(), "score").when(F.col("score") < least, "below").otherwise("scored")
    told = sent.select("batch_id", "id").join(read, ["batch_id", "id"], "left").withColumn("verdict", verdict)
    kept = lambda x: F.when(F.col("verdict") == "scored", x)
    return told.select(
        "batch_id",
        "id",
        "verdict",
        kept(F.least("score", F.lit(HIGHEST))).alias("score"),
        kept(F.col("bright") & (F.col("score") >= BRIGHT)).alias("is_highlight"),
        kept(F.coalesce(F.array_join(F.slice("tags", 1, TAGS), ","), F.lit(""))).alias("tags"),
        kept(F.col("title")).alias("title"),
        kept(F.col("summary")).alias("summary"),
        kept(F.col("why")).alias("why"),
        F.coalesce("n_given", F.lit(0)).alias("n_given"),
    )


def batches(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batches of ``BATCH`` articles with a reply made for each: some items lack an id in range, a whole score or their place, some come twice, some replies are wrapped or broken."""
    own = articles.select((F.floor(F.col("id") / BATCH)).alias("batch_id"), (F.col("id") % BATCH + 1).alias("id"), F.col("id").alias("n"), "ai_score")
    said = F.when(F.col("n") % 11 == 3, F.lit("7")).otherwise(F.concat(F.lit('{"id": '), F.when(F.col("n") % 13 == 5, F.lit("99")).when(F.col("n") % 7 == 2, F.concat(F.lit('"'), "id", F.lit('"'))).otherwise(F.col("id").cast("string")), F.lit(', "score": '),
        F.when(F.col("n") % 17 == 4, F.lit('"high"')).when(F.col("n") % 5 == 1, F.concat(F.lit('"'), F.floor("ai_score").cast("string"), F.lit('"'))).otherwise(F.col("ai_score").cast("decimal(4,1)").cast("string")),
        F.lit(', "is_highlight": '), F.when(F.col("n") % 3 == 0, F.lit('" True "')).otherwise(F.lit("true")), F.lit(', "tags": ["a", 3, " b "], "chinese_title": "'), F.when(F.col("n") % 4 == 0, F.lit("plain")).otherwise(F.lit("利率")), F.lit('", "chinese_summary": "央行降息。", "why_it_matters": 5}')))
    twice = F.when(F.col("n") % 19 == 6, F.concat(said, F.lit(", "), F.replace(said, F.lit('"a"'), F.lit('"z"')))).otherwise(said)
    listed = own.select("batch_id", "id", twice.alias("said")).groupBy("batch_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "said"))), lambda x: x["said"]), ", ").alias("all"))
    whole = F.concat(F.lit("["), "all", F.lit("]"))
    reply = F.when(F.col("batch_id") % 6 == 1, F.concat(F.lit('{"items": '), whole, F.lit("}"))).when(F.col("batch_id") % 9 == 2, F.concat(whole, F.lit(" and more"))).otherwise(whole)
    return own.select("batch_id", "id"), listed.select("batch_id", reply.alias("reply"))


QUERIES = {"reply_validation": lambda s, d: validate(*batches(news(s, d)))}

ORACLES = {
    "reply_validation": with_views(
        NEWS,
        sql=f""",
own AS (SELECT id // {BATCH} AS batch_id, id % {BATCH} + 1 AS id, id AS n, ai_score FROM news),
s AS (SELECT *, CASE WHEN n % 11 = 3 THEN '7' ELSE '{{"id": ' || CASE WHEN n % 13 = 5 THEN '99' WHEN n % 7 = 2 THEN '"' || id || '"' ELSE CAST(id AS VARCHAR) END || ', "score": ' ||
  CASE WHEN n % 17 = 4 THEN '"high"' WHEN n % 5 = 1 THEN '"' || CAST(floor(ai_score) AS BIGINT) || '"' ELSE CAST(CAST(ai_score AS DECIMAL(4,1)) AS VARCHAR) END || ', "is_highlight": ' || CASE WHEN n % 3 = 0 THEN '" True "' ELSE 'true' END ||
  ', "tags": ["a", 3, " b "], "chinese_title": "' || CASE WHEN n % 4 = 0 THEN 'plain' ELSE '利率' END || '", "chinese_summary": "央行降息。", "why_it_matters": 5}}' END AS said FROM own),
b AS (SELECT batch_id, '[' || string_agg(CASE WHEN n % 19 = 6 THEN said || ', ' || replace(said, '"a"', '"z"') ELSE said END, ', ' ORDER BY id) || ']' AS whole FROM s GROUP BY batch_id),
r AS (SELECT batch_id, CASE WHEN batch_id % 6 = 1 THEN '{{"items": ' || whole || '}}' WHEN batch_id % 9 = 2 THEN whole || ' and more' ELSE whole END AS reply FROM b),
a AS (SELECT batch_id, CASE WHEN json_type(reply) = 'ARRAY' THEN json_extract(reply, '$[*]') ELSE json_extract(reply, '$.items[*]') END AS l FROM r WHERE json_valid(reply)),
e AS (SELECT batch_id, unnest(l) AS item, generate_subscripts(l, 1) AS spot FROM a),
i AS (SELECT *, TRY_CAST(json_extract_string(item, '$.id') AS BIGINT) AS id FROM e WHERE json_type(item) = 'OBJECT'),
f AS (SELECT batch_id, id, arg_min(item, spot) AS item, count(*) AS n_given FROM i JOIN (SELECT batch_id, max(id) AS size FROM own GROUP BY batch_id) USING (batch_id) WHERE id BETWEEN 1 AND size GROUP BY batch_id, id),
v AS (SELECT *, CASE WHEN json_type(item, '$.score') = 'VARCHAR' THEN TRY_CAST(json_extract_string(item, '$.score') AS BIGINT) ELSE CAST(floor(CAST(json_extract_string(item, '$.score') AS DOUBLE)) AS BIGINT) END AS score,
  lower(trim(json_extract_string(item, '$.is_highlight'))) = 'true' AS bright, json_extract_string(item, '$.tags[0]') || ',b' AS tags, json_extract_string(item, '$.chinese_title') AS title FROM f),
t AS (SELECT own.batch_id, own.id, v.*EXCLUDE (batch_id, id), CASE WHEN n_given IS NULL THEN 'missing' WHEN score IS NULL THEN 'score' WHEN score < {LEAST} THEN 'below' ELSE 'scored' END AS verdict FROM own LEFT JOIN v ON v.batch_id = own.batch_id AND v.id = own.id)
SELECT batch_id, id, verdict, CASE WHEN verdict = 'scored' THEN least(score, 10) END AS score, CASE WHEN verdict = 'scored' THEN bright AND score >= 8 END AS is_highlight, CASE WHEN verdict = 'scored' THEN tags END AS tags,
  CASE WHEN verdict = 'scored' THEN CASE WHEN title = 'plain' THEN '央行降息' ELSE title END END AS title, CASE WHEN verdict = 'scored' THEN '央行降息。' END AS summary, CASE WHEN verdict = 'scored' THEN '' END AS why, coalesce(n_given, 0) AS n_given FROM t""",
    )
}
