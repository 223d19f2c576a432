"""Line dedup: lines that several documents hold stay in the first of them only.

Lines are exploded with their positions and normalised: stripped of white space,
A-Z in lower case. Keys of ``least_chars`` code points or more are hashed to 128
bits of SHA-256; documents are counted per hash; where ``documents`` or more hold a
key, all but the smallest ``doc_id`` lose its lines. The positions that go are
gathered by document and the text is put together again from the stretches between
them, so that no text leaves its row before that last join. Everything is DataFrame
functions. A hot line is counted by document before its hash is shuffled, and met
again in a join that Spark can split.

Defined results: a null or empty text is one empty line. Rows that share a ``doc_id``
are parts of one document: they count once and lose nothing to each other. A row
without an id is no document: it counts nowhere and keeps its lines. In the first
document of a key all its lines stay, repeats within it too. Equal rows give equal
rows. A very long text is cut by one task, in time that grows with its lines. Other
columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import materialize

WHITE = " \t\n\x0b\x0c\r"


def key_of(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case and nothing else changed."""
    bare = F.trim(line, F.lit(WHITE))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def digest(text: Column) -> Column:
    """128 bits of SHA-256."""
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def repeated_lines(lines: DataFrame, documents: int = 2) -> DataFrame:
    """(hash, first): keys that so many documents or more hold, with the smallest of these, from (hash, doc_id)."""
    if documents == 2:  # two documents hold it if the smallest is not the largest
        return lines.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("hash", "first")
    held = lines.select("hash", "doc_id").distinct()
    return held.groupBy("hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where(F.col("n") >= documents).select("hash", "first")


def dedup_lines(docs: DataFrame, least_chars: int = 10, documents: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of each row of ``docs``; ``kept`` is the text that remains."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    with_id = rows.where("doc_id is not null").select("doc_id", digest(F.col("text")).alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    keyed = with_id.select("doc_id", "row", "at", key_of(F.col("line")).alias("key")).where(F.length("key") >= least_chars)
    lines = keyed.select(digest(F.col("key")).alias("hash"), "doc_id", "row", "at")
    repeated = materialize(repeated_lines(lines, documents), "repeated-lines")  # the join below then starts from two exchanges
    gone = lines.join(repeated, "hash").where("doc_id > first").groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("at")).alias("gone"))
    whole = rows.withColumn("row", digest(F.col("text"))).join(gone, ["doc_id", "row"], "left").withColumn("lines", F.split("text", "\n", -1))
    bounds = F.concat(F.array(F.lit(-1)), "gone", F.array(F.size("lines")))
    cut = whole.select("doc_id", "text", "gone", "lines", bounds.alias("bounds"))
    stretch = lambda i: F.slice("lines", F.get("bounds", i) + 2, F.get("bounds", i + 1) - F.get("bounds", i) - 1)  # noqa: E731  between two positions that go
    rest = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("gone")), stretch)), "\n")
    return cut.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(rest).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
    SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
),
held AS (SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT l.doc_id, l.pos, l.line, coalesce(l.doc_id > h.first, false) AS gone FROM lines l LEFT JOIN held h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
