"""Roots by doubled steps, which no limit of recursion ends."""

from pyspark.sql import functions as F

from marlstone.plans import catalog
from marlstone.plans.events import roots_within


def test_by_hand(spark):
    links = [(i, i - 1) for i in range(1, 30)] + [(0, None), (50, 99), (60, 60), (70, 71), (71, 70), (None, None), (5, 4)]
    got = {r.id: (r.root, r.depth) for r in roots_within(spark.createDataFrame(links, "id long, parent long")).collect()}
    assert got == {**{i: (max(0, i - 10), min(i, 10)) for i in range(30)}, 50: (50, 0), 60: (60, 0), 70: (70, 10), 71: (71, 10), None: (None, 0)}


def test_more_rows_than_recursion_may_have(spark, tmp_path):
    docs = spark.range(700_000).select(F.col("id").alias("doc_id"), F.lit("a. b").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(4).cast("long").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = catalog.QUERIES["root_flatten"](spark, str(tmp_path)).groupBy("depth").count().collect()
    assert {r.depth: r["count"] for r in got} == {0: 280_000, 1: 140_000, 2: 140_000, 3: 140_000}
