"""Writes into keyed Parquet tables: upserts, insert-ignore, counters and partition replacement.

A table is a folder of Parquet. Each write computes the new content as one plan over
the stored rows and the incoming ones, and either appends what is new or overwrites
whole partitions, so a failed job leaves what was there. Upserts are partial
aggregations by key: no row is held against another in Python.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors reach: below ``spark.checkpoint.dir``, on one machine a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="marlstone-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}/{name}"


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], keep_old: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """Stored rows with the incoming ones put over them by key; columns in ``keep_old`` keep the stored value where the new one is null or empty.

    Of incoming rows with one key the last by ``order``, a column of ``incoming``, counts; without it, or where it ties, the one with the greatest hash.
    """
    columns = [F.col(c) for c in stored.columns]
    rank = lambda new, last: F.struct(F.lit(new).alias("new"), last.alias("order"), F.xxhash64(*columns).alias("hash"))
    last = F.col(order) if order else F.lit(0)
    none = F.lit(None).cast(incoming.schema[order].dataType) if order else F.lit(0)
    both = stored.select(*columns, rank(0, none).alias("_new")).unionByName(incoming.select(*columns, rank(1, last).alias("_new")))

    def latest(c: str) -> Column:
        if c not in keep_old:
            return F.max_by(c, "_new")
        given = F.nullif(F.col(c).cast("string"), F.lit(""))
        return F.max_by(F.when(given.isNotNull(), F.col(c)), F.when(given.isNotNull(), F.col("_new")))

    rest = [c for c in stored.columns if c not in keys]
    return both.groupBy(*keys).agg(*(latest(c).alias(c) for c in rest)).select(*stored.columns)


def upsert_material(stored: DataFrame, incoming: DataFrame, key: str, moved: str, material: str) -> DataFrame:
    """As ``upsert`` with all columns coalescing, where ``moved`` changes only for incoming rows with ``material``; ``incoming`` has that column besides."""
    n = incoming.select(*(F.col(c).alias(f"_{c}") for c in incoming.columns))
    joined = stored.join(n, F.col(key) == F.col(f"_{key}"), "full_outer")
    old = F.col(key).isNotNull()

    def value(c: str) -> Column:
        if c == moved:
            return F.when(old & ~F.coalesce(F.col(f"_{material}"), F.lit(False)), F.col(c)).otherwise(F.coalesce(f"_{c}", c))
        return F.coalesce(f"_{c}", c)

    return joined.select(*(value(c).alias(c) for c in stored.columns))


def insert_ignore(stored: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """The incoming rows whose key is not stored, the first by ``order`` of each key: what an append adds."""
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*incoming.columns), order).alias("r")).select("r.*")
    return first.join(stored.select(key).distinct(), key, "left_anti").select(*incoming.columns)


def add_counters(stored: DataFrame, deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of stored counters and deltas."""
    return stored.unionByName(deltas).groupBy(*keys).agg(F.sum("value").alias("value"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Overwrite only the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def replace_partition(df: DataFrame, path: str, run_log: str, run_id: str, **partition: str) -> None:
    """Put ``df`` in place of one partition, whose values it has, and record the run. Without rows the partition is cleared: what an earlier run left there goes."""
    spark = df.sparkSession
    n = df.count()
    if n:
        replace_partitions(df, path, *partition)
    else:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "".join(f"/{k}={v}" for k, v in partition.items()))
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    record = [(run_id, "&".join(f"{k}={v}" for k, v in partition.items()), n)]
    spark.createDataFrame(record, "run_id string, partition string, n_rows long").write.mode("append").parquet(run_log)


def export_csv(df: DataFrame, path: str, *order: str) -> None:
    """Rows in order, with a header."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def import_csv(spark: SparkSession, path: str, schema: str, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with the name of the first failed rule): a row that does not parse fails the rule "parse". ``rules`` are SQL conditions by name."""
    rows = spark.read.schema(schema + ", _corrupt string").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    failed = F.when(F.col("_corrupt").isNotNull(), "parse")
    for name, condition in rules.items():
        failed = failed.when(~F.coalesce(F.expr(condition), F.lit(False)), name)
    judged = rows.withColumn("failed", failed)
    return judged.where("failed is null").drop("failed", "_corrupt"), judged.where("failed is not null").drop("_corrupt")
