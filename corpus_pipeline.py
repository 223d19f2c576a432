"""Corpus cleaning in five stages, each over all that the one before kept.

Defined results: documents with a null or empty text fail the quality rules and go,
whatever their id. Kept rows without an id stay through all stages. Rows that repeat
an id and a text are near duplicates of each other and one stays; of two texts under
one id each is judged by itself. A very long text passes each stage whole, in one
task. Further columns, whatever their names, are carried through all stages but the
last, which returns (doc_id, n_tokens, ids_sha256, decoded_sha256, ids). An empty
table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.bpe import bpe_round_trip
from marlstone.llm.common import materialize
from marlstone.llm.decontaminate import without_leaks
from marlstone.llm.jaccard import one_of_each
from marlstone.llm.quality import keep_good
from marlstone.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaks go."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text with digests of them and of their decoding."""
    return bpe_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secrets),
    ("bpe_encoding", encoding),
]

#: Hashes of signatures, compression ratios and merges are beyond SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
