"""Tests of whole texts for words and patterns: each test one pass over a column of texts, inside the tasks that read them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marlstone.plans.dialect import SparkSql

#: Articles tested at a time.
AT_ONCE = 256
#: Texts of an article that tests may name: title and content, the same in lower case, title and start of the content.
SCAN = "(title || ' ' || substring(content, 1, 200))"
TEXTS = {
    "body": lambda title, content: pc.binary_join_element_wise(title, content, " "),
    "low_body": lambda title, content: pc.utf8_lower(pc.binary_join_element_wise(title, content, " ")),
    SCAN: lambda title, content: pc.binary_join_element_wise(title, pc.utf8_slice_codeunits(content, 0, 200), " "),
}


class Marked(SparkSql):
    """Spark's spellings over articles whose texts were tested before: a test of a text is the name of a column, and ``tests`` tells which (text, pattern) each stands for."""

    def __init__(self) -> None:
        self.tests: dict[tuple[str, str], str] = {}

    def rx(self, x: str, pattern: str) -> str:
        alias, _, text = x.rpartition(".")
        if text not in TEXTS:
            return super().rx(x, pattern)
        name = self.tests.setdefault((text, pattern), f"mark{len(self.tests)}")
        return f"{alias}.{name}" if alias else name

    def any_in(self, x: str, words: list[str]) -> str:
        return self.rx(x, "|".join(map(re.escape, words))) if x.rpartition(".")[2] in TEXTS else super().any_in(x, words)


def _tested(tests: dict[tuple[str, str], str], kept: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(start, AT_ONCE)
                texts = {name: make(part.column("title"), part.column("content")) for name, make in TEXTS.items()}
                marks = [pc.match_substring_regex(texts[text], pattern) for text, pattern in tests]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *marks], schema=schema)

    return run


def marked(articles: DataFrame, tests: dict[tuple[str, str], str]) -> DataFrame:
    """``articles`` with a boolean column for each test in place of their ``title`` and ``content``, which are no nulls."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [f for f in articles.schema if f.name not in ("title", "content")]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kept] + [T.StructField(name, T.BooleanType()) for name in tests.values()])
    return articles.mapInArrow(_tested(tests, [f.name for f in kept], to_arrow_schema(schema)), schema)
