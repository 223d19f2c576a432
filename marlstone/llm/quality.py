"""Quality rules: compression bands over whole documents and fixed chunks.

Repetitive text compresses too well and noise hardly at all. Each length class
has its own band of allowed zstandard ratios (compressed bytes / bytes); chunks
of a fixed size have a further band, and a document may have only a small share
of its bytes in chunks outside it. What is left after the last whole chunk is
judged by a chunk that ends with the text, and counts with the bytes no chunk
before has. A text shorter than a chunk is judged by the band of its length.

Defined results: a null text counts as having no words and fails the base rule; an
empty text too. A null id stays null. Repeated rows are judged each by itself, and so
are equal ids. A very long text is judged whole by one task. A ratio equal to a limit
is inside its band. An empty table gives no rows. Other columns are not read, whatever
their names (``keep_good`` returns them unchanged).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import Rolling, covered

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, zstd_ratio double, n_chunks long, n_bad_chunks long"


@dataclass(frozen=True)
class Bands:
    """``limits`` has rows (bytes below, lowest ratio, highest ratio); the last row holds for all longer texts."""

    limits: tuple[tuple[float, float, float], ...] = (
        (64, 0.50, 9.0),
        (128, 0.45, 1.60),
        (256, 0.40, 1.20),
        (512, 0.42, 0.95),
        (1024, 0.42, 0.85),
        (2048, 0.40, 0.75),
        (4096, 0.38, 0.72),
        (8192, 0.36, 0.70),
        (16384, 0.34, 0.68),
        (float("inf"), 0.32, 0.66),
    )
    chunk_bytes: int = 4096
    chunk_low: float = 0.30
    chunk_high: float = 0.70
    bad_chunk_share: float = 0.10
    level: int = 3

    def band(self, n: int) -> tuple[float, float]:
        return next((low, high) for below, low, high in self.limits if n < below)


WHITE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


def twice(numbers: np.ndarray, rolling: Rolling, width: int = 8) -> np.ndarray:
    """Which windows of so many words occur at least twice; ``numbers``: a number for each distinct word.

    Windows with equal hashes are neighbours in the order of hashes, and compared word by
    word there. Should one hash stand for different windows, all are compared as they are.
    """
    hashes = rolling(numbers, width)
    order = np.argsort(hashes, kind="stable")
    a, b = order[1:], order[:-1]
    near = hashes[a] == hashes[b]
    a, b = a[near], b[near]
    out = np.zeros(len(hashes), bool)
    if all((numbers[a + k] == numbers[b + k]).all() for k in range(width)):
        out[a] = out[b] = True
        return out
    seen: dict[bytes, int] = {}
    for i in range(len(hashes)):
        first = seen.setdefault(numbers[i : i + width].tobytes(), i)
        if first != i:
            out[first] = out[i] = True
    return out


def _judge(text: bytes, rolling: Rolling, packer: zstandard.ZstdCompressor, bands: Bands) -> tuple:
    words = text.split()
    n = len(words)
    chars = len(text.decode("utf-8", "replace")) - sum(map(text.count, (WHITE[i : i + 1] for i in range(len(WHITE)))))
    symbols = sum(text.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeats = 0
    if n > 8:
        known: dict[bytes, int] = {}
        numbers = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, n)
        repeats = int(covered(np.flatnonzero(twice(numbers, rolling)), 8, n).sum())
    failed = n < 20 or 100 * repeats > 30 * n
    ratio = len(packer.compress(text)) / len(text) if text else 0.0
    size = bands.chunk_bytes
    ends = [*range(size, len(text), size), len(text)] if len(text) >= size else []
    bad = [end for end in ends if not bands.chunk_low <= len(packer.compress(text[end - size : end])) / size <= bands.chunk_high]
    bad_bytes = sum((end - 1) % size + 1 for end in bad)
    low, high = bands.band(len(text))
    kept = not failed and low <= ratio <= high and bad_bytes <= bands.bad_chunk_share * len(text)
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, failed, kept, ratio, len(ends), len(bad)


def quality_rules(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base verdict and compression verdict of each row of ``docs``; one pass, no shuffle."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(0x9E3779B97F4A7C15)
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            rows = [_judge(t or b"", rolling, packer, bands) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 10
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(judge, SCHEMA)


def keep_good(docs: DataFrame, bands: Bands = Bands(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(0x9E3779B97F4A7C15)
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            good = [_judge(t or b"", rolling, packer, bands)[6] for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
