"""Fingerprints of articles: 64 bits, each by the vote of all tokens."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows whose votes are added up at a time.
AT_ONCE = 512


def halves(tokens: list[str]) -> np.ndarray:
    """The bits of each token, 1 or -1: 32 of its digest's first four bytes, then 32 of its next four, the least first."""
    digests = np.frombuffer(b"".join(md5(t.encode()).digest()[:8] for t in tokens), ">u4").reshape(-1, 2)  # noqa: S324
    bits = (digests[:, :, None].astype(np.int64) >> np.arange(32)) & 1
    return (2 * bits - 1).reshape(-1, 64).astype(np.int8)


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = np.int64(1) << np.arange(32)
    for batch in batches:
        for start in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(start, AT_ONCE)
            lists = part.column(2)
            sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            has = np.flatnonzero(sizes)  # articles without tokens have no fingerprint
            if not len(has):
                continue
            tokens = lists.flatten().dictionary_encode()
            each = halves(tokens.dictionary.to_pylist())[np.asarray(tokens.indices)]
            starts = np.cumsum(sizes[has]) - sizes[has]
            sums = np.add.reduceat(each, starts, axis=0, dtype=np.int32).reshape(-1, 2, 32)
            sides = ((sums > 0) * weights).sum(axis=2)
            kept = part.take(pa.array(has))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(sides[:, 0]), pa.array(sides[:, 1])], ["id", "published", "hi", "lo"])


def faces(tokens: DataFrame) -> DataFrame:
    """(id, published, hi, lo) of (id, published, ts), which may be a stream; rows without tokens are left out."""
    return tokens.selectExpr("CAST(id AS LONG) AS id", "CAST(published AS LONG) AS published", "ts").mapInArrow(_voted, "id long, published long, hi long, lo long")
