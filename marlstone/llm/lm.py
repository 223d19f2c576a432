"""Stupid-backoff scores of documents from n-gram counts of the whole corpus.

S(w | context) is count(context w) / count(context) where the n-gram occurs
``least_count`` times or more, else 0.4 times the score under a context shorter
by one word; the last resort is count(w) / number of words. A document's score
is the sum of log10 S over its words; at its start contexts are shorter.

The work is relational, with arrays of n-grams as rows. Documents are dealt to
batches by a hash. Each batch is exploded into its n-grams of all orders, and its
distinct ones go, with their numbers, to partitions of the n-gram hash. There the
count table of the partition is made, and joined back to what each batch asked for.
The counts return to the batches, where they are joined to the n-grams by position
and scored; scores are summed by document. Contexts need no join of their own: the
context of an n-gram is one itself, a word before, in the same batch. Partitions are
counted in ``slices`` shares, for each of which the batches are exploded again.

A frequent n-gram comes once a batch to its partition, however often it occurs, so
no key is hot. Batches and partitions are as many as the input asks for.

Defined results: null and empty texts have no words and a null score. A null id
stays null. Texts are cut into pieces of about ``BLOCK`` bytes at white space, each
with the words before it as context, so very long ones need no more memory. Rows that
repeat are each counted and each scored, and equal ids with other texts are told apart
by a hash of the text. An empty table gives no rows. Other columns of the input are
not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import Rolling, Words, materialize

BLOCK = 4 << 20
#: Bytes of text of a batch, and of n-grams of a partition of a count table, at about which further ones are made.
BATCH_BYTES, TABLE_BYTES = 4 << 20, 32 << 20
#: Shares of the partitions that are counted one after the other, so that only one share of the n-grams is on disk at a time.
SLICES = 2
BACKOFF = 0.4
WHITE = re.compile(rb"[ \t-\r]")


def blocks(text: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """``text`` in stretches of about ``size`` bytes that end at white space; an empty one for no text."""
    at = 0
    while at < len(text) or at == 0:
        cut = WHITE.search(text, at + size) if at + size < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = max(end, 1)


def pieces(text: bytes, order: int, size: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """Blocks of ``text`` with up to ``order`` - 1 words before each of them put in front, and the number of these."""
    head: list[bytes] = []
    for block in blocks(text, size):
        yield len(head), b" ".join([*head, block])
        head = (head + block.rsplit(None, order - 1)[1 - order :])[1 - order :] if order > 1 else []


def text_key(doc_id: int | None, text: bytes | None) -> int:
    return xxhash.xxh64_intdigest(text or b"", seed=0 if doc_id is None else 1) - (1 << 63)


def _cutter(order: int, size: int):
    """Pieces of the texts of a batch of rows; those that repeat in it come once, with their number."""
    kinds = {"doc_id": pa.int64(), "key": pa.int64(), "no": pa.int32(), "head": pa.int32(), "text": pa.binary(), "copies": pa.int64()}

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())
            keys = [text_key(i, t.as_py()) for i, t in zip(ids, texts, strict=True)]
            copies = Counter(zip(ids, keys, strict=True))
            rows: list[tuple] = []
            held = 0
            for doc_id, key, text in zip(ids, keys, texts, strict=True):
                n = copies.pop((doc_id, key), 0)
                for no, (head, piece) in enumerate(pieces(text.as_py() or b"", order, size) if n else ()):
                    rows.append((doc_id, key, no, head, piece, n))
                    held += len(piece)
                    if held >= size:
                        yield table(rows)
                        rows, held = [], 0
            if rows:
                yield table(rows)

    return run


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as planes of their first bytes, second bytes and so on: those of small numbers compress to nearly nothing."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


class Exploded:
    """The n-grams of the pieces of a batch by position: for each order their hashes, the places of their last words, and the distinct ones in order."""

    def __init__(self, table: pa.Table, order: int) -> None:
        texts = table.column("text").combine_chunks().to_pylist()
        words, self.sizes = Words().of_texts(texts)
        self.n = len(words)
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), self.sizes)
        starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)
        self.place = np.arange(self.n, dtype=np.int32) - starts[self.owner]
        self.context = self.place < np.asarray(table.column("head"), np.int32)[self.owner]
        self.words, self.order = words, order

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of order ``k`` and the places of their last words."""
        last = np.flatnonzero(self.place >= k - 1)
        return Rolling(0x9E3779B97F4A7C15 + 2 * k)(self.words, k)[last - (k - 1)], last


def _partition(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Partitions are ranges of the hash, so that sorted n-grams have them in order."""
    return hashes >> np.uint64(64 - bits) if bits else np.zeros(len(hashes), np.uint64)


def _edges(distinct: np.ndarray, bits: int) -> np.ndarray:
    """Where each partition of the hash begins and ends among sorted hashes."""
    return np.searchsorted(_partition(distinct, bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def _asker(order: int, bits: int, share: int, slices: int):
    """What a batch asks of one share of the partitions: for each order its distinct n-grams, with how often it holds them."""

    def run(table: pa.Table) -> pa.Table:
        batch = table.column("batch")[0].as_py()
        found = Exploded(table, order)
        weights = np.where(found.context, 0, np.asarray(table.column("copies"))[found.owner])
        part, grams, numbers = [], [], []
        for k in range(1, order + 1):
            hashes, last = found.grams(k)
            if slices > 1:
                mine = _partition(hashes, bits) % np.uint64(slices) == share
                hashes, last = hashes[mine], last[mine]
            distinct, n = np.unique(hashes, return_counts=True)
            weight = weights[last]
            odd = np.flatnonzero(weight != 1)  # words given as context only, and rows that repeat
            np.add.at(n, np.searchsorted(distinct, hashes[odd]), weight[odd] - 1)
            edges = _edges(distinct, bits)
            for p in np.flatnonzero(np.diff(edges)).tolist():
                mine = slice(edges[p], edges[p + 1])
                part.append(((k - 1) << bits) + p)
                grams.append(packed(np.diff(distinct[mine], prepend=np.uint64(0))))
                numbers.append(packed(n[mine]))
        return pa.table({"batch": pa.array([batch] * len(part), pa.int64()), "part": pa.array(part, pa.int32()), "grams": pa.array(grams, pa.binary()), "n": pa.array(numbers, pa.binary())})

    return run


def _answer(table: pa.Table) -> pa.Table:
    """The count table of a partition, joined to what each batch asked for; its sum with the first answer."""
    asked = [np.cumsum(unpacked(x)) for x in table.column("grams").to_pylist()]
    numbers = np.concatenate([unpacked(x) for x in table.column("n").to_pylist()]).astype(np.int64)
    order = np.argsort(np.concatenate(asked), kind="stable")
    keys = np.concatenate(asked)[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.add.reduceat(numbers[order], first)
    back = np.empty(len(keys), np.int64)
    back[order] = np.repeat(counts, np.diff(np.append(first, len(keys))))
    stops = np.cumsum([len(x) for x in asked])
    answers = [packed(back[stop - len(x) : stop]) for x, stop in zip(asked, stops, strict=True)]
    total = np.zeros(len(asked), np.int64)
    total[0] = counts.sum()
    return pa.table({"batch": table.column("batch"), "part": table.column("part"), "counts": pa.array(answers, pa.binary()), "total": pa.array(total)})


def _scorer(order: int, bits: int, least_count: int, n_words: int):
    """Scores of the pieces of a batch, its n-grams joined to their counts by position."""
    back = math.log10(BACKOFF)

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        found = Exploded(table, order)
        answers = answers.sort_by("part")
        part, data = np.asarray(answers.column("part")), answers.column("counts").to_pylist()
        score, below = np.zeros(found.n), np.zeros(found.n, np.int64)
        for k in range(1, order + 1):
            hashes, last = found.grams(k)
            _, at = np.unique(hashes, return_inverse=True)
            mine = np.flatnonzero(part >> bits == k - 1).tolist()
            counts = np.concatenate([unpacked(data[i]) for i in mine]).astype(np.int64)[at] if mine else np.empty(0, np.int64)
            if k == 1:
                score[last] = np.log10(counts / n_words)
            else:
                known = counts >= least_count
                score[last[~known]] += back
                score[last[known]] = np.log10(counts[known] / below[last[known] - 1])
            below = np.zeros(found.n, np.int64)
            below[last] = counts
        mine = ~found.context
        words = np.bincount(found.owner[mine], minlength=len(found.sizes))
        total = np.bincount(found.owner[mine], score[mine], minlength=len(found.sizes))
        return pa.table({"doc_id": table.column("doc_id"), "key": table.column("key"), "copies": table.column("copies"), "words": pa.array(words, pa.int64()), "total": pa.array(total, pa.float64())})

    return run


def score_corpus(docs: DataFrame, order: int = 3, least_count: int = 2, batch_bytes: int = BATCH_BYTES, table_bytes: int = TABLE_BYTES, block: int = BLOCK, slices: int = SLICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log10_score, log10_per_word) of each row, from counts over all rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1.0, size * order / table_bytes))))
    cut = rows.mapInArrow(_cutter(order, block), "doc_id long, key long, no int, head int, text binary, copies long")
    dealt = cut.withColumn("batch", F.pmod(F.xxhash64("doc_id", "key", "no"), F.lit(size // batch_bytes + 1))).repartition("batch")
    dealt = dealt.groupBy("batch", "doc_id", "key", "no").agg(F.first("head").alias("head"), F.first("text").alias("text"), F.sum("copies").alias("copies"))
    tables = []
    for share in range(min(slices, 1 << bits)):
        asked = dealt.groupBy("batch").applyInArrow(_asker(order, bits, share, min(slices, 1 << bits)), "batch long, part int, grams binary, n binary")
        tables.append(materialize(asked.groupBy("part").applyInArrow(_answer, "batch long, part int, counts binary, total long"), "counts"))
    answers = reduce(DataFrame.unionByName, tables)
    n_words = answers.where(F.col("part") < (1 << bits)).agg(F.sum("total")).first()[0] or 0
    score = _scorer(order, bits, least_count, n_words)
    scored = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, "doc_id long, key long, copies long, words long, total double")
    summed = scored.groupBy("doc_id", "key").agg(F.max("copies").alias("copies"), F.sum("words").alias("n_words"), F.sum("total").alias("total"))
    summed = summed.withColumn("log10_score", F.when(F.col("n_words") > 0, F.col("total"))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return summed.select("doc_id", "n_words", "log10_score", (F.col("log10_score") / F.col("n_words")).alias("log10_per_word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scores.select("doc_id", "n_words", F.round("log10_score", 4).alias("log10_score"), F.round("log10_per_word", 6).alias("log10_per_word"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
n AS (SELECT count(*) AS c FROM t),
g AS (SELECT r, i, w, lag(w) OVER o AS p, lag(w, 2) OVER o AS q FROM t WINDOW o AS (PARTITION BY r ORDER BY i)),
u AS (SELECT w, count(*) AS c FROM g GROUP BY w),
b AS (SELECT p, w, count(*) AS c FROM g WHERE p IS NOT NULL GROUP BY p, w),
e AS (SELECT q, p, w, count(*) AS c FROM g WHERE q IS NOT NULL GROUP BY q, p, w),
s AS (
  SELECT g.r, log10(CASE WHEN e.c >= 2 THEN e.c / bp.c WHEN b.c >= 2 THEN CASE WHEN g.q IS NULL THEN 1 ELSE 0.4 END * b.c / up.c
    ELSE CASE WHEN g.p IS NULL THEN 1 WHEN g.q IS NULL THEN 0.4 ELSE 0.4 * 0.4 END * u.c / n.c END) AS x
  FROM g JOIN u ON g.w = u.w CROSS JOIN n LEFT JOIN b ON b.p = g.p AND b.w = g.w LEFT JOIN u AS up ON up.w = g.p
    LEFT JOIN e ON e.q = g.q AND e.p = g.p AND e.w = g.w LEFT JOIN b AS bp ON bp.p = g.q AND bp.w = g.p)
SELECT d.doc_id, count(s.x) AS n_words, round(sum(s.x), 4) AS log10_score, round(sum(s.x) / count(s.x), 6) AS log10_per_word
FROM d LEFT JOIN s ON d.r = s.r GROUP BY d.r, d.doc_id
"""
