"""Substring dedup: words inside windows that an earlier document holds too.

First pass. Each window of ``WINDOW`` words is counted under its anchor, the
least hash among the ``GRAM``-word runs inside it: equal windows have equal
anchors, so the count of an anchor is never below that of a window. Tasks
count the anchors of their documents in sketches (four rows of cells, counts up
to two), the sketches are merged cell by cell, and one bit a cell, "two or more", is
sent to all tasks. ``cells_for`` gives a row of the sketch two cells for each anchor
that so much text is likely to have, between 2**20 and 2**27 cells; with 4 rows
that is 64 MB at most. From about 5 GB of text on that bound holds: a fuller sketch
lets more windows through to the second pass and never loses one.

Second pass. Only windows whose anchor may be repeated go on. Documents with
the same words are represented by the smallest of them, so groups of copies
cost one member; a larger copy of 50 words or more loses all its words. Among
the representatives anchors are counted exactly first, and windows of those
that are in two of them are grouped, by 128 bits of BLAKE2 of their words, to the
smallest document that has them, and joined back to find windows with a smaller
holder.

Defined results: null and empty texts have no words; texts under ``WINDOW`` words
lose none. Rows that repeat an id and text are equal to each other and remove
nothing from one another. A row without an id neither removes words nor loses any. A
very long text is cut by one task at a time, whole. Other columns are not read,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import Rolling, Words, covered, materialize

WINDOW, GRAM = 50, 25
FEWEST, MOST, ROWS = 1 << 20, 1 << 27, 4
BLOCK = 1 << 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
FIRST, SECOND = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


class Windows:
    """Hashes of the windows of a text and their anchors."""

    def __init__(self) -> None:
        self.words, self.first = Words(), Rolling(FIRST)

    def texts(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """Word hashes of each text."""
        for i in range(0, len(texts), 500):
            words, sizes = self.words.of_texts(texts[i : i + 500])
            yield from np.split(words, np.cumsum(sizes)[:-1])

    def anchors(self, hashes: np.ndarray) -> np.ndarray:
        """The anchor of each window: a sliding minimum, by doubling widths."""
        low, width, want = self.first(hashes, GRAM), 1, WINDOW - GRAM + 1
        while 2 * width <= want:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        return np.minimum(low[: len(low) - (want - width)], low[want - width :]) if want > width else low

    @staticmethod
    def ids(text: bytes, at: np.ndarray) -> np.ndarray:
        """128 bits of the words of the windows that start at these words, as two numbers a row; words are joined by one space."""
        ends = np.append(np.flatnonzero(np.frombuffer(text, np.uint8) == 32), len(text))
        starts = np.insert(ends[:-1] + 1, 0, 0)
        view = memoryview(text)
        spans = zip(starts[at].tolist(), ends[at + WINDOW - 1].tolist(), strict=True)
        return np.frombuffer(b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in spans]), "<i8").reshape(-1, 2)


def cells_for(text_bytes: int) -> int:
    """Cells of a row of the sketch: a power of two from twice the anchors of so much text, one in about 80 bytes."""
    return min(MOST, max(FEWEST, 1 << (text_bytes // 40).bit_length()))


def cells_of(anchors: np.ndarray, cells: int) -> list[np.ndarray]:
    """Cells of each row of the sketch, the rows one after the other."""
    mask, out, x = np.uint64(cells - 1), [], anchors
    for row in range(ROWS):
        out.append((x >> np.uint64(20) & mask) + np.uint64(row * cells))
        x = x * np.uint64(SECOND)
        x = x ^ x >> np.uint64(31)
    return out


def sketch(docs: DataFrame, cells: int) -> np.ndarray:
    """Bits, one a cell: whether two documents or more counted there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows()
        for batch in batches:
            found = []
            for hashes in windows.texts(batch.column(1).cast(pa.binary()).to_pylist()):
                if len(hashes) >= WINDOW:
                    found.append(np.unique(windows.anchors(hashes)))
            if not found:
                continue
            anchors = np.concatenate(found)
            where = np.sort(np.concatenate(cells_of(anchors, cells)))
            cell, n = np.unique(where, return_counts=True)
            block = (cell // BLOCK).astype(np.int64)
            cuts = np.flatnonzero(np.diff(block)) + 1
            once = (cell % BLOCK).astype("<u2")
            twice = n >= 2
            rows = [(int(b[0]), x[~t].tobytes(), x[t].tobytes()) for b, x, t in zip(np.split(block, cuts), np.split(once, cuts), np.split(twice, cuts), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["block", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = None, np.zeros(BLOCK, np.uint8)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(counts >= 2, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

        for batch in batches:
            for block, once, twice in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if block != at:
                    if at is not None:
                        yield done()
                    at, counts = block, np.zeros(BLOCK, np.uint8)
                one = np.frombuffer(once, "<u2")
                counts[one] = np.minimum(counts[one] + 1, 2)
                counts[np.frombuffer(twice, "<u2")] = 2
        if at is not None:
            yield done()

    parts = docs.mapInArrow(count, "block long, once binary, twice binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block long, bits binary")
    bits = np.zeros(ROWS * cells // 8, np.uint8)
    for row in merged.collect():  # at most ROWS * cells / 65536 rows of 8 KB
        bits[row.block * BLOCK // 8 : (row.block + 1) * BLOCK // 8] = np.frombuffer(row.bits, np.uint8)
    return bits


def maybe_repeated(bits: np.ndarray, anchors: np.ndarray, cells: int) -> np.ndarray:
    out = np.ones(len(anchors), bool)
    for c in cells_of(anchors, cells):
        out &= (bits[(c >> np.uint64(3)).astype(np.int64)] >> (c & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


PLAN = "doc_id long, n_words long, k1 long, k2 long, sha string, text string, anchors array<long>"


def dedup_substrings(docs: DataFrame, cells: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of each row; ``kept`` is the remaining text where words were removed, else null."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cells = cells or cells_for(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    bits = spark.sparkContext.broadcast(sketch(rows, cells))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows()
        for batch in batches:
            out = []
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for text, hashes in zip(texts, windows.texts(texts), strict=True):
                words = text.split() if text else []
                joined = b" ".join(words)
                digest = hashlib.sha256(joined)
                k1, k2 = np.frombuffer(digest.digest()[:16], "<i8").tolist()
                seen = None
                if len(words) >= WINDOW:
                    seen = np.unique(windows.anchors(hashes))
                    seen = seen[maybe_repeated(bits.value, seen, cells)].view(np.int64)
                    seen = seen if len(seen) else None
                out.append((len(words), k1, k2, digest.hexdigest(), joined if seen is not None else None, seen))
            n, k1, k2, sha, text, anchors = zip(*out, strict=True) if out else [()] * 6
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.binary()).cast(pa.string()), pa.array(anchors, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in PLAN.split(", ")])

    planned = materialize(rows.mapInArrow(plan, PLAN), "window-plan")
    flagged = planned.where("anchors is not null and doc_id is not null")
    least = flagged.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"))
    holders = flagged.select("doc_id", "k1", "k2", "anchors").join(least, ["k1", "k2"]).where(F.col("doc_id") == F.col("first"))
    anchored = holders.select("doc_id", "k1", "k2", F.explode("anchors").alias("anchor"))
    twice = materialize(anchored.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("anchor"), "anchors")
    mine = anchored.join(twice, "anchor").groupBy("k1", "k2", F.col("doc_id").alias("first")).agg(F.collect_list("anchor").alias("shared"))  # a document's own
    sharing = flagged.select("doc_id", "k1", "k2", "text").join(mine, ["k1", "k2"]).where("doc_id = first").dropDuplicates(["k1", "k2"]).select("doc_id", "k1", "k2", F.xxhash64("k1", "k2", "doc_id").alias("key"), "text", "shared")
    sharing = materialize(sharing, "sharing")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows()

        def batch_of(parts: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["h1", "h2", "doc_id", "key", "at"])

        for batch in batches:
            parts: list[tuple] = []
            held = 0
            for doc, key, text, shared in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data = text.encode()
                (hashes,) = windows.texts([data])
                at = np.flatnonzero(np.isin(windows.anchors(hashes), np.array(shared, np.int64).view(np.uint64))).astype(np.int32)
                ids = windows.ids(data, at)
                parts.append((ids[:, 0], ids[:, 1], np.full(len(at), doc), np.full(len(at), key), at))
                held += len(at)
                if held > 200_000:
                    yield batch_of(parts)
                    parts, held = [], 0
            if parts:
                yield batch_of(parts)

    found = sharing.select("doc_id", "key", "text", "shared").mapInArrow(explode, "h1 long, h2 long, doc_id long, key long, at int")
    first = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    first = materialize(first, "repeated-windows")  # so that the join below starts from two exchanges, which Spark can split where a window is hot
    hits = found.join(first, ["h1", "h2"]).where("doc_id > first").select("key", "at")
    starts = hits.groupBy("key").agg(F.collect_list("at").alias("starts"))  # no more than the windows of one document
    todo = sharing.select("k1", "k2", "doc_id", "key", "text").join(starts, "key").select("k1", "k2", "doc_id", "text", "starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                words = text.split(" ")
                gone = covered(np.array(starts, np.int64), WINDOW, len(words))
                kept = " ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                out.append((int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest(), kept))
            columns = zip(*out, strict=True) if out else [()] * 3
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *arrays], ["k1", "k2", "doc_id", "gone", "cut_sha", "cut"])

    cuts = todo.mapInArrow(cut, "k1 long, k2 long, doc_id long, gone long, cut_sha string, cut string").dropDuplicates(["k1", "k2", "doc_id"])
    marked = planned.drop("text", "anchors").join(least, ["k1", "k2"], "left").join(cuts, ["k1", "k2", "doc_id"], "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return marked.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("cut")).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
