"""Token ids in files of fixed-width bit packing.

Layout of a file (integers are little endian):

* blocks of ``BLOCK`` ids, each id in ``width`` bits, lowest bit first, in
  64-bit words; the last block may be shorter
* block table: offset of each block, 64 bits each
* document table: ids of documents, then the position of each document's first
  id in the file, 64 bits each
* trailer: number of ids, of blocks, of documents and of those without an id (the
  first ones), 64 bits each; width and format number, 32 bits each; the magic bytes

``width`` is the least number of bits that holds every id of the vocabulary.
Any run of ids is read from the blocks that hold it (``PackedFile.ids``).

Files are written in ascending order of document ids over ranges of them, one
file a range. A task names its file anew in each attempt, and only files that
the written manifest names count, so lost executors leave at worst unread files.

Defined results: a null text counts as empty and has the end id only. Rows without
an id come first. Rows that repeat an id each have their own entry, in the order of
a hash of their texts, then of the texts. A very long text is encoded whole by one
task. An empty table writes no file and gives no rows. Other columns are not read,
whatever their names. A tokenizer that splits texts otherwise is refused.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.bpe import WHITE, byte_alphabet
from marlstone.llm.common import fresh_path, materialize

BLOCK = 8192
MAGIC, FORMAT = b"PKDIDS\r\n", 2
TRAILER = struct.Struct("<QQQQII8s")
MANIFEST = "part int, path string, n_docs long, n_tokens long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def pack(ids: np.ndarray, width: int) -> bytes:
    """``ids`` in ``width`` bits each; padded with zeros to whole 64-bit words."""
    groups = -(-len(ids) // 64)
    lanes = np.zeros((groups, 64), np.uint64)
    lanes.ravel()[: len(ids)] = ids
    words = np.zeros((groups, width), np.uint64)
    for j in range(64):
        at, shift = divmod(j * width, 64)
        words[:, at] |= lanes[:, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, at + 1] |= lanes[:, j] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    """The first ``n`` ids of ``data``."""
    words = np.frombuffer(data, "<u8").reshape(-1, width)
    lanes = np.empty((len(words), 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        at, shift = divmod(j * width, 64)
        x = words[:, at] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (words[:, at + 1] << np.uint64(64 - shift))
        lanes[:, j] = x & mask
    return lanes.ravel()[:n]


class PackedWriter:
    """Writes one file, holding a block of ids and the document table."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width, self.at, self.n = out, width, 0, 0
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.blocks, self.docs, self.starts, self.unnamed = [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """Documents without an id go before all others."""
        if doc_id is None and self.unnamed < len(self.docs):
            raise ValueError("a document without an id after one with an id")
        self.unnamed += doc_id is None
        self.docs.append(doc_id or 0)
        self.starts.append(self.n)
        self.n += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 64 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint64)
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, whole, BLOCK):
            data = pack(ids[i : min(i + BLOCK, whole)], self.width)
            self.blocks.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        for table in (self.blocks, self.docs, self.starts):
            self.out.write(np.array(table, "<i8").tobytes())
        self.out.write(TRAILER.pack(self.n, len(self.blocks), len(self.docs), self.unnamed, self.width, FORMAT, MAGIC))


class PackedFile:
    """Random access to a file: ``docs``, ``starts`` and ``ids(start, n)``."""

    def __init__(self, source, size: int) -> None:
        self.source = source
        source.seek(size - TRAILER.size)
        self.n, blocks, docs, self.unnamed, self.width, number, magic = TRAILER.unpack(source.read(TRAILER.size))
        if magic != MAGIC or number != FORMAT:
            raise ValueError("not a file of packed ids")
        tables = 8 * (blocks + 2 * docs)
        source.seek(size - TRAILER.size - tables)
        table = np.frombuffer(source.read(tables), "<i8")
        self.blocks, self.docs, self.starts = table[:blocks], table[blocks : blocks + docs], table[blocks + docs :]
        self.end = size - TRAILER.size - tables

    def ids(self, start: int, n: int) -> np.ndarray:
        if n <= 0:
            return np.empty(0, np.uint64)
        first, last = start // BLOCK, (start + n - 1) // BLOCK
        begin = int(self.blocks[first])
        stop = int(self.blocks[last + 1]) if last + 1 < len(self.blocks) else self.end
        self.source.seek(begin)
        data = self.source.read(stop - begin)
        held = min(self.n, (last + 1) * BLOCK) - first * BLOCK
        return unpack(data, self.width, held)[start - first * BLOCK :][:n]


class ByteBpe:
    """Ids of texts by the tokenizers library, whose model is asked once for each piece that this process has not seen lately.

    The library splits a text at special tokens and then into pieces that its
    model merges each by itself, so the ids of a text are those of its pieces.
    """

    # How the tokenizer's kind of splitting is named, and what it does, with White_Space spelled out.
    SPLITTER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^WHITE\p{L}\p{N}]+|[WHITE]+(?![^WHITE])|[WHITE]+""".replace("WHITE", WHITE))
    # All letters, numbers and White_Space below U+0250; on texts of such characters NARROW is PIECES with plain ranges.
    LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
    NARROW = re.compile(f" ?[{LETTERS}]+| ?[{NUMBERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
    BEYOND = re.compile("[^\0-ɏ]")
    LIMIT = 800_000

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        split = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or any(split.get(k) != v for k, v in self.SPLITTER.items()):
            raise ValueError(f"{path} does not split texts as byte-level BPE does")
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = {k: np.array([i], "<u4").tobytes() for k, i in special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.model, self.alphabet = self.library.model, byte_alphabet()
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        return (self.PIECES if self.BEYOND.search(text) else self.NARROW).findall(text)

    def _learn(self, lists: list[list[str]]) -> None:
        if len(self.known) > self.LIMIT:
            self.known.clear()
        tokens = self.model.tokenize
        for p in set().union(*lists).difference(self.known):
            if len(p) < 1 << 12:
                ids = [t.id for t in tokens(p.encode().decode("latin-1").translate(self.alphabet))]
            else:  # without an object a token
                ids = self.library.encode(p, add_special_tokens=False).ids
            self.known[p] = array("I", ids).tobytes()

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, learning the new pieces of about a million characters at a time."""
        group, size = [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size >= 1 << 20:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        find, every, parts = self.pieces, [], []
        for t in texts:
            stretches = self.split.split(t) if self.split and "<|" in t else [t]
            pieces = [find(x) for x in stretches[::2]]
            every += pieces
            parts.append((pieces, stretches[1::2]))
        self._learn(every)
        known = self.known.__getitem__
        for pieces, specials in parts:
            out = b"".join(map(known, pieces[0]))
            for s, more in zip(specials, pieces[1:], strict=True):
                out += self.special[s] + b"".join(map(known, more))
            yield np.frombuffer(out, "<u4")


@lru_cache(maxsize=2)
def _byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def write_packed(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write files below ``folder`` (a URI all executors reach); returns the manifest, one row a file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _byte_bpe(tokenizer)
        width = max(1, (max(bpe.size, end_id + 1) - 1).bit_length())
        fs, base = pafs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        path = f"part-{part:06d}-{uuid.uuid4().hex}.ids"
        writer, out, end = None, None, np.array([end_id], "<u4")
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), bpe.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{path}")
                    writer = PackedWriter(out, width)
                writer.add(doc, np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "n_docs": len(writer.docs), "n_tokens": writer.n}], pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text").mapInArrow(write, MANIFEST), "packed-manifest")


def read_packed(manifest: DataFrame, folder: str) -> DataFrame:
    """Document, position of its first id over all files, count and checksum of its ids, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{base}/{row['path']}") as source:
                    f = PackedFile(source, source.size())
                    ends = np.append(f.starts[1:], f.n)
                    crc = np.empty(len(f.docs), np.int64)
                    i = 0
                    while i < len(f.docs):  # whole documents of about a megabyte of ids at a time
                        j = max(i + 1, int(np.searchsorted(ends, f.starts[i] + (1 << 18), "right")))
                        first = int(f.starts[i])
                        data = memoryview(f.ids(first, int(ends[j - 1]) - first).astype("<u4").tobytes())
                        for k in range(i, j):
                            crc[k] = zlib.crc32(data[4 * (int(f.starts[k]) - first) : 4 * (int(ends[k]) - first)])
                        i = j
                    yield pa.RecordBatch.from_arrays([pa.array(f.docs, mask=np.arange(len(f.docs)) < f.unnamed), pa.array(f.starts + row["base"]), pa.array(ends - f.starts), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a file
    files = max(1, manifest.count())  # a stated number of partitions: by default so small a table is put into one task, which would read all files
    named = manifest.select("path", before.alias("base")).repartition(files, "path")
    return named.mapInArrow(read, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "packed-ids")
    manifest = write_packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_packed(manifest, folder)
