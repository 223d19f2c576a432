"""WARC archives as a PySpark data source, and pages deduplicated into revisits.

The reader plans one partition a file. It parses the headers of a record first,
tests record type and other header predicates on them, and decodes a payload
only if the record is wanted and the option ``payload`` asks for it ("full",
"digest" or "none"). Compressed files have one gzip member a record; the writer
notes a member's size in the gzip extra field "SL", so that an unwanted member
is skipped without inflating it. Members without that field are inflated, and may
hold several records.

The writer streams one file a task and commits by naming its files in
``_manifest.json``, to which the mode "append" adds and which "overwrite" replaces;
without one, all ``*.warc`` and ``*.warc.gz`` files count.

Defined results: a null html counts as empty, a null url is left out of the
record. Of pages with equal payloads of at least ``least_bytes`` bytes the one
with the smallest id is the response (rows that repeat that id are responses
too); a page with a null id is always a response, never a target. A very long
payload is held whole by the task that writes or reads it. An empty table writes no
file and reads back empty. Other columns of the pages are not read, whatever their
names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from marlstone.llm.common import fresh_path

SCHEMA = "record_type string, record_id string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary"
ARROW = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
#: What the writer takes; ``payload_sha1`` in hex.
INPUT = ("page_id", "url", "html", "payload_sha1", "record_type", "refers_to")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER_LIMIT = 1 << 20


def record_urn(page_id: int | None, salt: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}{salt}')}>"


def render(page_id, url, html, sha1: str, kind, refers_to, date: str) -> bytes:
    """One record, uncompressed."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    payload = (html or "").encode("utf-8", "replace")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_urn(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 3) -> bytes:
    """A gzip member with its own size in the extra field "SL" (0: too large to say)."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    size = 10 + 2 + 12 + len(body) + 8
    fits = size < 1 << 32 and len(data) < 1 << 32
    extra = b"SL" + struct.pack("<HII", 8, size if fits else 0, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def manifest(fs: pafs.FileSystem, base: str) -> list[str] | None:
    """Names of the committed files, if any commit was made."""
    if fs.get_file_info(f"{base}/_manifest.json").type != pafs.FileType.File:
        return None
    with fs.open_input_stream(f"{base}/_manifest.json") as f:
        return json.loads(f.read())


@dataclass
class Files(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool = False) -> None:
        self.folder, self.gz, self.overwrite = options["path"], options.get("compression", "gzip") == "gzip", overwrite
        self.date = options.get("date", "2024-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = pafs.FileSystem.from_uri(self.folder)
        name, out = f"{uuid.uuid4().hex}.warc{'.gz' * self.gz}", None
        for batch in iterator:
            for row in zip(*(batch.column(c).to_pylist() for c in INPUT), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20)
                record = render(*row, self.date)
                out.write(gzip_member(record) if self.gz else record)
        if out is None:
            return Written([])
        out.close()
        return Written([name])

    def commit(self, messages: list) -> None:
        fs, base = pafs.FileSystem.from_uri(self.folder)
        fs.create_dir(base, recursive=True)
        new = {f for m in messages if m for f in m.files}
        before = set() if self.overwrite else set(manifest(fs, base) or ())
        with fs.open_output_stream(f"{base}/_manifest.json") as out:
            out.write(json.dumps(sorted(before | new)).encode())


class _Inflated(io.RawIOBase):
    """One gzip member as a stream that inflates only what is read."""

    def __init__(self, source) -> None:
        super().__init__()
        self.source, self.begin = source, source.tell()
        head = source.read(12)
        self.size = 0
        if head[3] & 4 and source.read(2) == b"SL":
            _, self.size, _ = struct.unpack("<HII", source.read(10))
        source.seek(self.begin)
        self.machine, self.data = zlib.decompressobj(31), b""

    def more(self, n: int) -> bytes:
        while len(self.data) < n and not self.machine.eof:
            raw = self.machine.unconsumed_tail or self.source.read(4096 if n <= HEADER_LIMIT and not self.data else 65536)
            if not raw:
                raise EOFError("a gzip member ends early")
            self.data += self.machine.decompress(raw, max(4096, n - len(self.data)))
        return self.data

    def following(self) -> _Inflated | None:
        """Skips the record; this member again if it holds another."""
        if self.size:
            self.source.seek(self.begin + self.size)
            return None
        left = self.end
        while left:
            self.more(min(left, 1 << 20))
            if not self.data:
                raise EOFError("a record ends early")
            gone = min(left, len(self.data))
            self.data, left = self.data[gone:], left - gone
        if self.more(1):
            return self
        self.source.seek(self.source.tell() - len(self.machine.unused_data))
        return None


class _Plain:
    """An uncompressed record."""

    def __init__(self, source) -> None:
        self.source, self.begin, self.data, self.end = source, source.tell(), b"", None

    def more(self, n: int) -> bytes:
        if len(self.data) < n:
            self.data += self.source.read(n - len(self.data))
        return self.data

    def following(self) -> None:
        self.source.seek(self.begin + self.end)


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _until(record, mark: bytes, start: int) -> int:
    """Position after the next ``mark``."""
    n = start + 1024
    while (at := (data := record.more(n)).find(mark, start)) < 0:
        if len(data) < n or n - start > HEADER_LIMIT:
            raise ValueError("a record has no end of its headers")
        n *= 2
    return at + len(mark)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.payload = options["path"], options.get("payload", "full")
        self.wanted: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes predicates on what the headers say; others go back to Spark."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column not in ("record_type", "record_id", "target_uri", "page_id", "refers_to"):
                yield f
            elif isinstance(f, EqualTo):
                self.wanted.append((column, "in", (f.value,)))
            elif isinstance(f, In):
                self.wanted.append((column, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.wanted.append((column, "starts", f.value))
            elif isinstance(f, IsNotNull):
                self.wanted.append((column, "known", None))
            else:
                yield f

    def _fits(self, row: dict) -> bool:
        for column, test, value in self.wanted:
            x = row[column]
            if x is None or test == "in" and x not in value or test == "starts" and not x.startswith(value):
                return False
        return True

    def partitions(self) -> list[Files]:
        fs, base = pafs.FileSystem.from_uri(self.folder)
        known = manifest(fs, base)
        names = [f"{base}/{n}" for n in known] if known is not None else sorted(i.path for i in fs.get_file_info(pafs.FileSelector(base)) if i.path.endswith((".warc", ".warc.gz")))
        return [Files(n) for n in names] or [Files("")]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in self._records(partition.path) if partition.path else ():
            rows.append(row)
            held += len(row["payload"] or b"") + 200
            if held > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def _records(self, path: str) -> Iterator[dict]:
        fs, _ = pafs.FileSystem.from_uri(self.folder)
        with fs.open_input_file(path) as f:
            size, source = f.size(), io.BufferedReader(f, 1 << 20)
            kind, record = _Inflated if path.endswith(".gz") else _Plain, None
            while record or source.tell() < size:
                record = record or kind(source)
                body = _until(record, b"\r\n\r\n", 0)
                h = _headers(record.more(body)[:body])
                length = int(h["content-length"])
                record.end = body + length + 4
                number = lambda k: int(h[k]) if k in h else None  # noqa: E731, B023
                row = {"record_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri"), "page_id": number("x-page-id"), "refers_to": number("x-refers-to-page-id"), "payload_bytes": None, "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None, "payload": None}
                if self._fits(row):
                    self._block(record, row, body, length, h)
                    yield row
                record = record.following()

    def _block(self, record, row: dict, body: int, length: int, h: dict) -> None:
        start = body
        if h.get("content-type", "").startswith("application/http"):
            start = _until(record, b"\r\n\r\n", body)
            row["payload_bytes"] = int(_headers(record.more(start)[body:start]).get("content-length", body + length - start))
        else:
            row["payload_bytes"] = length
        if self.payload != "none" and row["record_type"] == "response":
            payload = bytes(record.more(body + length)[start : body + length])
            row["payload_digest"], row["payload_bytes"] = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
            row["payload"] = payload if self.payload == "full" else None


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``; the folder is a URI that driver and executors reach."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_pages(pages: DataFrame, folder: str, least_bytes: int = 0, compression: str = "gzip", mode: str = "append") -> None:
    """Write a record a row of ``pages`` (page_id, url, html) below ``folder``, repeats of a payload as revisits."""
    spark = pages.sparkSession
    register(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("n", F.octet_length("html"))
    first = rows.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"))  # partial sums of a hot payload meet here, not its rows
    repeat = F.col("page_id").isNotNull() & (F.col("page_id") > F.col("first"))
    marked = rows.join(first, "digest", "left").withColumn("revisit", F.coalesce(repeat, F.lit(False)))
    out = marked.select(
        "page_id",
        "url",
        "html",
        F.col("digest").alias("payload_sha1"),
        F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"),
        F.when(F.col("revisit"), F.col("first")).alias("refers_to"),
    )
    out.write.format("warc").mode(mode).option("compression", compression).save(folder)


def read_warc(spark: SparkSession, folder: str, payload: str = "full") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", payload).load(folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    back = read_warc(spark, folder, payload="digest").where(F.col("record_type").isin("response", "revisit"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
