"""Secret scans with multipart credential linking.

A scan of each text finds strong spans (assignments, access ids, long hex runs)
and parts that mean little alone: short access ids, random-looking strings and
endpoints. An interval join within scopes of a document then links parts; a
weak identifier or secret is reported only where a complementary part lies
within ``reach`` code points of it.

Defined results: null and empty texts have no spans. Rows that repeat an id, or have
none, are scanned and linked each by itself. A very long text is scanned by one task,
and its parts meet in bins of ``reach`` code points. Parts at equal places are listed
by kind. Offsets are code points, ends exclusive. An empty table gives no rows. Other
columns are not read, whatever their names (``redact_secrets`` returns them
unchanged).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import free_name, materialize

# What the base rules match.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")

WEAK_ACCESS = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AIDA|AROA)[A-Z0-9]{8,}")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"https?://[^\s\"'<>]+|\b(?:[a-z0-9-]+\.)+(?:amazonaws\.com|internal|local)\b(?::\d+)?", re.ASCII)

SPAN = "struct<start:int,rank:int,stop:int>"
SCHEMA = f"doc_id long, row long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<{SPAN}>, parts array<{SPAN}>"
KIND_ARRAY = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the strong spans, in order."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _random_looking(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s) and len(set(s)) >= 10


def weak_parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Parts that are reported only when linked. Without an identifier or endpoint nothing can be linked, so nothing is looked for."""
    ids = [(m.start(), 3, m.end()) for m in WEAK_ACCESS.finditer(text)] if any(k in text for k in ("AKIA", "ASIA", "AIDA", "AROA")) else []
    ends = [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)] if "://" in text or "amazonaws" in text or ".internal" in text or ".local" in text else []
    if not (ids or ends or any(r == 1 for _, r, _ in base)):
        return []
    secrets = [(m.start(), 4, m.end()) for m in WEAK_SECRET.finditer(text) if _random_looking(m[0])]
    found = sorted(ids + secrets + ends)
    kept, at = [], 0
    for s, r, e in found:  # what overlaps a strong span is reported already
        while at < len(base) and base[at][2] <= s:
            at += 1
        if at == len(base) or base[at][0] >= e:
            kept.append((s, r, e))
    return kept


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("stop", pa.int32())]))
    keys = ("start", "rank", "stop")
    for batch in batches:
        rows = []
        for text in batch.column(2).to_pylist():
            base = base_spans(text) if text else []
            said = ",".join(f"{KINDS[r]}:{s}:{e}" for s, r, e in base)
            counts = [sum(r == k for _, r, _ in base) for k in range(3)]
            parts = weak_parts(text, base) if text else []
            rows.append((*counts, hashlib.sha256(said.encode()).hexdigest(), [dict(zip(keys, x, strict=True)) for x in base], [dict(zip(keys, x, strict=True)) for x in parts]))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int64()] * 3 + [pa.string(), span, span]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "row", "n_assign", "n_access", "n_hex", "base_sha256", "base", "parts"])


def link_parts(scanned: DataFrame, reach: int = 256) -> DataFrame:
    """Interval join of weak parts with complementary parts of the same row: (doc_id, row, linked); ``scanned`` is written, so that rows keep their numbers.

    A weak identifier needs a secret (weak or strong), a weak secret needs an
    identifier or an endpoint, and an endpoint needs a secret, each within
    ``reach`` code points. Intervals meet in bins of ``reach`` code points of
    one document, so a bin holds a bounded number of parts, however long the
    document is.
    """
    all_parts = scanned.where(F.size("parts") > 0).select("doc_id", "row", F.explode(F.concat("base", "parts")).alias("p")).select("doc_id", "row", "p.*")
    role = F.when(F.col("rank").isin(1, 3), "id").when(F.col("rank") == 5, "end").otherwise("secret")
    all_parts = all_parts.withColumn("role", role)
    span = lambda low, high: F.explode(F.sequence(F.floor(F.greatest(low, F.lit(0)) / reach), F.floor(high / reach)))
    weak = all_parts.where("rank >= 3").withColumn("bin", span(F.col("start") - reach, F.col("stop") + reach))
    other = all_parts.select("row", F.col("start").alias("s2"), F.col("stop").alias("e2"), F.col("role").alias("role2")).withColumn("bin", span(F.col("s2"), F.col("e2")))
    near = (F.col("s2") <= F.col("stop") + reach) & (F.col("e2") >= F.col("start") - reach)
    fits = ((F.col("role") == "id") & (F.col("role2") == "secret")) | ((F.col("role") == "secret") & F.col("role2").isin("id", "end")) | ((F.col("role") == "end") & (F.col("role2") == "secret"))
    hits = weak.join(other, ["row", "bin"]).where(near & fits).select("doc_id", "row", "start", "rank", "stop").distinct()
    return hits.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "rank", "stop")).alias("linked"))


def scan_rows(rows: DataFrame, reach: int) -> DataFrame:
    """All spans of each row of ``rows`` (doc_id, row, text) as an array ``found``, with counts and digest of the base spans."""
    scanned = materialize(rows.mapInArrow(_scan, SCHEMA), "secret-scan")
    linked = link_parts(scanned, reach).drop("doc_id")
    every = F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(f"array<{SPAN}>"))))
    return scanned.join(linked, "row", "left").withColumn("found", every)


def secret_scan(docs: DataFrame, reach: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans as an array ``found`` and a string ``spans``."""
    out = scan_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text")), reach)
    said = F.transform("found", lambda x: F.concat_ws(":", F.element_at(F.expr(KIND_ARRAY), x["rank"] + 1), x["start"].cast("string"), x["stop"].cast("string")))
    return out.withColumn("spans", F.array_join(said, ",")).withColumn("n_linked", F.coalesce(F.size("linked"), F.lit(0)).cast("long")).drop("row")


def redact(text: F.Column, found: F.Column, mark: str = "[SECRET]") -> F.Column:
    """``text`` with each span of ``found`` (sorted, maybe overlapping) replaced by ``mark``."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    piece = lambda s, x: F.concat(s["out"], F.substr(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))
    step = lambda s, x: F.when(x["start"] >= s["at"], F.struct(piece(s, x).alias("out"), x["stop"].alias("at"))).otherwise(F.struct(s["out"].alias("out"), F.greatest(s["at"], x["stop"]).alias("at")))
    return F.aggregate(found, state, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.lit(2147483647) - s["at"])))


def redact_secrets(docs: DataFrame, reach: int = 256, text_col: str = "text") -> DataFrame:
    """All rows of ``docs``, in all their columns, with their secrets replaced; texts without any stay as they are.

    Texts are told apart by two hashes of 64 bits; equal texts have equal spans.
    """
    one, two, spans = (free_name(docs.columns, c) for c in ("key_", "key2_", "spans_"))
    text = F.col(text_col).cast("string")
    keyed = docs.withColumns({one: F.xxhash64(text), two: F.xxhash64(F.lit(1), text)})
    distinct = keyed.where(text.isNotNull()).select(F.col(one).alias("doc_id"), F.col(two).alias("row"), text.alias("text"))
    scanned = materialize(distinct.mapInArrow(_scan, SCHEMA).where("size(base) > 0 or size(parts) > 0").dropDuplicates(["doc_id", "row"]), "secret-scan")
    linked = link_parts(scanned, reach)
    every = F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(f"array<{SPAN}>"))))
    found = scanned.join(linked, ["doc_id", "row"], "left").select(F.col("doc_id").alias(one), F.col("row").alias(two), every.alias(spans)).where(F.size(spans) > 0)
    marked = keyed.join(found, [one, two], "left")
    clean = F.when(F.col(spans).isNotNull(), redact(text, F.col(spans))).otherwise(F.col(text_col))
    return marked.withColumn(text_col, clean).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return secret_scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked")
