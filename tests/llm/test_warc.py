import base64
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from marlstone.llm.common import fresh_path
from marlstone.llm.warc import gzip_member, read_warc, render, write_pages

PAGES = [(1, "http://a/é x", "<p>é</p>"), (2, None, None), (3, "http://b", "<p>é</p>"), (0, "http://c", ""), (5, "http://d", "x" * 100_000), (6, "http://e", "x" * 100_000), (7, "http://f", "y\r\n\r\nz")]


def brute(pages, least):
    first = {}
    for p, _, h in pages:
        first[h or ""] = min(first.get(h or "", p), p)
    out = []
    for p, _, h in pages:
        b = (h or "").encode()
        again = len(b) >= least and first[h or ""] != p
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out)


def results(df):
    return sorted(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


@pytest.mark.parametrize(("compression", "least"), [("gzip", 0), ("none", 0), ("gzip", 5)])
def test_round_trip(spark, compression, least):
    folder = fresh_path(spark, "warc-test")
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, record_type string").repartition(3)
    write_pages(df, folder, least, compression)
    back = read_warc(spark, folder)
    assert results(back) == brute(PAGES, least)
    got = {r.page_id: bytes(r.payload).decode() for r in back.where("record_type = 'response'").collect()}
    assert got == {p: h or "" for p, _, h in PAGES if p in got}
    assert results(read_warc(spark, folder, "digest")) == brute(PAGES, least)


@pytest.mark.parametrize("suffix", [".warc", ".warc.gz"])
def test_predicates_skip_payloads(spark, tmp_path, suffix):
    """A damaged payload does not matter to a reader that does not want the record."""
    good = render(1, "http://a", "fine", "aa", "revisit", 9, "2024-01-01T00:00:00Z")
    bad = render(2, "http://b", "z" * 50_000, "bb", "response", None, "2024-01-01T00:00:00Z")
    if suffix.endswith("gz"):
        good, bad = gzip_member(good), bytearray(gzip_member(bad))
        bad[-30:-8] = b"\xff" * 22
    (tmp_path / f"x{suffix}").write_bytes(bytes(bad) + good + bytes(bad))
    back = read_warc(spark, f"file://{tmp_path}", "full").where("record_type = 'revisit' and page_id in (1, 4)")
    assert [(r.page_id, r.refers_to) for r in back.collect()] == [(1, 9)]


def test_foreign_members_without_sizes(spark, tmp_path):
    import gzip

    data = b"".join(gzip.compress(render(i, "http://a", f"page {i}" * 500, "cc", "response", None, "2024-01-01T00:00:00Z")) for i in range(5))
    (tmp_path / "x.warc.gz").write_bytes(data)
    back = read_warc(spark, f"file://{tmp_path}").where(F.col("page_id").isin(1, 3)).collect()
    assert sorted(bytes(r.payload).decode() for r in back) == ["page 1" * 500, "page 3" * 500]


def test_member_with_many_records(spark, tmp_path):
    import gzip

    records = [render(i, "http://a", f"page {i}" * 500, "cc", "response", None, "2024-01-01T00:00:00Z") for i in range(5)]
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(b"".join(records[:3])) + gzip_member(records[3]) + gzip.compress(records[4]))
    back = read_warc(spark, f"file://{tmp_path}")
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in back.collect()) == [(i, f"page {i}" * 500) for i in range(5)]
    assert [r.page_id for r in back.where("page_id = 2").collect()] == [2]


def test_append_adds_and_overwrite_replaces(spark):
    folder = fresh_path(spark, "warc-test")
    one = lambda i: spark.createDataFrame([(i, "http://a", f"page {i}")], "page_id long, url string, html string")
    write_pages(one(1), folder)
    write_pages(one(2), folder)
    assert sorted(r.page_id for r in read_warc(spark, folder).collect()) == [1, 2]
    write_pages(one(3), folder, mode="overwrite")
    assert [r.page_id for r in read_warc(spark, folder).collect()] == [3]


def test_null_ids_and_repeated_rows(spark):
    folder = fresh_path(spark, "warc-test")
    rows = [(None, None, "same"), (None, None, "same"), (4, "u", "same"), (4, "u", "same"), (9, "u", "same"), (9, "u", "same")]
    write_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    got = [(r.page_id, r.record_type, r.refers_to) for r in read_warc(spark, folder, "digest").collect()]
    assert sorted(got, key=str) == sorted([(None, "response", None)] * 2 + [(4, "response", None)] * 2 + [(9, "revisit", 4)] * 2, key=str)


def test_empty_table(spark):
    folder = fresh_path(spark, "warc-test")
    write_pages(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert read_warc(spark, folder).count() == 0
    assert os.path.exists(folder.removeprefix("file://"))
