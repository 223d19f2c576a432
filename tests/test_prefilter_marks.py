"""Articles whose whole texts are tested in one pass, against SQL over the same odd texts."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from marlstone.plans import screening

TEXTS = [
    "央行公告。今日降息5%", "央行公告。今日降息5%", "央行公告. 今日降息5%，裁员", "", "", None, ".", "short", "Podcast", "x" * 79, "x" * 80, "y" * 44,
    "Bank of x. They merge and raise 5% on 3月4日", "Bank of x. They merge and raise 6% on 3月4日", "Bank of x. They merge and raise 6% on 3月4日", "LİSTİNG of a firm that is longer than eighty characters, with no number in it, so that it isn't cut short at all",
    "三 家银行" * 30, "三" * 60, "据新华社：" + "的" * 90, "Sponsored. " + "a rate decision " * 20, "ſponsored. " + "nothing much " * 20, "buy\nnow " * 30, "可能 maybe " * 20, "可能" * 50, "t" * 121 + ". more 1", "a+b. C++ rates " * 10,
    *("Same title. " + "word " * k for k in range(14)),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    n = len(TEXTS)
    rows = {"doc_id": list(range(n)), "text": TEXTS, "lang": ["en"] * n, "source": [("src1", "Fed wire", "src2")[k % 3] for k in range(n)], "n_chars": [len(t or "") for t in TEXTS]}
    pq.write_table(pa.table(rows, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])), path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(range(0, n, 2), pa.int64()), "quality": pa.array([k % 2 for k in range(0, n, 2)], pa.int64()), "toxic": pa.array([0] * len(range(0, n, 2)), pa.int64())}), path / "labels.parquet")
    return path


@pytest.mark.parametrize("few", [0, 100_000])
def test_odd_texts_are_decided_as_by_sql(spark, folder, few, monkeypatch):
    monkeypatch.setattr(screening, "FEW", few)
    got = sorted(map(tuple, screening.QUERIES["prefilter_decision"](spark, str(folder)).collect()))
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = sorted(con.execute(screening.ORACLES["prefilter_decision"]).fetchall())
    assert got == want and {r[-1] for r in want} >= {"score", "drop", "inherit"} and {r[4] for r in want} >= {None, "incomplete"}


def test_a_text_is_tested_once_where_it_is_read(spark, folder):
    plan = screening.QUERIES["prefilter_decision"](spark, str(folder))._jdf.queryExecution().optimizedPlan().toString()
    assert "low_body" not in plan
