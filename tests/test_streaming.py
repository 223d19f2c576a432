import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlstone.session import table
from marlstone.streaming.windows import committed, daily_counters, recent, unseen

SF = "/root/testdata/sf0.001"


def drained(df, name, mode):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        query.processAllAvailable()
        return df.sparkSession.table(name).collect()
    finally:
        query.stop()


def test_streams_match_batches(spark):
    events = table(spark, SF, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    want = {(str(r[0])[:10], r[1]): r[2] for r in events.selectExpr("cast(ts as date) d", "event_type").groupBy("d", "event_type").count().collect()}
    got = {(str(r["date"]), r["metric"]): r["value"] for r in drained(daily_counters(stream, "event_type"), "counters", "complete")}
    assert got == want
    users = drained(unseen(stream, "user_id", horizon="3650 days").select("user_id"), "users", "append")
    assert len(users) == events.select("user_id").distinct().count()


def test_old_rows_go_and_untimed_ones_stay(spark):
    now = dt.datetime(2024, 1, 10)
    rows = [(1, now), (2, now - dt.timedelta(days=7)), (3, now - dt.timedelta(days=7, seconds=1)), (4, None), (5, now + dt.timedelta(days=1))]
    df = spark.createDataFrame(rows, "id long, ts timestamp")
    assert sorted(r.id for r in recent(df, now=F.lit(now)).collect()) == [1, 2, 4, 5]


def test_a_batch_counts_once_its_write_has_succeeded(spark, tmp_path, monkeypatch):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    add = lambda lo, hi: spark.range(lo, hi).write.mode("append").parquet(source)

    def drain():
        committed(spark.readStream.schema("id long").parquet(source), out, check).awaitTermination()

    add(0, 50)
    drain()
    drain()  # nothing new
    add(50, 80)
    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.parquet", lambda *a, **k: 1 / 0)
    with pytest.raises(Exception, match="ZeroDivisionError"):
        drain()
    monkeypatch.undo()
    drain()  # the failed batch comes again
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(80))
