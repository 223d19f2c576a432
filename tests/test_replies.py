"""Replies and snapshots by hand."""

import datetime as dt
import json

from marlstone.operators import folds
from marlstone.plans import replies, snapshots
from marlstone.sources import sinks

ITEM = {"score": 9, "is_highlight": True, "tags": ["a", 1, " ", " b ", "c", "d", "e", "f"], "chinese_title": "利" * 70, "chinese_summary": "s", "why_it_matters": "w"}


def run(spark, reply, n=4, **options):
    sent = spark.createDataFrame([(1, i) for i in range(1, n + 1)], "batch_id long, id long")
    got = replies.validate(sent, spark.createDataFrame([(1, reply)], "batch_id long, reply string"), **options).collect()
    return {r.id: r for r in got}


def test_fields_of_a_scored_item(spark):
    r = run(spark, json.dumps([ITEM | {"id": "2"}]))[2]
    assert (r.verdict, r.score, r.is_highlight, r.tags, r.title, r.summary, r.why, r.n_given) == ("scored", 9, True, "a,b,c,d,e", "利" * 60, "", "w", 1)
    r = run(spark, json.dumps([{"id": 1, "score": 8.9, "is_highlight": "yes", "chinese_title": 5, "chinese_summary": "央行" * 14 + "降，。" + "x" * 300}]))[1]
    assert (r.score, r.is_highlight, r.title, len(r.summary)) == (8, True, "央行" * 14 + "降", 200)
    r = run(spark, json.dumps([{"id": 1, "score": 12, "is_highlight": 1, "tags": "x", "summary": "plain"}]), chinese=False)[1]
    assert (r.score, r.is_highlight, r.tags, r.title, r.summary) == (10, False, "", "", "plain")


def test_every_item_sent_has_a_verdict(spark):
    reply = [7, "x", None, ITEM | {"id": 9}, ITEM | {"id": "one"}, ITEM | {"id": 1.0}, ITEM | {"id": 2, "score": "bad"}, ITEM | {"id": 2}, ITEM | {"id": 3, "score": "7.9"}, {"id": 4}]
    got = run(spark, json.dumps(reply), 5)
    assert {i: r.verdict for i, r in got.items()} == {1: "missing", 2: "score", 3: "score", 4: "below", 5: "missing"}
    assert got[2].n_given == 2 and got[2].score is None


def test_wrapped_and_broken_replies(spark):
    one = ITEM | {"id": 1}
    for reply in ([one], {"results": [one]}, {"data": [one]}, {"x": one, "y": ITEM | {"id": 2}}):
        assert run(spark, json.dumps(reply))[1].verdict == "scored"
    for reply in ("", "nothing", json.dumps([one]) + " and more", json.dumps({"x": [one]}), json.dumps(one)[:-1], "null", None):
        assert {r.verdict for r in run(spark, reply).values()} == {"missing"}
    assert run(spark, json.dumps([ITEM | {"id": 1, "score": 4}]))[1].verdict == "below"
    assert run(spark, json.dumps([ITEM | {"id": 1, "score": 4}]), least=4)[1].is_highlight is False


def bars(spark, rows):
    return spark.createDataFrame(rows, "code long, trade_date date, close decimal(18,2)")


def test_steps_equal_the_history(spark, tmp_path):
    from decimal import Decimal

    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(30)]
    rows = [(c, d, Decimal(100 + c + (k * 7 * c) % 13)) for c in (1, 2, 3) for k, d in enumerate(days) if c != 3 or k != 27]
    path = str(tmp_path / "ema")
    assert snapshots.latest(spark, path) is None
    snapshots.save(folds.ema(bars(spark, [r for r in rows if r[1] < days[25]]), digits=None), path, days[24])
    for k in (25, 26, 27, 28, 29):
        before = snapshots.latest(spark, path).drop(snapshots.DAY)
        snapshots.save(snapshots.step(before, bars(spark, [r for r in rows if r[1] == days[k]])), path, days[k])
        snapshots.save(snapshots.step(before, bars(spark, [r for r in rows if r[1] == days[k]])), path, days[k])  # a day run again
    got = {r.code: [round(r[c], 9) for c in snapshots.ema_columns()] for r in snapshots.latest(spark, path).collect()}
    want = {r.code: [round(r[c], 9) for c in snapshots.ema_columns()] for r in folds.ema(bars(spark, rows), digits=None).collect()}
    assert got == want and len(got) == 3
    assert spark.read.parquet(path).select(snapshots.DAY).distinct().count() == 6


def test_a_run_without_rows_clears_its_partition(spark, tmp_path):
    path, log = str(tmp_path / "list"), str(tmp_path / "runs")
    put = lambda rows, run: sinks.replace_partition(spark.createDataFrame(rows, "code long, day string, market string"), path, log, run, day="d1", market="US")
    put([(1, "d1", "US"), (2, "d1", "US")], "r1")
    sinks.replace_partition(spark.createDataFrame([(9, "d1", "HK")], "code long, day string, market string"), path, log, "r2", day="d1", market="HK")
    put([(3, "d1", "US")], "r3")
    assert {(r.code, r.market) for r in spark.read.parquet(path).collect()} == {(3, "US"), (9, "HK")}
    put([], "r4")
    assert {r.code for r in spark.read.parquet(path).collect()} == {9}
    assert {(r.run_id, r.n_rows) for r in spark.read.parquet(log).collect()} == {("r1", 2), ("r2", 1), ("r3", 1), ("r4", 0)}


def test_the_last_incoming_row_of_a_key_counts(spark):
    stored = spark.createDataFrame([(1, "a", "old"), (2, "b", "old")], "k long, v string, note string")
    incoming = spark.createDataFrame([(1, "x", "", 5), (1, "y", None, 7), (1, "z", "n", 6), (3, "c", "new", 1)], "k long, v string, note string, seq int")
    got = {r.k: (r.v, r.note) for r in sinks.upsert(stored, incoming, ["k"], keep_old=("note",), order="seq").collect()}
    assert got == {1: ("y", "n"), 2: ("b", "old"), 3: ("c", "new")}
    again = {r.k: (r.v, r.note) for r in sinks.upsert(stored, incoming.repartition(3), ["k"]).collect()}
    assert again == {r.k: (r.v, r.note) for r in sinks.upsert(stored, incoming.orderBy("seq"), ["k"]).collect()}
