"""Digests one after the other, over breaks and repeats; replies cleaned, by hand."""

import json

import pytest

from marlstone.operators import digest_runs as ops

KINDS = "id long, related_to_id long, source string, published long, ai_score double, status string"


def articles(spark, rows):
    return spark.createDataFrame(rows, KINDS)


ROWS = [(1, None, "a", 5, 9.0, "new"), (2, 1, "a", 12, 3.0, "new"), (3, 1, "b", 22, 3.0, "new"), (4, None, "a", 15, 5.0, "resolved"), (5, 4, "a", 25, 5.0, "new"), (6, None, "c", 28, 6.0, "new")]


def told(spark, folder):
    return sorted((r[ops.END], r.event_id, r.version, r.section) for r in ops.links(spark, folder).collect())


def test_no_gap_and_nothing_twice(spark, tmp_path):
    folder, df = str(tmp_path), articles(spark, ROWS)
    assert [ops.run(df, folder, end, 0) for end in (10, 20, 30)] == [0, 10, 20]
    assert told(spark, folder) == [(10, 1, 1, "must_know"), (20, 4, 1, "worth_watching"), (30, 1, 2, "must_know"), (30, 4, 1, "worth_watching"), (30, 6, 1, "worth_watching")]
    assert [(r.event_id, r[ops.END]) for r in spark.read.parquet(f"{folder}/quiet").collect()] == [(1, 20)]  # it had to be known, and its second article is of the same source
    ends = sorted((r.start, r[ops.END], r.articles) for r in spark.read.parquet(f"{folder}/ends").collect())
    assert ends == [(0, 10, 1), (10, 20, 2), (20, 30, 3)]
    assert ops.run(df, folder, 20, 0) is None and len(told(spark, folder)) == 5


def test_a_run_that_breaks_off_is_done_again(spark, tmp_path, monkeypatch):
    folder, df = str(tmp_path), articles(spark, ROWS)
    ops.run(df, folder, 10, 0)
    put = ops._put
    monkeypatch.setattr(ops, "_put", lambda frame, path, end: 1 / 0 if path.endswith("ends") else put(frame, path, end))
    with pytest.raises(ZeroDivisionError):
        ops.run(df, folder, 20, 0)
    monkeypatch.undo()
    assert told(spark, folder) == [(10, 1, 1, "must_know")]  # links without an end do not count
    assert ops.run(df, folder, 30, 0) == 10  # the missed period is part of the next
    assert [x[1:3] for x in told(spark, folder) if x[0] == 30] == [(1, 2), (4, 1), (6, 1)]


def test_empty_periods_and_limits(spark, tmp_path):
    folder, df = str(tmp_path), articles(spark, ROWS)
    ops.run(df, folder, 3, 0)
    assert told(spark, folder) == [] and spark.read.parquet(f"{folder}/ends").count() == 1
    ops.run(df, folder, 30, 0, most=1)
    assert [x[1] for x in told(spark, folder)] == [1]


def test_replies_tell_only_what_was_sent(spark):
    entry = {"event_id": "7", "title": "t" * 300, "latest_change": "c", "confidence": "certain", "extra": 1}
    good = {"period_summary": "s", "must_know": [entry, entry | {"event_id": 99}, None], "worth_watching": [{"event_id": 8, "confidence": "low"}], "cross_event_signals": [{"title": "x", "event_ids": ["7", "99", "8"]}, {"summary": "no title"}]}
    replies = [(1, "```json\n" + json.dumps(good) + "\n```"), (2, json.dumps(good | {"period_summary": ""})), (3, "no json"), (4, None)]
    sent = spark.createDataFrame([(d, e) for d in (1, 2, 3, 4) for e in (7, 8)], "digest long, event_id long")
    df = spark.createDataFrame(replies, "digest long, reply string")
    got = sorted(tuple(r) for r in ops.clean_entries(df, sent).select("digest", "section", "event_id", "confidence", "latest_change", "why_important").collect())
    assert got == [(1, "must_know", 7, "medium", "c", ""), (1, "worth_watching", 8, "low", "", "")]
    assert {len(r.title) for r in ops.clean_entries(df, sent).collect()} == {200, 0}
    assert [tuple(r) for r in ops.clean_signals(df, sent).collect()] == [(1, 0, "x", "", [7, 8])]
