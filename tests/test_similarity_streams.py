"""Similarity state in streams against plain loops, over restarts."""

import random

import numpy as np

from marlstone.plans.refinement import FAR, masks
from marlstone.streaming import similarity

HOUR = 3600


def articles(n, seed):
    rnd = random.Random(seed)
    base = [(rnd.getrandbits(32), rnd.getrandbits(32)) for _ in range(6)]
    out, at = [], 1704067200
    for i in range(n):
        hi, lo = rnd.choice(base)
        for _ in range(rnd.randrange(5)):
            bit = rnd.randrange(64)
            hi, lo = (hi ^ 1 << bit - 32, lo) if bit >= 32 else (hi, lo ^ 1 << bit)
        at += rnd.randrange(2 * HOUR)
        out.append((i, at, hi, lo))
    return out


def linked(rows, keep):
    """Links of each article with the first of each near fingerprint of the last ``keep`` seconds."""
    found, held = {}, []
    for i, at, hi, lo in rows:
        held = [e for e in held if at - e[1] <= keep]
        for o, _, h, low in held:
            far = (hi ^ h).bit_count() + (lo ^ low).bit_count()
            if far <= FAR:
                found[o, i] = far
        if not any((hi, lo) == e[2:] for e in held):
            held.append((i, at, hi, lo))
    return found


def test_fingerprints_over_restarts(spark, tmp_path):
    rows, path, out, check = articles(60, 1), *(str(tmp_path / n) for n in ("in", "out", "check"))
    decisions, state = str(tmp_path / "decisions"), str(tmp_path / "decisions-state")
    kinds = "id long, at long, hi long, lo long"
    for k in range(0, 60, 20):  # each time a new query, which goes on from the state of the one before
        spark.createDataFrame(rows[k : k + 20], kinds).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(kinds).parquet(path)
        similarity.run_to_table(similarity.near_fingerprints(stream, masks(), FAR), out, check).awaitTermination()
        links = spark.readStream.schema(similarity.LINK).parquet(f"{out}/batch=*")
        similarity.run_to_table(links, decisions, state, decide=True).awaitTermination()
    want = linked(rows, similarity.DAY)
    got = [(r.older, r.newer, r.distance) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted((a, b, float(d)) for (a, b), d in want.items()) and len(want) > 30
    assert any((a < 20) != (b < 20) for a, b in want) and any(b - a > 3 for a, b in want)
    gone = set()
    for i in range(60):
        if any(a not in gone for a, b in want if b == i):
            gone.add(i)
    kept = {r.id: r.kept for r in spark.read.parquet(decisions).collect()}
    assert {i for i, k in kept.items() if not k} == gone and set(kept) == {b for _, b in want}


def test_vectors_of_the_last_90_minutes(spark, tmp_path):
    rng = np.random.default_rng(2)
    base, rows, at = rng.standard_normal((5, 16)), [], 0
    for i in range(50):
        at += int(rng.integers(600))
        rows.append((i, at, [float(v) for v in base[i % 5] + 0.5 * rng.standard_normal(16)]))
    path, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    kinds = "id long, at long, embedding array<double>"
    for part in (rows[:25], rows[25:]):
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(kinds).parquet(path)
        similarity.run_to_table(similarity.near_vectors(stream, 0.67, 16, tables=30, bits=4), out, check).awaitTermination()
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    want = {(i, j) for i, s, _ in rows for j, t, _ in rows if i < j and t - s <= similarity.SHORT and unit[i] @ unit[j] > 0.67}
    got = [(r.older, r.newer) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.95 * len(want) and len(want) > 30


def test_what_is_remembered_is_bounded():
    class State:
        hasTimedOut, exists, get = False, False, None

        def update(self, value):
            self.exists, self.get = True, value

        def setTimeoutDuration(self, ms):
            self.timeout = ms

        def remove(self):
            self.exists = False

    import pandas as pd

    kept = np.dtype([("id", "<i8"), ("at", "<i8")])
    run = similarity._remembering(kept, 100, lambda key, row, held: (np.arange(0), np.arange(0), True))
    state = State()
    for at in range(0, 5000, 10):
        list(run((0,), iter([pd.DataFrame({"id": [at], "at": [at]})]), state))
        assert len(state.get[0]) <= 11 * kept.itemsize and state.timeout == 100_000
    state.hasTimedOut = True
    list(run((0,), iter([]), state))
    assert not state.exists


def test_late_articles_and_bounded_keys(spark, tmp_path):
    """Keys are shares of the blocks' values, not the values themselves; what comes late still meets what came before it."""
    rows = articles(90, 4)
    late = set(range(25, 32)) | {50}
    triggers = [[r for r in rows[:60] if r[0] not in late], [r for r in rows if r[0] in late or r[0] >= 60]]
    path, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    kinds = "id long, at long, hi long, lo long"
    for part in triggers:
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(kinds).parquet(path)
        query = similarity.run_to_table(similarity.near_fingerprints(stream, masks(), FAR, keep=20 * similarity.DAY, shares=2), out, check)
        query.awaitTermination()
        assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * len(masks())
    want, held = {}, []
    for i, at, hi, lo in (r for part in triggers for r in part):
        there = [e for e in held if at - e[1] <= 20 * similarity.DAY]
        for o, then, h, low in there:
            far = (hi ^ h).bit_count() + (lo ^ low).bit_count()
            if far <= FAR:
                first, last = sorted([(then, o), (at, i)])
                want[first[1], last[1]] = float(far)
        if not any((hi, lo) == e[2:] for e in there):
            held.append((i, at, hi, lo))
    got = [(r.older, r.newer, r.distance) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted((*k, d) for k, d in want.items()) and any(j in late or i in late for i, j in want)
