"""Similar articles in streams: keyed state that forgets, and decisions that each batch adds to.

An article's fingerprint goes to one key for each pair of equal blocks, a share of the
blocks' values; a key's state holds the fingerprints met there, each with its first
article. Vectors go to one key a table of signatures. Entries that are too old for a new
article are dropped, and a key that has met none for as long times out, so state is
bounded by what arrives within that time. A link is told once, under the first key both
have.
``settled`` takes the links of a batch and the decisions of those before, and decides
which of the batch's articles stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlstone.operators.dedup import dropped

#: Seconds that fingerprints and vectors are remembered.
DAY, SHORT = 24 * 3600, 90 * 60
EMPTY = "spark.sql.streaming.noDataMicroBatches.enabled"
LINK = "older long, newer long, distance double"


def _remembering(kept: np.dtype, keep: int, compare):
    """A function of a key's rows and state. ``kept`` has fields id and at; entries over ``keep`` seconds older than a row are dropped, and a key that has met no row for as long is forgotten.

    ``compare(key, row, held)`` gives the places in ``held`` that the row has a link to, their distances, and whether the row is remembered.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = np.frombuffer(state.get[0], kept) if state.exists else np.empty(0, kept)
        fresh = pd.concat(list(batches)).sort_values(["at", "id"])  # this trigger's rows of one key
        found: list[tuple] = []
        for row in fresh[list(kept.names)].itertuples(index=False):
            held = held[row.at - held["at"] <= keep]
            at, far, remembered = compare(key, row, held)
            for i, x in zip(at.tolist(), far.tolist(), strict=True):
                other = held[i]
                first, last = sorted([(int(other["at"]), int(other["id"])), (int(row.at), int(row.id))])
                if first[1] != last[1]:
                    found.append((first[1], last[1], float(x)))
            if remembered:
                held = np.append(held, np.array([tuple(row)], kept))
        state.update((held.tobytes(),))
        state.setTimeoutDuration(keep * 1000)
        yield pd.DataFrame(found, columns=["older", "newer", "distance"])

    return run


FACE = np.dtype([("kh", "<i8"), ("kl", "<i8"), ("hi", "<i8"), ("lo", "<i8"), ("id", "<i8"), ("at", "<i8")])
#: Shares that the values of a pair of blocks are dealt into, and pairs compared at a time: a key a value would be a group and a state for nearly each article and pair of blocks.
SHARES, AT_ONCE = 64, 1 << 16


def _firsts(rows: np.ndarray, known: np.ndarray, keep: int) -> np.ndarray:
    """Which of ``rows`` are remembered, sorted by fingerprint and then by time: the first of each, and again the first that comes over ``keep`` seconds after the last remembered; ``known`` ones are in any case."""
    first = np.ones(len(rows), bool)
    same = np.zeros(len(rows), bool)
    same[1:] = (rows["hi"][1:] == rows["hi"][:-1]) & (rows["lo"][1:] == rows["lo"][:-1])
    since, times, held = 0, rows["at"].tolist(), known.tolist()
    for i in np.flatnonzero(same).tolist():
        if not same[i - 1]:
            since = times[i - 1]
        if held[i] or times[i] - since > keep:
            since = times[i]
        else:
            first[i] = False
    return first


def _met(rows: np.ndarray, known: np.ndarray, keep: int) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Which of ``rows`` are remembered, and places (older, newer) in ``rows`` of remembered ones and of those that come up to ``keep`` seconds after them with the values of their blocks; pairs of ``known`` ones were told before."""
    by_face = np.lexsort((rows["id"], rows["at"], rows["lo"], rows["hi"]))
    first = np.empty(len(rows), bool)
    first[by_face] = _firsts(rows[by_face], known[by_face], keep)
    order = np.lexsort((rows["id"], rows["at"], rows["kl"], rows["kh"]))
    kh, kl, at = (rows[c][order] for c in ("kh", "kl", "at"))
    changes = np.ones(len(order), bool)
    changes[1:] = (kh[1:] != kh[:-1]) | (kl[1:] != kl[:-1])
    value = np.cumsum(changes)
    span = int(at.max() - at.min()) + keep + 1
    spot = value * span + (at - at.min())  # in order; values are further apart than ``keep``
    kept = np.flatnonzero(first[order])
    low, high = np.searchsorted(spot[kept], spot - keep), np.searchsorted(kept, np.arange(len(order)))
    count = np.where(known[order], 0, np.maximum(high - low, 0))

    def told() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ends = np.cumsum(count)
        begin = 0
        while begin < len(count):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + AT_ONCE, "right")))
            n = count[begin:end]
            newer = np.repeat(np.arange(begin, end), n)
            older = kept[np.repeat(low[begin:end] - np.cumsum(n) + n, n) + np.arange(len(newer))]
            yield order[older], order[newer]
            begin = end

    return first, told()


def near_fingerprints(stream: DataFrame, masks: list[tuple[int, int]], far: int, keep: int = DAY, shares: int = SHARES) -> DataFrame:
    """(older, newer, distance) of a stream (id, at, hi, lo), ``at`` in seconds: each article with the first of each fingerprint up to ``far`` bits away.

    An article may come up to ``keep`` seconds late. One that is older than some of its
    blocks' values that came before it is compared by itself.
    """
    high, low = (np.array([m[side] for m in masks], np.int64) for side in (0, 1))
    names = list(FACE.names)

    def near(older: np.ndarray, newer: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs that are near and whose first pair of equal blocks is this one, and their distances."""
        x, y = older["hi"] ^ newer["hi"], older["lo"] ^ newer["lo"]
        distance = np.bitwise_count(x) + np.bitwise_count(y)
        at = np.flatnonzero(distance <= far)
        first = ((x[at, None] & high | y[at, None] & low) == 0).argmax(axis=1)
        at = at[first == m]
        return at, distance[at]

    def late(fresh: np.ndarray, held: np.ndarray, m: int, found: list) -> np.ndarray:
        """Row by row, what is then remembered; ``held`` and ``fresh`` have the values of some blocks."""
        for row in np.sort(fresh, order=["at", "id"]):
            there = np.flatnonzero((held["kh"] == row["kh"]) & (held["kl"] == row["kl"]) & (row["at"] - held["at"] <= keep))
            others = held[there]
            at, far_ = near(others, np.broadcast_to(row, others.shape), m)
            for i, x in zip(at.tolist(), far_.tolist(), strict=True):
                first, last = sorted([(int(others[i]["at"]), int(others[i]["id"])), (int(row["at"]), int(row["id"]))])
                if first[1] != last[1]:
                    found.append((np.array([first[1]]), np.array([last[1]]), np.array([float(x)])))
            if not ((others["hi"] == row["hi"]) & (others["lo"] == row["lo"])).any():
                held = np.append(held, row)
        return held

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = np.frombuffer(state.get[0], FACE) if state.exists else np.empty(0, FACE)
        parts = [b for b in batches if len(b)]  # this trigger's rows of one share
        fresh = np.empty(sum(map(len, parts)), FACE)
        for c in names:
            fresh[c] = np.concatenate([b[c].to_numpy() for b in parts])
        found: list[tuple] = []
        newest = max(int(fresh["at"].max()), int(held["at"].max()) if len(held) else 0)
        slow = np.empty(0, FACE)
        if len(held) and fresh["at"].min() < held["at"].max():  # some came late: their values go row by row
            values = lambda rows: np.ascontiguousarray(rows[["kh", "kl"]].copy()).astype([("kh", "<i8"), ("kl", "<i8")])
            last = {}
            for kh, kl, at in held[["kh", "kl", "at"]].tolist():
                last[kh, kl] = max(at, last.get((kh, kl), at))
            behind = {(kh, kl) for kh, kl, at in fresh[["kh", "kl", "at"]].tolist() if at < last.get((kh, kl), at)}
            if behind:
                is_late = lambda rows: np.array([tuple(v) in behind for v in values(rows).tolist()], bool)
                old, new = is_late(held), is_late(fresh)
                slow = late(fresh[new], held[old], key[0], found)
                held, fresh = held[~old], fresh[~new]
        rows = np.concatenate([held, fresh])
        if len(fresh):
            first, told = _met(rows, np.arange(len(rows)) < len(held), keep)
            for older, newer in told:
                at, distance = near(rows[older], rows[newer], key[0])
                a, b = rows["id"][older[at]], rows["id"][newer[at]]
                two = a != b
                found.append((a[two], b[two], distance[two].astype(np.float64)))
            rows = rows[first]
        rows = np.concatenate([rows, slow])
        rows = rows[newest - rows["at"] <= 2 * keep]
        state.update((rows.tobytes(),))
        state.setTimeoutDuration(keep * 1000)
        yield pd.DataFrame({c: np.concatenate([f[i] for f in found]) if found else np.empty(0) for i, c in enumerate(("older", "newer", "distance"))}).astype({"older": "int64", "newer": "int64", "distance": "float64"})

    pick = lambda side: F.element_at(F.array(*(F.lit(m[side]).cast("long") for m in masks)), F.col("m") + 1)
    keyed = stream.select("id", "at", "hi", "lo", F.explode(F.array(*(F.lit(i) for i in range(len(masks))))).alias("m"))
    keyed = keyed.select("m", F.col("hi").bitwiseAND(pick(0)).alias("kh"), F.col("lo").bitwiseAND(pick(1)).alias("kl"), "hi", "lo", "id", "at")
    keyed = keyed.withColumn("share", F.pmod(F.xxhash64("kh", "kl"), F.lit(shares)).cast("int"))
    return keyed.groupBy("m", "share").applyInPandasWithState(run, LINK, "held binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def near_vectors(stream: DataFrame, least: float, size: int, keep: int = SHORT, tables: int = 48, bits: int = 6, seed: int = 7) -> DataFrame:
    """(older, newer, distance) of a stream (id, at, embedding) of vectors of this size, ``distance`` their cosine: 48 tables of 6 bits miss a pair at 0.67 once in two thousand."""
    planes = np.random.default_rng(seed).standard_normal((tables, bits, size))

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for id_, at, vector in batch.itertuples(index=False):
                x = np.asarray(vector, np.float64)
                length = np.linalg.norm(x)
                if length:
                    x = x / length
                    codes = ((planes @ x > 0) << np.arange(bits)).sum(axis=1)
                    out += [(t, int(c), x.astype("<f8").tobytes(), id_, at) for t, c in enumerate(codes)]
            yield pd.DataFrame(out, columns=["t", "code", "vector", "id", "at"])

    def compare(key: tuple, row, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        x, others = np.frombuffer(row.vector, "<f8"), np.ascontiguousarray(held["vector"]).view("<f8").reshape(len(held), size)
        sims = others @ x
        at = np.flatnonzero(sims > least)
        mine, theirs = planes @ x > 0, np.einsum("tbd,nd->ntb", planes, others[at]) > 0
        first = (mine == theirs).all(axis=2).argmax(axis=1) if len(at) else at  # the first table with one signature
        at = at[first == key[0]]
        return at, sims[at], True

    face = np.dtype([("vector", f"V{8 * size}"), ("id", "<i8"), ("at", "<i8")])
    keyed = stream.select("id", "at", "embedding").mapInPandas(signed, "t int, code long, vector binary, id long, at long")
    return keyed.groupBy("t", "code").applyInPandasWithState(_remembering(face, keep, compare), LINK, "held binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def settled(batch: DataFrame, before: DataFrame) -> DataFrame:
    """(id, kept) of the newer articles of ``batch`` (older, newer), given the decisions ``before`` (id, kept) of earlier batches: one that went links no more."""
    known = before.groupBy("id").agg(F.min("kept").alias("kept"))
    links = batch.select("older", "newer").distinct().join(known.select(F.col("id").alias("older"), F.col("kept").alias("stays")), "older", "left")
    links = links.where(F.coalesce("stays", F.lit(True))).select("older", "newer")
    gone = dropped(links).select("id", F.lit(False).alias("gone"))
    every = batch.select(F.col("newer").alias("id")).distinct()
    return every.join(gone, "id", "left").select("id", F.coalesce("gone", F.lit(True)).alias("kept"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, decide: bool = False) -> StreamingQuery:
    """Append what has arrived to ``path``, a folder a batch, which a batch tried again replaces; with ``decide`` the decisions on a batch of links, in view of those before."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        out = batch
        if decide:
            try:
                before = spark.read.schema("id long, kept boolean, batch int").parquet(path).where(F.col("batch") < number).select("id", "kept")
            except Exception as e:  # noqa: BLE001
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                before = spark.createDataFrame([], "id long, kept boolean")
            out = settled(batch.persist(), before)
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    before = spark.conf.get(EMPTY, "true")
    spark.conf.set(EMPTY, "false")  # state that times out asks for batches without data, of which there is no end
    try:
        return stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(EMPTY, before)
