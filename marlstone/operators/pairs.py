"""Pairs of similar titles and vectors: bounds before exact tests, tables of signatures before cosines, and tiles of all queries by all rows where a band is too far off for signatures."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import combinations
from math import acos, ceil, comb, log, pi

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import settle

#: Members of a tile at most, on the average; a tile pair is one unit of work.
TILE = 256
#: Vectors of a tile, on the average, and queries compared at a time.
VECTORS, AT_ONCE = 8192, 1024
#: Titles of a tile that are compared by trigrams, on the average.
CLOSE = 1024


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit a character of ``a``: no ordered matching is longer."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def alike(a: str, b: str, ratio: float) -> bool:
    """Whether one title holds the other, or their ratio of matching characters is above ``ratio``; ``a`` is the newer one."""
    if a in b or b in a:
        return True
    if 2 * common_length(a, b) <= ratio * (len(a) + len(b)):
        return False
    return SequenceMatcher(None, a, b).ratio() > ratio


def _histograms(titles: list[str], bins: int = 64) -> np.ndarray:
    """Characters of each title in bins: the sum of the lesser counts is no less than the characters that match."""
    out = np.zeros((len(titles), bins), np.int32)
    for i, t in enumerate(titles):
        np.add.at(out[i], np.frombuffer(t.encode("utf-32-le"), np.uint32) % bins, 1)
    return out


def possible(older: list[str], newer: list[str], ratio: float) -> np.ndarray:
    """Which pairs (older, newer) may be alike, by their lengths and characters; none that is alike is left out."""
    a, b = _histograms(older), _histograms(newer)
    la, lb = np.array([len(t) for t in older]), np.array([len(t) for t in newer])
    most = np.zeros((len(older), len(newer)), np.int32)
    for k in range(a.shape[1]):
        if a[:, k].any() and b[:, k].any():
            most += np.minimum(a[:, k, None], b[None, :, k])
    bound = 2 * most > ratio * (la[:, None] + lb[None, :])
    return bound | (most >= np.minimum(la[:, None], lb[None, :]))  # what holds another title has all its characters


def common_lengths(older: list[str], newer: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``common_length`` of the pairs older[i], newer[j], a character of all newer ones at a time."""
    sizes = np.array([len(t) for t in newer], np.int64)
    order = np.argsort(-sizes[j], kind="stable")  # those that are through come last
    i, j = i[order], j[order]
    flat = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in older]
    known = np.unique(np.concatenate(flat)) if flat else np.empty(0, np.uint32)
    words = max(1, -(-max(map(len, older), default=0) // 64))
    where = np.zeros((words, len(older), len(known) + 1), np.uint64)  # in the last column, what no older title has
    for t, codes in enumerate(flat):
        at = np.arange(len(codes))
        np.bitwise_or.at(where, (at // 64, t, np.searchsorted(known, codes)), np.uint64(1) << (at % 64).astype(np.uint64))
    where = where.reshape(words, -1)
    columns = np.full((sizes.max(initial=0), len(newer)), len(known), np.int64)
    for t, title in enumerate(newer):
        codes = np.frombuffer(title.encode("utf-32-le"), np.uint32)
        place = np.searchsorted(known, codes)
        found = place < len(known)
        found[found] = known[place[found]] == codes[found]
        columns[: len(codes), t] = np.where(found, place, len(known))
    start, left = i * (len(known) + 1), sizes[j]
    rows = np.full((words, len(i)), ~np.uint64(0))
    for k in range(len(columns)):
        n = int(np.searchsorted(-left, -k, "left"))  # pairs with more than k characters
        if not n:
            break
        spot = start[:n] + columns[k, j[:n]]
        carry = None
        for w in range(words):
            row = rows[w, :n]
            hit = row & where[w].take(spot)
            total = row + hit
            over = total < hit
            if carry is not None:
                total = total + carry
                over |= total < carry
            carry = over.astype(np.uint64) if w + 1 < words else None
            rows[w, :n] = total | (row & ~hit)
    out = np.empty(len(i), np.int64)
    out[order] = np.bitwise_count(~rows).sum(axis=0)
    return out


def _linked(ratio: float, within: int):
    def run(unit: pd.DataFrame) -> pd.DataFrame:
        older, newer = unit[unit["left"]], unit[unit["right"]]
        ids, firsts, owns = (tuple(side[c].to_numpy() for side in (older, newer)) for c in ("id", "first", "own"))
        may = (ids[1] > ids[0][:, None]) & (firsts[1] >= firsts[0][:, None]) & (firsts[1] - firsts[0][:, None] <= within)
        if (unit["i"] != unit["j"]).any():  # then pairs of one tile belong to another unit
            may &= owns[1] != owns[0][:, None]
        (of_older, before), (of_newer, titles) = (pd.factorize(side["t"]) for side in (older, newer))  # equal titles are compared once
        before, titles = before.tolist(), titles.tolist()
        p, q = np.nonzero(may)
        asked = np.zeros((len(before), len(titles)), bool)
        asked[of_older[p], of_newer[q]] = True
        i, j = np.nonzero(asked & possible(before, titles, ratio))
        sizes = [np.array([len(t) for t in side], np.int64) for side in (before, titles)]
        common, a, b = common_lengths(before, titles, i, j), sizes[0][i], sizes[1][j]
        much = 2 * common > ratio * (a + b)
        near = much | (common >= np.minimum(a, b))  # one that holds the other has it in common
        alike, holds = np.zeros(asked.shape, bool), np.zeros(asked.shape, bool)
        for x, y, more in zip(i[near].tolist(), j[near].tolist(), much[near].tolist(), strict=True):
            holds[x, y] = held = before[x] in titles[y] or titles[y] in before[x]
            alike[x, y] = held or (more and SequenceMatcher(None, titles[y], before[x]).ratio() > ratio)
        spot = of_older[p], of_newer[q]
        found = alike[spot]
        return pd.DataFrame({"older": ids[0][p[found]], "newer": ids[1][q[found]], "held": holds[spot][found]})

    return run


def title_links(titles: DataFrame, ratio: float, within: int = 7200, tile: int = TILE) -> DataFrame:
    """(older, newer, held) of titles (id, t, first) that came within so many seconds of each other and are alike; ``held``: one title holds the other.

    Each slot of ``within`` seconds is dealt into tiles by a hash of the id. Pairs of
    tiles of one slot, and of a slot and the next, are units of work in which bounds by
    characters come before the exact test; only links leave a unit.
    """
    slotted = titles.select("id", "t", "first", F.floor(F.col("first") / within).alias("slot"))
    sizes = settle(slotted.groupBy("slot").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")))
    later = sizes.select((F.col("slot") - 1).alias("slot"), F.col("tiles").alias("next_tiles"))
    before = sizes.select((F.col("slot") + 1).alias("slot"), F.col("tiles").alias("tiles_before"))
    dealt = slotted.join(sizes, "slot").join(later, "slot", "left").join(before, "slot", "left")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    upto = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    unit = lambda span, i, j, left, right: F.struct(span.alias("span"), i.alias("i"), j.alias("j"), F.lit(left).alias("left"), F.lit(right).alias("right"))
    slot, own = F.col("slot"), F.col("own")
    in_slot = F.transform(upto(F.col("tiles")), lambda j: unit(2 * slot, F.least(own, j), F.greatest(own, j), True, True))
    with_next = F.transform(upto(F.col("next_tiles")), lambda j: unit(2 * slot + 1, own, j, True, False))
    with_last = F.transform(upto(F.col("tiles_before")), lambda i: unit(2 * slot - 1, i, own, False, True))
    units = dealt.select("id", "t", "first", "own", F.explode(F.concat(in_slot, with_next, with_last)).alias("u")).select("id", "t", "first", "own", "u.*")
    units = units.withColumn("own", F.when(F.col("span") % 2 != 0, F.when(F.col("left"), -1).otherwise(-2)).otherwise(F.col("own")))
    return units.groupBy("span", "i", "j").applyInPandas(_linked(ratio, within), "older long, newer long, held boolean")


def trigrams(titles: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(title, gram) of the distinct runs of three characters of each title, three code points in a number; a shorter title is a gram of its own."""
    sizes = np.array([len(t) for t in titles], np.int64)
    codes = np.frombuffer("".join(titles).encode("utf-32-le"), np.uint32).astype(np.int64) + 1  # 0 stands for no character
    row = np.repeat(np.arange(len(titles)), sizes)
    place = np.arange(len(codes)) - (np.cumsum(sizes) - sizes)[row]
    ahead = lambda k: np.where(place + k < sizes[row], np.append(codes, np.zeros(k, np.int64))[k:], 0)
    first = place <= np.maximum(sizes[row] - 3, 0)
    known, which = np.unique((codes << 42 | ahead(1) << 21 | ahead(2))[first], return_inverse=True)
    both = np.unique(row[first] * len(known) + which)
    return both // max(len(known), 1), known[both % max(len(known), 1)]


def shared_trigrams(older: list[str], newer: list[str], at_once: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many trigrams each pair (older, newer) has in common, and how many each title has; products of matrices over ``at_once`` trigrams at a time."""
    (i, a), (j, b) = trigrams(older), trigrams(newer)
    met = np.intersect1d(a, b)
    common = np.zeros((len(older), len(newer)), np.float32)
    for start in range(0, len(met), at_once):
        part = met[start : start + at_once]
        sides = []
        for n, row, gram in ((len(older), i, a), (len(newer), j, b)):
            spot = np.minimum(np.searchsorted(part, gram), len(part) - 1)
            held = part[spot] == gram
            side = np.zeros((n, len(part)), np.float32)
            side[row[held], spot[held]] = 1
            sides.append(side)
        common += sides[0] @ sides[1].T
    return common.astype(np.int64), np.bincount(i, minlength=len(older)), np.bincount(j, minlength=len(newer))


def _closest(least: float, band: int):
    def run(unit: pd.DataFrame) -> pd.DataFrame:
        older, newer = unit[~unit["newer"]], unit[unit["newer"]]
        if older.empty or newer.empty:  # a tile that no row was dealt to
            return pd.DataFrame({"newer": [], "older": [], "sim": []})
        common, a, b = shared_trigrams(older["t"].tolist(), newer["t"].tolist())
        sim = common / (a[:, None] + b - common)
        ids, at = (tuple(side[c].to_numpy() for side in (older, newer)) for c in ("id", "published"))
        sources = pd.factorize(pd.concat([older["source"], newer["source"]]))[0]
        apart = at[1] - at[0][:, None]
        sim[(sources[len(older) :] == sources[: len(older), None]) | (apart <= 0) | (apart >= band)] = -1
        best = sim.max(axis=0)
        first = np.where(sim == best, ids[0][:, None], np.iinfo(np.int64).max).min(axis=0)
        found = best > least
        return pd.DataFrame({"newer": ids[1][found], "older": first[found], "sim": best[found]})

    return run


def closest_titles(rows: DataFrame, least: float, band: int, tile: int = CLOSE) -> DataFrame:
    """(newer, older, sim) of rows (id, source, published, root, t): for each root the title of another source less than ``band`` seconds before it that shares the largest part of its trigrams, if more than ``least``; of equal ones that of the smallest id.

    The roots of a slot of ``band`` seconds meet all rows of it and of the slot before,
    a tile of each at a time; only the best of each root leaves a unit.
    """
    slot = F.floor(F.col("published") / band)
    role = lambda at, newer: F.struct(at.alias("at"), F.lit(newer).alias("newer"))
    roles = F.array(role(slot, False), role(slot + 1, False))
    roles = F.when(F.col("root"), F.concat(roles, F.array(role(slot, True)))).otherwise(roles)
    dealt = rows.where("source IS NOT NULL").select("id", "source", "published", "t", F.explode(roles).alias("r")).select("id", "source", "published", "t", "r.*")
    tiles = lambda newer: F.ceil(F.count(F.when(F.col("newer") == newer, 1)) / tile).cast("int")
    sizes = settle(dealt.groupBy("at").agg(tiles(False).alias("olders"), tiles(True).alias("newers")).where("olders > 0 AND newers > 0"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    units = dealt.join(sizes, "at").withColumn("i", F.explode(F.when(F.col("newer"), each("olders")).otherwise(F.array(own("olders")))))
    units = units.withColumn("j", F.explode(F.when(F.col("newer"), F.array(own("newers"))).otherwise(each("newers"))))
    found = units.groupBy("at", "i", "j").applyInPandas(_closest(least, band), "newer long, older long, sim double")
    best = found.groupBy("newer").agg(F.max_by(F.struct("older", "sim"), F.struct("sim", -F.col("older"))).alias("best"))
    return best.select("newer", "best.older", "best.sim")


def prefix_candidates(rows: DataFrame, least: float, *, slot: str = "slot") -> DataFrame:
    """(older, newer) of rows (id, slot, grams) of one slot or the next that share one of their rarest grams.

    A pair whose sets have a Jaccard similarity above ``least`` shares one of the first
    |A| - ceil(least * |A|) + 1 grams of either in any common order; rare ones come first,
    so that few rows meet. No pair above the limit is lost.
    """
    grams = rows.select("id", slot, F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = grams.join(counts, "gram").groupBy("id", slot).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("order"))
    keep = F.col("n") - F.ceil(F.col("n") * least) + 1
    index = ranked.select("id", slot, F.explode(F.transform(F.slice("order", 1, keep.cast("int")), lambda x: x["gram"])).alias("gram"))
    near = index.select(F.col("id").alias("older"), F.explode(F.array(F.col(slot), F.col(slot) + 1)).alias(slot), "gram")
    return near.join(index.select(F.col("id").alias("newer"), slot, "gram"), [slot, "gram"]).where("older != newer").select("older", "newer").distinct()


def tables_for(cosine: float, recall: float, bits: int, radius: int) -> int:
    """Tables of random hyperplanes that find a pair of this cosine with the wanted probability, where queries look at all signatures up to ``radius`` bits away."""
    differ = acos(cosine) / pi
    one = sum(comb(bits, k) * differ**k * (1 - differ) ** (bits - k) for k in range(radius + 1))
    return max(1, ceil(log(1 - recall) / log(1 - one)))


def _signatures(tables: int, bits: int, flips: list[int], seed: int):
    """(key, table, code) of vectors (key, embedding); with ``flips`` each code is sent with these bits changed."""
    change = np.array(flips, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = part.column(1).to_pylist()
                if not rows:
                    continue
                x = np.array(rows, np.float64)
                if planes is None:
                    planes = np.random.default_rng(seed).standard_normal((x.shape[1], tables * bits))
                codes = ((x @ planes > 0).reshape(len(x), tables, bits) << np.arange(bits)).sum(axis=2)
                sent = (codes[:, :, None] ^ change).reshape(-1)
                each = tables * len(change)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(x)), each))), pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), len(change)), len(x))), pa.array(sent)], ["key", "table", "code"])

    return run


def cosine_candidates(queries: DataFrame, rows: DataFrame, cosine: float, recall: float = 0.99, bits: int = 12, radius: int = 2, seed: int = 7) -> DataFrame:
    """(query, key) of vectors (key, slot, embedding) of one slot that share a signature in some table, or have one within ``radius`` bits of the query's."""
    tables = tables_for(cosine, recall, bits, radius)
    flips = [sum(1 << b for b in which) for k in range(radius + 1) for which in combinations(range(bits), k)]
    kinds = "key struct<id:long,slot:long>, table int, code long"
    sent = lambda df, flips: df.select(F.struct(F.col("key").cast("long").alias("id"), F.col("slot").cast("long").alias("slot")).alias("key"), "embedding").mapInArrow(_signatures(tables, bits, flips, seed), kinds).select("key.id", "key.slot", "table", "code")
    asked = sent(queries, flips).withColumnRenamed("id", "query")
    return asked.join(sent(rows, [0]).withColumnRenamed("id", "key"), ["slot", "table", "code"]).select("query", "key").distinct()


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def _in_band(low: float, high: float, top: int | None):
    """(query, key, sim) of a tile of queries and one of rows whose cosine may round into [low, high), of the best ``top`` + 1 of each query and what may equal them where given.

    A product of matrices tells which pairs may count; their cosines are then added up in the order of the vector, as SQL does.
    """
    slack = 4e-8  # more than rounding to 8 digits and another order of the sum change

    def vectors(tile: pa.Table) -> np.ndarray:
        return np.array(tile.column("embedding").combine_chunks().flatten(), np.float64).reshape(tile.num_rows, -1)

    def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.cumsum(x * y, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if asked.num_rows and held.num_rows:
            a, b = vectors(asked), vectors(held)
            la, lb = np.sqrt(dots(a, a)), np.sqrt(dots(b, b))
            ua, ub = a / np.where(la == 0, 1, la)[:, None], b / np.where(lb == 0, 1, lb)[:, None]
            for start in range(0, len(a), AT_ONCE):
                near = ua[start : start + AT_ONCE] @ ub.T
                least = np.full(len(near), low - slack)
                if top and near.shape[1] > top:
                    sure = np.where((near >= low + slack) & (near < high - slack), near, -np.inf)
                    least = np.maximum(least, np.partition(sure, -top - 1, axis=1)[:, -top - 1] - slack)
                left, right = np.nonzero((near >= least[:, None]) & (near < high + slack))
                for k in range(0, len(left), 1 << 16):
                    i, j = left[k : k + (1 << 16)] + start, right[k : k + (1 << 16)]
                    sizes = la[i] * lb[j]
                    found.append((i, j, np.where(sizes == 0, 0, dots(a[i], b[j]) / np.where(sizes == 0, 1, sizes))))
        i, j, sims = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"query": asked.column("n").take(pa.array(i)), "key": held.column("n").take(pa.array(j)), "sim": sims})

    return run


def similar_vectors(queries: DataFrame, rows: DataFrame, low: float, high: float, top: int | None = None, tile: int = VECTORS) -> DataFrame:
    """(query_id, id, sim) of vectors (id, embedding) whose cosine, to 8 digits, is in [low, high), the best ``top`` of each query where given; a row is not compared with itself.

    All queries are compared with all rows, a tile of each at a time. Equal vectors are
    one row there; each stands for its ``top`` + 1 least ids (for all of them without ``top``).
    """
    doubles = F.transform("embedding", lambda x: x.cast("double")).alias("embedding")
    whole = lambda df: df.select("id", doubles).where("embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)")
    mine = settle(whole(queries)).withColumn("n", F.monotonically_increasing_id())
    held = whole(rows)
    if top:
        held = held.withColumn("place", F.row_number().over(Window.partitionBy("embedding").orderBy("id"))).where(F.col("place") <= top + 1)
    told = settle(held.groupBy("embedding").agg(F.collect_list("id").alias("ids"))).withColumn("n", F.monotonically_increasing_id())
    i, j = (max(1, ceil(df.count() / tile)) for df in (mine, told))  # two numbers reach the driver
    tiles = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("n"), F.lit(n)).cast("int")
    dealt = lambda df, a, b: df.select("n", "embedding", a.alias("i"), b.alias("j"), F.size("embedding").alias("size")).groupBy("i", "j", "size")
    met = dealt(mine, deal(i), tiles(j)).cogroup(dealt(told, tiles(i), deal(j))).applyInArrow(_in_band(low, high, top), "query long, key long, sim double")
    met = met.withColumn("sim", F.round("sim", 8)).where((F.col("sim") >= low) & (F.col("sim") < high))
    named = met.join(mine.select(F.col("n").alias("query"), F.col("id").alias("query_id")), "query").join(told.select(F.col("n").alias("key"), "ids"), "key")
    each = named.select("query_id", F.explode("ids").alias("id"), "sim").where("query_id != id")
    if top is None:
        return each
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "id"))
    return each.withColumn("place", place).where(F.col("place") <= top).drop("place")


def near_vectors(vectors: DataFrame, least: float, within: int, recall: float = 0.99) -> DataFrame:
    """(older, newer, cosine) of vectors (id, at, embedding) at most ``within`` apart in ``at`` whose cosine is above ``least``; the older has the smaller id."""
    slotted = vectors.withColumn("slot", F.floor(F.col("at") / within))
    asked = slotted.select(F.col("id").alias("key"), F.explode(F.array("slot", F.col("slot") + 1)).alias("slot"), "embedding")
    found = cosine_candidates(asked, slotted.select(F.col("id").alias("key"), "slot", "embedding"), least, recall)
    pairs = found.select(F.least("query", "key").alias("older"), F.greatest("query", "key").alias("newer")).where("older < newer").distinct()
    side = lambda name: vectors.select(F.col("id").alias(name), F.col("at").alias(f"{name}_at"), F.col("embedding").alias(f"{name}_vector"))
    both = pairs.join(side("older"), "older").join(side("newer"), "newer").where(F.abs(F.col("newer_at") - F.col("older_at")) <= within)
    return both.select("older", "newer", cosine(F.col("older_vector"), F.col("newer_vector")).alias("cosine")).where(F.col("cosine") > least)
