"""Pairs found by bounds, prefixes and signatures against all pairs."""

import random
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import dedup, pairs
from tests.test_dedup import plain


def titles(n, seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdefgh é") for _ in range(rnd.randrange(5, 60))) for _ in range(n // 4)]
    out = []
    for i in range(n):
        t = list(rnd.choice(base))
        for _ in range(rnd.randrange(12)):
            t[rnd.randrange(len(t))] = rnd.choice("abcdefgh🙂")
        out.append((i, "".join(t)[rnd.randrange(3) :] or "x", rnd.randrange(20_000)))
    return sorted((k, t, at) for k, (at, t) in enumerate(sorted((at, t) for _, t, at in out)))


@pytest.mark.parametrize(("ratio", "tile"), [(0.5, 7), (0.6, 256), (0.9, 20)])
def test_title_links_are_those_of_all_pairs(spark, ratio, tile):
    rows = titles(160, tile)
    want = set()
    for (i, a, s), (j, b, t) in combinations(rows, 2):
        held = a in b or b in a
        if s <= t and t - s <= 7200 and (held or SequenceMatcher(None, b, a).ratio() > ratio):
            want.add((i, j, held))
    got = [tuple(r) for r in pairs.title_links(spark.createDataFrame(rows, "id long, t string, first long"), ratio, tile=tile).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10


def test_bounds_never_cut_a_pair_that_is_alike():
    rnd = random.Random(2)
    for _ in range(400):
        a, b = ("".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 30))) for _ in range(2))
        ratio = SequenceMatcher(None, a, b).ratio()
        assert 2 * pairs.common_length(a, b) >= ratio * (len(a) + len(b)) - 1e-9
        if ratio > 0.5 or a in b or b in a:
            assert pairs.possible([b], [a], 0.5)[0, 0]
    assert pairs.common_length("abcbdab", "bdcaba") == 4 and pairs.common_length("", "x") == 0


def test_rare_grams_lose_no_pair(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.randrange(4), sorted({f"g{int(rnd.random() ** 2 * 30)}" for _ in range(rnd.randrange(1, 15))})) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, slot long, grams array<string>")
    for least in (0.3, 0.5, 0.8):
        got = {tuple(r) for r in pairs.prefix_candidates(df, least).collect()}
        want = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and b[1] in (a[1], a[1] + 1) and len(set(a[2]) & set(b[2])) > least * len(set(a[2]) | set(b[2]))}
        assert want <= got and len(got) < 120 * 119


def vectors(seed, n=1500, size=48):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, size))
    for i in range(n // 3, n):  # turned away from an earlier one by some angle
        j, angle = rng.integers(n // 3) // 50 * 50, rng.uniform(0.3, 1.2)
        u = x[j] / np.linalg.norm(x[j])
        w = x[i] - (x[i] @ u) * u
        x[i] = 3 * (np.cos(angle) * u + np.sin(angle) * w / np.linalg.norm(w))
    x[5] = x[4]
    x[7] = 0
    return x


def test_recall_of_signatures(spark):
    x = vectors(1)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedding array<double>").repartition(4)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    sims = unit @ unit.T
    want = {(q, i) for q in range(0, len(x), 50) for i in range(len(x)) if i != q and 0.5 <= round(sims[q, i], 8) < 0.67}
    got = {(r.query_id, r.id): r.sim for r in pairs.similar_vectors(df.where("id % 50 = 0"), df, 0.5, 0.67).collect()}
    assert set(got) <= want and len(got) >= 0.9 * len(want) and len(want) > 60
    assert all(abs(s - sims[k]) < 1e-7 for k, s in got.items())
    best = pairs.similar_vectors(df.where("id % 50 = 0"), df, 0.5, 0.67, top=2).groupBy("query_id").agg(F.count("*").alias("n"), F.min("sim").alias("low")).collect()
    for r in best:
        mine = sorted((s for (q, _), s in got.items() if q == r.query_id), reverse=True)
        assert r.n == min(2, len(mine)) and r.low == mine[r.n - 1]


def test_copies_of_a_vector_share_a_signature(spark):
    x = vectors(3, 200)
    rows = [(i, [float(v) for v in x[i]]) for i in range(0, 200, 50)] + [(1000 + k, [float(v) for v in 2 * x[0]]) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = pairs.similar_vectors(df.where("id < 1000"), df, 0.9, 1.1, top=3).where("query_id = 0").collect()
    assert [r.id for r in sorted(got, key=lambda r: r.id)] == [1000, 1001, 1002]


def test_near_vectors_within_a_time(spark):
    x = vectors(5, 600)
    df = spark.createDataFrame([(i, i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, at long, embedding array<double>")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    want = {(i, j) for i in range(600) for j in range(i + 1, min(600, i + 301)) if unit[i] @ unit[j] > 0.67}
    got = {(r.older, r.newer) for r in pairs.near_vectors(df, 0.67, 300).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 20


def test_tables_follow_the_recall():
    # At 0.9 a bit differs in 0.1436 of all cases, so one table finds a pair with 0.1557 + 0.3132 + 0.2889; 0.2422 to the fourth is under 0.01.
    assert pairs.tables_for(0.5, 0.99, 12, 2) == 24 and pairs.tables_for(0.9, 0.99, 12, 2) == 4
    assert pairs.tables_for(0.5, 0.999, 12, 2) > pairs.tables_for(0.67, 0.999, 12, 2)


@pytest.mark.parametrize("most", [0, 30, 100_000])
def test_long_chains_are_settled(spark, most):
    rnd = random.Random(most)
    links = [(i, i + 1) for i in range(40)] + [tuple(sorted(rnd.sample(range(100, 160), 2))) for _ in range(60)] + [(200, i) for i in range(201, 215)]
    df = spark.createDataFrame(links, "older long, newer long")
    got = [r.id for r in dedup.dropped(df, rounds=2, most=most).collect()]
    assert sorted(got) == sorted(plain({i for pair in links for i in pair}, links))


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 103), (103, 101), (60, 61)]
    got = {r.id: r.label for r in dedup.components(spark.createDataFrame(links, "older long, newer long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 60: 60, 61: 60, 100: 100, 101: 100, 103: 100}


def test_common_lengths_of_many_pairs_are_those_of_each():
    rnd = random.Random(5)
    older = ["".join(rnd.choice("abcdeé你") for _ in range(n)) for n in (0, 1, 63, 64, 65, 120, 128, 129, 200)] + ["a" * 64, "a" * 130]
    newer = ["".join(rnd.choice("abcxyé好") for _ in range(n)) for n in (0, 1, 40, 64, 100, 128, 190)] + ["a" * 64, "a" * 140, "zzz"]
    i, j = (x.ravel() for x in np.meshgrid(range(len(older)), range(len(newer)), indexing="ij"))
    want = [pairs.common_length(older[a], newer[b]) for a, b in zip(i, j, strict=True)]
    assert pairs.common_lengths(older, newer, i, j).tolist() == want
    assert pairs.common_lengths(older, newer, i[:0], j[:0]).tolist() == []
