import hashlib
import random
import re

import numpy as np
import pytest

from marlstone.llm.substrings import WINDOW, Windows, dedup_substrings
from tests.llm.words import thue_morse_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    docs = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in docs:
        for i in range(len(w) - WINDOW + 1):
            key = tuple(w[i : i + WINDOW])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in docs:
        gone = {i + k for i in range(len(w) - WINDOW + 1) if first[tuple(w[i : i + WINDOW])] < d for k in range(WINDOW)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def made(seed):
    rnd = random.Random(seed)
    prose = lambda n: [f"w{rnd.randrange(3000)}é" for _ in range(n)]
    shared = [prose(n) for n in (49, 50, 51, 80, 200)]
    rows = [(0, None), (1, ""), (2, " \n ")]
    for d in range(3, 60):
        words = prose(rnd.randrange(0, 150))
        for _ in range(rnd.randrange(3)):
            words += rnd.choice(shared) + prose(rnd.randrange(20))
        rows.append((d * 7 - 100, rnd.choice([" ", "\n", "  "]).join(words)))
    rows += [(500, rows[20][1]), (501, rows[20][1]), (-500, rows[21][1]), (502, "same " * 120), (503, "same " * 70), (504, "x\x1cy " * 60)]
    rows += [rows[30], rows[31]]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("cells", [1 << 16, 1 << 20])
def test_matches_brute_force(spark, cells):
    rows = made(cells)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_words string").repartition(4)
    got = dedup_substrings(df, cells)
    assert sorted(tuple(r)[:4] for r in got.collect()) == brute(rows)


def test_windows_that_differ_in_a_word_a_polynomial_confuses(spark):
    a, b = thue_morse_words()
    around = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*around[:30], x, *around[30:]])) for k, x in enumerate((a, b, a))] + [(9, " ".join(around[:25] + [b] + around[31:56]))]
    rows += [(20, " ".join([a, b, b, a] * 13)), (21, " ".join([b, a, a, b] * 13)), (22, " ".join([a, b] * 26))]
    assert sorted(tuple(r)[:4] for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), 1 << 16).collect()) == brute(rows)


def test_anchors_are_sliding_minima():
    w = Windows()
    h = np.random.default_rng(1).integers(0, 1 << 63, 300).astype(np.uint64)
    g = w.first(h, 25)
    assert (w.anchors(h) == [g[i : i + 26].min() for i in range(251)]).all()
    assert len(w.anchors(h[:50])) == 1


def test_null_ids_and_a_long_text(spark):
    prose = " ".join(f"w{i}" for i in range(60))
    rows = [(None, prose), (None, prose), (1, prose), (2, "x " * 5 + prose), (3, " ".join(f"v{i}" for i in range(200_000)) + " " + prose)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, first int")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in dedup_substrings(df).collect()), key=str)
    assert got == sorted([(None, 60, 0), (None, 60, 0), (1, 60, 0), (2, 65, 60), (3, 200_060, 60)], key=str)


def test_empty_table(spark):
    assert dedup_substrings(spark.createDataFrame([], "doc_id long, text string"), 1 << 16).count() == 0
