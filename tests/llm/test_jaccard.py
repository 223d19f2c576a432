import random

import pytest

from marlstone.llm.components import components
from marlstone.llm import jaccard
from marlstone.llm.jaccard import likely_depth, ngram_jaccard_join, one_of_each
from tests.llm.words import thue_morse_words


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, threshold):
    sets = [shingles(t) for _, t in rows]
    links = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 10 * threshold * len(sets[i] | sets[j]) - 1e-7] for i in range(len(rows))]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        label[i] = min(rows[j][0] for j in seen)
    return sorted((rows[i][0], label[i], len(links[i])) for i in range(len(rows)))


def made(seed):
    rnd = random.Random(seed)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "one two"), (5, "one\ttwo"), (6, "one two three")]
    for d in range(10, 40):
        words = [f"w{rnd.randrange(900)}" for _ in range(rnd.randrange(60, 160))]
        rows.append((d * 100, " ".join(words)))
        for k in range(rnd.randrange(5)):
            copy = list(words)
            for _ in range(k):
                copy[rnd.randrange(len(copy))] = "edited"
            rows.append((d * 100 - k - 1, rnd.choice([" ", "\n"]).join(copy)))
    rows += [rows[12], rows[12]]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("tile", [2, 512])
def test_matches_brute_force(spark, tile):
    rows = made(tile)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class_id string").repartition(3)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_jaccard_join(df, tile=tile).collect())
    want = brute(rows, 0.8)
    assert len(got) == len(want)
    assert sum(a != b for a, b in zip(got, want, strict=True)) <= 0.02 * len(want)
    assert sum(n > 0 for _, _, n in want) > 40


def test_depth_follows_the_recall():
    assert likely_depth(0.8, 0.995) == 5
    assert likely_depth(0.8, 0.9) == 8 and likely_depth(0.8, 0.9999999) < 5


def edited(rnd, words, edits):
    copy = list(words)
    for at in rnd.sample(range(len(copy)), edits):
        copy[at] = "edited"
    return " ".join(copy)


def test_measured_depth_and_recall_of_queries_against_all_rows(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAST_LINKS", 20)
    rnd = random.Random(8)
    near, far = [], []
    for d in range(0, 4000, 50):
        words = [f"w{rnd.randrange(4000)}" for _ in range(120)]
        near += [(d, " ".join(words)), (d + 1, edited(rnd, words, 1))]  # similarities of 0.9 and more
        far += [(d, " ".join(words)), (d + 1, edited(rnd, words, 2)), (d + 2, edited(rnd, words, rnd.choice([1, 2])))]
    depths = []
    for rows in (near, far):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        signed = jaccard.sign(df).withColumnRenamed("doc_id", "rep")
        depths.append(jaccard.measured_depth(signed, df, 0.8, 0.97))
        got = {r.doc_id: r.n_links for r in ngram_jaccard_join(df, recall=0.97).collect()}
        want = {i: n for i, _, n in brute(rows, 0.8)}
        queries = [i for i in want if i % 50 == 0]
        assert sum(got[i] for i in queries) >= 0.9 * sum(want[i] for i in queries) > 0
    assert depths[0] >= depths[1] > jaccard.SHALLOWEST


def test_repeated_ids_lose_no_link_and_no_text(spark):
    rnd = random.Random(3)
    a, b = ([f"{c}{rnd.randrange(900)}" for _ in range(80)] for c in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a) + " x"), (3, " ".join(b) + " y"), (3, " ".join(b) + " y"), (4, None), (4, None), (None, " ".join(a)), (5, "other words")]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, id_ string, rep int").repartition(3)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in ngram_jaccard_join(df).collect()), key=str)
    assert got == sorted([(1, 1, 1), (1, 1, 2), (2, 1, 1), (3, 1, 2), (3, 1, 2), (4, 4, 0), (4, 4, 0), (None, None, 0), (5, 5, 0)], key=str)
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([rows[0], rows[1], rows[5], rows[5], rows[7], rows[8]], key=str)


def test_components(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges if e[0] != e[1] for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert got == label


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_jaccard_join(empty).count() == 0 and one_of_each(empty).count() == 0


def test_words_that_a_polynomial_takes_for_one_make_no_link(spark):
    a, b = thue_morse_words()
    around = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*around[:30], x, *around[30:]])) for k, x in enumerate((a, b, a))] + [(9, "long " * 400_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_jaccard_join(df, threshold=0.95, depth=1).collect())
    assert got == [(0, 0, 1), (1, 1, 0), (2, 0, 1), (9, 9, 0)]
    linked = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_jaccard_join(df, threshold=0.8, depth=1).collect())
    assert linked == [(0, 0, 2), (1, 0, 2), (2, 0, 2), (9, 9, 0)]
