import random

import numpy as np

from marlstone.llm.decontaminate import Lsh, Scanner, edit_distance, find_leaks, plain_word


def slow_distance(item, words):
    """Least edits to any stretch, by the textbook table."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def plain(text):
    return [w for w in map(plain_word, (text or "").split()) if w]


def edited(rnd, words, k):
    words = list(words)
    for _ in range(k):
        at, kind = rnd.randrange(len(words)), rnd.randrange(3)
        if kind == 0:
            words[at] = "typo"
        elif kind == 1:
            words.insert(at, "more")
        elif len(words) > 1:
            del words[at]
    return words


def test_edit_distance():
    rnd = random.Random(2)
    for _ in range(200):
        a = [rnd.randrange(4) for _ in range(rnd.randrange(1, 9))]
        b = [rnd.randrange(4) for _ in range(rnd.randrange(0, 14))]
        assert edit_distance(np.array(a), np.array(b, int))[0] == slow_distance(a, b)


def test_leaks_against_brute_force(spark):
    rnd = random.Random(4)
    common = ["the", "of", "and", "to", "in"]
    prose = lambda n: [rnd.choice(common) if rnd.random() < 0.5 else f"w{rnd.randrange(800)}" for _ in range(n)]
    items = [(i, " ".join(prose(rnd.randrange(12, 60)))) for i in range(40)] + [(90, None), (91, ""), (92, "too short")]
    items.append((93, items[5][1].upper() + "!!"))
    docs = [(0, None), (1, ""), (2, "... !!! |")]
    for d in range(3, 220):
        words = prose(rnd.randrange(5, 120))
        if d % 2:
            item = items[rnd.randrange(40)][1].split()
            at = rnd.randrange(len(words))
            words[at:at] = edited(rnd, item, rnd.randrange(0, int(0.3 * len(item))))
        docs.append((d, rnd.choice([" ", "\n", " | "]).join(w.title() if rnd.random() < 0.2 else w + rnd.choice(["", ","]) for w in words)))
    docs.append(docs[5])
    want = {(d, i): e for d, t in docs for i, x in items if len(plain(x)) >= 5 and (e := slow_distance(plain(x), plain(t))) <= int(0.2 * len(plain(x)))}
    got = find_leaks(spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), share=0.2, block_words=700).collect()
    found = {(r.doc_id, r.item_id): r.edits for r in got}
    assert all(want[k] == e for k, e in found.items())
    assert len(want) > 60 and len(found) >= 0.95 * len(want)
    exact = {k for k, e in want.items() if e == 0}
    assert exact and exact <= found.keys()
    texts = dict(docs)
    for r in got:
        if r.edits == 0:
            assert plain(texts[r.doc_id][r.start : r.stop]) == plain(dict(items)[r.item_id])


def leak_count(items, rnd, tries, **options):
    """How many of ``tries`` edits of each item, at the largest distance, are found, and the tables."""
    vocabulary = {}
    coded = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in x], np.int64) for x in items]
    lsh = Lsh(coded, [[i] for i in range(len(items))], vocabulary, 0.2, **options).fit()
    owner = [i for i in range(len(items)) for _ in range(tries)]
    texts = [" ".join(["before"] * 9 + edited(rnd, items[i], int(0.2 * len(items[i]))) + ["after"] * 9).encode() for i in owner]
    got = {(d, item) for d, item, *_ in Scanner(lsh).leaks(texts)}
    return [sum((d, i) in got for d, o in enumerate(owner) if o == i) for i in range(len(items))], lsh


def test_short_items_do_not_hide_long_ones():
    rnd = random.Random(6)
    items = [[f"w{rnd.randrange(3000)}" for _ in range(n)] for n in [8] * 300 + [400] * 4]
    found, lsh = leak_count(items, rnd, 20)
    assert sum(found[300:]) >= 0.97 * 80
    assert all(lsh.reached[n] >= lsh.recall or n in lsh.exact for n in lsh.lengths)


def test_lengths_held_exactly_lose_nothing():
    rnd = random.Random(7)
    items = [[rnd.choice("abcdefgh") if rnd.random() < 0.3 else f"w{rnd.randrange(300)}" for _ in range(n)] for n in (5, 10, 15, 40, 40, 200)]
    found, lsh = leak_count(items, rnd, 15, recall=1.1)
    assert lsh.exact == {5, 10, 15, 40, 200} and found == [15] * 6


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert find_leaks(none, items).count() == 0
    assert find_leaks(spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string"), items.limit(0)).count() == 0
    assert find_leaks(spark.createDataFrame([(1, "x a b c d e f")], "doc_id long, text string"), items).count() == 1
