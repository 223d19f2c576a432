"""First come, first kept, against a plain loop; bits of near fingerprints against all masks."""

import random
from difflib import SequenceMatcher
from itertools import combinations

from marlstone.operators import dedup
from marlstone.plans import refinement


def plain(ids, links):
    gone, older = set(), {}
    for a, b in links:
        older.setdefault(b, []).append(a)
    for i in sorted(ids):
        if any(a not in gone for a in older.get(i, [])):
            gone.add(i)
    return gone


def test_first_come_first_kept(spark):
    rnd = random.Random(3)
    links = [tuple(sorted(rnd.sample(range(60), 2))) for _ in range(70)] + [(100, 101), (101, 102), (102, 103), (100, 101)]
    got = {r.id for r in dedup.dropped(spark.createDataFrame(links, "older long, newer long")).collect()}
    assert got == plain(set(range(60)) | {100, 101, 102, 103}, links)
    assert 101 in got and 102 not in got and 103 in got
    assert dedup.dropped(spark.createDataFrame([], "older long, newer long")).count() == 0


def test_short_lane(spark):
    pairs = [(1, 2, "drop"), (2, 3, "drop"), (1, 4, "link"), (2, 4, "link"), (2, 5, "link"), (3, 5, "link")]
    out = dedup.short_lane(spark.createDataFrame([(i,) for i in range(1, 7)], "id long"), spark.createDataFrame(pairs, "older long, newer long, action string"))
    assert sorted(map(tuple, out.collect())) == [(1, True, None), (2, False, None), (3, True, None), (4, True, 1), (5, True, 3), (6, True, None)]


def test_long_lane(spark):
    classes = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)], "id long, class_id long")
    links = spark.createDataFrame([(1, 3)], "older long, newer long")
    terms = spark.createDataFrame([(3, 4), (2, 5), (4, 5)], "older long, newer long")
    assert sorted(map(tuple, dedup.long_lane(classes, links, terms).collect())) == [(1, 1, True), (2, 1, False), (3, 3, False), (4, 4, True), (5, 5, False)]


def test_similar_titles(spark):
    titles = ["abcdef", "abc", "abcxyz", "uvwxyz", "fedcba"]
    rows = [(i, j, titles[i], titles[j], titles[i] in titles[j] or titles[j] in titles[i]) for i, j in combinations(range(5), 2)]
    got = {tuple(r) for r in dedup.similar_titles(spark.createDataFrame(rows, "older long, newer long, a string, b string, within boolean")).collect()}
    assert got == {(i, j) for i, j, a, b, w in rows if w or SequenceMatcher(None, b, a).ratio() > 0.5}


def test_masks_find_all_near_fingerprints():
    rnd = random.Random(5)
    masks = refinement.masks()
    assert len(masks) == 21
    for _ in range(500):
        flips = sum(1 << b for b in rnd.sample(range(64), refinement.FAR))
        assert any(not flips >> 32 & hi and not flips & 0xFFFFFFFF & lo for hi, lo in masks)


def test_near_texts_have_near_fingerprints(spark, tmp_path):
    words = [f"word{i}" for i in range(40)]
    texts = {0: " ".join(words) + ".", 1: " ".join(words) + ".", 2: " ".join(words[:-1] + ["other"]) + ".", 3: " ".join(f"else{i}" for i in range(40)) + "."}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))  # the lane's last step finds no copies by vector
    found = {r.id: (r.hi, r.lo) for r in refinement.QUERIES["simhash"](spark, str(tmp_path)).collect()}
    far = lambda a, b: sum(bin(x ^ y).count("1") for x, y in zip(found[a], found[b], strict=True))
    assert far(0, 1) == 0 and far(0, 2) < 16 < far(0, 3)
    kept = {r.id: r.kept for r in refinement.long_lane(spark, str(tmp_path)).collect()}
    assert kept[0] and not kept[1] and not kept[2] and kept[3]


def test_votes_are_those_of_all_tokens(spark):
    """Told by arrays, a batch at a time; lambdas over 64 bits a token took most of the time of all that uses fingerprints."""
    from hashlib import md5

    from marlstone.operators import fingerprints

    rows = [(i, 60 * i, [f"w{(i * k) % 17}é" for k in range(i % 9)]) for i in range(700)] + [(700, 1, None)]
    found = fingerprints.faces(spark.createDataFrame(rows, "id long, published long, ts array<string>")).collect()

    def side(tokens, at):
        own = [int(md5(t.encode()).hexdigest()[at : at + 8], 16) for t in tokens]  # noqa: S324
        return sum(1 << b for b in range(32) if sum(1 if x >> b & 1 else -1 for x in own) > 0)

    assert sorted(map(tuple, found)) == [(i, at, side(ts, 0), side(ts, 8)) for i, at, ts in rows if ts]
    assert fingerprints.faces(spark.createDataFrame(rows[:1], "id long, published long, ts array<string>")).count() == 0


def test_fingerprints_are_no_folds_of_lambdas(spark):
    for name in ("simhash", "simhash_pairs", "simhash_classes"):
        plan = refinement.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "aggregate(" not in plan, name
