"""The closest earlier title of another source: tiles of pairs against all pairs by hand."""

import random

import pytest

from marlstone.operators import pairs
from marlstone.plans import relational
from marlstone.sources.adapters import news

SF = "/root/testdata/sf0.001"


def grams(t):
    return {t[i : i + 3] for i in range(max(len(t) - 2, 1))}


def test_shared_trigrams_are_those_of_sets():
    titles = ["a", "ab", "a\0", "a\0\0", "abc", "abcabcabc", "bank cuts rates", "bank raises rates", "央行宣布降息", "央行宣布加息", "😀😀😀😀b", "ab"]
    common, a, b = pairs.shared_trigrams(titles, titles[::-1], at_once=3)
    assert common.tolist() == [[len(grams(x) & grams(y)) for y in titles[::-1]] for x in titles]
    assert a.tolist() == [len(grams(x)) for x in titles] == b.tolist()[::-1]
    assert pairs.shared_trigrams(["xyz"], ["abc"])[0].tolist() == [[0]]


@pytest.mark.parametrize("tile", [3, 1024])
def test_no_pair_is_lost(spark, tile):
    rng = random.Random(3)
    words = ["bank", "rates", "cut", "rise", "oil", "降息"]
    rows = [(i, rng.choice(["s", "t", "u", None]), 100 * rng.randrange(40) - 1000, rng.random() < 0.6, " ".join(rng.choices(words, k=rng.randrange(1, 5)))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, source string, published long, root boolean, t string")
    got = {(r.newer, r.older, r.sim) for r in pairs.closest_titles(df, 0.5, 600, tile).collect()}
    want = set()
    for i, source, at, root, t in rows:
        found = [(-len(grams(t) & grams(u)) / len(grams(t) | grams(u)), j) for j, other, then, _, u in rows if None not in (source, other) and other != source and 0 < at - then < 600]
        if root and found and min(found)[0] < -0.5:
            want.add((i, min(found)[1], -min(found)[0]))
    assert got == want and len(want) > 50


def test_titles_do_not_meet_a_gram_at_a_time(spark):
    plan = relational.QUERIES["band_join"](spark, SF)._jdf.queryExecution().toString()
    assert "gram" not in plan and "FlatMapGroupsInPandas" in plan


def test_texts_stay_where_they_are_when_labels_are_joined(spark):
    """A join that shuffles carries titles, not the texts that they come from."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = news(spark, SF).select("id", "title", "ai_score")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join, below = plan.split("Join LeftOuter", 1)
    assert "regexp_extract" in below and "regexp_extract" not in join
