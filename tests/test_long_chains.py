"""Chains of links: the driver's plans stay small however many rounds there are, and ranges of links are settled as by a plain loop."""

import random

import pytest

from marlstone.operators import dedup
from marlstone.plans import events
from tests.test_dedup import plain


def guess(df):
    """The planner's guess of the size of ``df`` in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_guessed_sizes_do_not_grow_with_rounds(spark):
    """Each round multiplied the guesses before: a number whose digits doubled, which filled the driver."""
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "older long, newer long")
    assert guess(dedup.components(links)) < 1e9
    assert guess(events.last_ancestors(links.select(links.newer.alias("id"), links.older.alias("parent")))) < 1e9


@pytest.mark.parametrize("most", [7, 40, 1000])
def test_ranges_in_turn(spark, most):
    rnd = random.Random(most)
    chain = [(i, i + 1) for i in range(60)]
    near = [(a, a + rnd.randrange(1, 9)) for a in (rnd.randrange(100, 200) for _ in range(150))]
    far = [tuple(sorted(rnd.sample(range(300), 2))) for _ in range(60)]
    links = chain + near + far
    got = [r.id for r in dedup.dropped(spark.createDataFrame(links, "older long, newer long"), rounds=0, most=most).collect()]
    assert sorted(got) == sorted(plain({i for pair in links for i in pair}, links))
