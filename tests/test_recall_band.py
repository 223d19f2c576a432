"""The band of vector_recall, as its SQL first had it."""

from marlstone.plans import relational


def test_band_of_the_query():
    assert (relational.LOW, relational.HIGH) == (0.1, 0.9) and "sim >= 0.1 AND sim < 0.9" in relational.ORACLES["vector_recall"]
