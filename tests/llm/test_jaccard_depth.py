"""The prefix that must match follows from the threshold and the recall, not from some rows."""

from marlstone.llm import jaccard


def test_no_rows_are_measured_for_the_depth(spark, monkeypatch):
    def fail(*args):
        raise AssertionError("a sample decided")

    monkeypatch.setattr(jaccard, "measured_depth", fail)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:40] + [f"x{i}"])) for i in range(3)] + [(9, " ".join(words[20:]))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (0, 2), 1: (0, 2), 2: (0, 2), 9: (9, 0)}
