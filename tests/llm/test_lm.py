import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from marlstone.llm import lm
from marlstone.llm.common import Words
from tests.llm.words import thue_morse_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, order, least):
    docs = [(d, WORD.findall(t or "")) for d, t in rows]
    counts = Counter(tuple(w[i : i + k]) for _, w in docs for k in range(1, order + 1) for i in range(len(w) - k + 1))
    total = sum(len(w) for _, w in docs)

    def s(context, word):
        gram = (*context, word)
        if not context:
            return counts[gram] / total
        if counts[gram] >= least:
            return counts[gram] / counts[context]
        return 0.4 * s(context[1:], word)

    return sorted(((d, len(w), sum(math.log10(s(tuple(w[max(0, i - order + 1) : i]), x)) for i, x in enumerate(w)) or 0.0) for d, w in docs), key=str)


def made():
    rnd = random.Random(11)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "once")]
    rows += [(d, rnd.choice([" ", "\n\t"]).join(rnd.choices(["a", "b", "c", "dé", "e", f"w{d}"], k=rnd.randrange(60)))) for d in range(4, 60)]
    return rows + [rows[10], rows[10], (99, rows[11][1])]


@pytest.mark.parametrize(("order", "least", "sizes"), [(1, 2, (100, 100, 30)), (2, 2, (1000, 50, 1 << 20)), (3, 2, (500, 200, 20, 3)), (4, 1, (1 << 20, 1 << 20, 40)), (3, 2, (1 << 20, 1 << 20, 1 << 20))])
def test_matches_brute_force(spark, tmp_path, order, least, sizes):
    rows = [*made(), (None, "a b c a b"), (12, "a b c d e"), (12, "a b")]
    path = str(tmp_path / "d")
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_words string").repartition(3).write.parquet(path)
    got = sorted(((r.doc_id, r.n_words, r.log10_score or 0.0) for r in lm.score_corpus(spark.read.parquet(path), order, least, *sizes).collect()), key=str)
    want = brute(rows, order, least)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(math.isclose(g[2], w[2], rel_tol=1e-9, abs_tol=1e-9) for g, w in zip(got, want, strict=True))


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(con.execute(lm.SQL).fetchall())
    got = sorted(tuple(r) for r in lm.query(spark, "/root/testdata/sf0.001").collect())
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and (g[2] is None) == (w[2] is None)
        assert g[2] is None or (math.isclose(g[2], w[2], abs_tol=2e-4) and math.isclose(g[3], w[3], abs_tol=2e-6))


def test_input_out_of_a_shuffle(spark):
    rows = [(i, f"a b c w{i % 3}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert lm.score_corpus(df).where("n_words = 4 and log10_score < 0").count() == 50


def test_long_texts_are_cut_with_their_context():
    words = [f"w{i % 7}" for i in range(1000)]
    text = " ".join(words).encode()
    found = list(lm.pieces(text, 3, 50))
    assert len(found) > 20 and max(len(p) for _, p in found) < 70
    assert [w for head, piece in found for w in piece.split()[head:]] == text.split()
    assert all(head == 2 for head, _ in found[1:])
    at = 0
    for head, piece in found:
        mine = piece.split()
        assert mine == text.split()[at - head : at + len(mine) - head]
        at += len(mine) - head
    assert list(lm.pieces(b"", 3)) == [(0, b"")] and list(lm.pieces(b"aaaa bb cccc d", 1, 3)) == [(0, b"aaaa"), (0, b" bb"), (0, b" cccc"), (0, b" d")]


def test_packed_numbers():
    x = np.array([0, 1, 255, 256, (1 << 64) - 1, 1 << 40], np.uint64)
    assert (lm.unpacked(lm.packed(x)) == x).all() and len(lm.unpacked(lm.packed(x[:0]))) == 0


def test_word_hashes():
    texts = [b" one two\tone ", None, b"", b"one " + b"x" * 5000 + b"\x0btwo"]
    for most in (0, 2, 1 << 17):
        hashes, sizes = Words(most).of_texts(texts)
        assert sizes.tolist() == [3, 0, 0, 3]
        assert hashes[0] == hashes[2] == hashes[3] and hashes[1] == hashes[5] and len(set(hashes.tolist())) == 3
    many = [f"w{i}".encode() for i in range(50_000)]
    assert len(set(Words().of_texts([b" ".join(many)])[0].tolist())) == 50_000


def test_words_that_a_polynomial_takes_for_one(spark):
    a, b = thue_morse_words()
    assert len(set(Words().of_texts([a.encode() + b" " + b.encode()])[0].tolist())) == 2
    rows = [(1, f"{a} x {b}"), (2, f"{b} x {a}"), (3, f"{a} {a} {b}")]
    got = sorted((r.doc_id, r.n_words, r.log10_score) for r in lm.score_corpus(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert all(g[:2] == w[:2] and math.isclose(g[2], w[2], rel_tol=1e-9) for g, w in zip(got, brute(rows, 3, 2), strict=True))


def test_empty_table(spark):
    assert lm.score_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0
