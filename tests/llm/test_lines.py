import hashlib
import random
import re
import string

import pytest

from marlstone.llm.lines import dedup_lines

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, least=10, documents=2):
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line).translate(LOWER)
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [d is not None and len(h := holders.get(key(x), ())) >= documents and d > min(h) for x in lines]
        out.append((d, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return sorted(out, key=str)


def made(seed, n=80):
    rnd = random.Random(seed)
    prose = lambda: "".join(rnd.choice("abÀé ßZq\U0001f600") for _ in range(rnd.randrange(4, 16)))
    common = [prose() for _ in range(12)] + ["0123456789", "012345678", "ÀÀÀÀÀÀÀÀÀÀ", "àààààààààà", "Abcdefghij", "aBcdefghij"]
    around = ["", " ", "\t", "\x0b\x0c", "\r", "\x1c", "\xa0"]
    rows = [(0, None), (1, ""), (2, "\n"), (3, "\n\n \n"), (None, "Abcdefghij\nabcdefghij"), (None, None)]
    for d in range(4, n):
        lines = [rnd.choice(around) + (rnd.choice(common) if rnd.random() < 0.6 else prose()) + rnd.choice(around) for _ in range(rnd.randrange(0, 9))]
        rows.append((d * 3 - 50, "\n".join(lines)))
    rows += [rows[20], rows[20], (rows[21][0], rows[22][1]), (-90, rows[23][1])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("least", "documents"), [(10, 2), (1, 2), (10, 3)])
def test_matches_brute_force(spark, least, documents):
    rows = made(least + documents)
    df = spark.createDataFrame([(*r, b"x", 1) for r in rows], "doc_id long, text string, row binary, first int").repartition(5)
    got = dedup_lines(df, least, documents)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, least, documents)


def test_a_long_text_and_a_hot_line(spark):
    long = "\n".join(f"line number {i % 60_000} of many" for i in range(120_000))
    rows = [(9, long), (1, "LINE number 7 of many\n" * 3), *((d, "the line of all\nmine alone %d!" % d) for d in range(10, 400))]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_lines, got[1].n_dropped) == (4, 0)
    assert (got[9].n_lines, got[9].n_dropped) == (120_000, 2)
    assert hashlib.sha256(got[9].kept.encode()).digest() == hashlib.sha256("\n".join(x for x in long.split("\n") if x != "line number 7 of many").encode()).digest()
    assert sum(got[d].n_dropped for d in range(10, 400)) == 389 and got[10].kept == rows[2][1]


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plan_runs_no_python(spark):
    plan = dedup_lines(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
