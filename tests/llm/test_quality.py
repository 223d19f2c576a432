import random
import re

import numpy as np
import pytest
import zstandard

from marlstone.llm.common import Rolling
from marlstone.llm.quality import Bands, quality_rules, twice
from tests.llm.words import thue_morse_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def test_counts_match_brute_force(spark):
    rnd = random.Random(5)
    texts = [None, "", " ", "a", "é b c d\x1ce", "x y\nx y\n \nx y", "w " * 30]
    for _ in range(60):
        vocabulary = [f"w{i}é" for i in range(rnd.choice([2, 5, 500]))]
        texts.append("".join(rnd.choice(vocabulary) + rnd.choice([" ", "\n", "\t ", " # "]) for _ in range(rnd.randrange(120))))
    rows = [(i, t, "extra") for i, t in enumerate(texts)] + [(3, "a", "extra")]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, n_words string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[1:7]) == brute(texts[r.doc_id]), texts[r.doc_id]
        assert not (r.base_failed and r.kept)


def brute_verdict(text, bands):
    """The method's verdict, chunk by chunk."""
    data = (text or "").encode()
    size = lambda x: len(zstandard.ZstdCompressor(level=bands.level).compress(x))
    low, high = next((a, b) for below, a, b in bands.limits if len(data) < below)
    if not data or not low <= size(data) / len(data) <= high:
        return False
    bad, at = 0, 0
    while len(data) >= bands.chunk_bytes and at < len(data):
        end = min(at + bands.chunk_bytes, len(data))
        if not bands.chunk_low <= size(data[end - bands.chunk_bytes : end]) / bands.chunk_bytes <= bands.chunk_high:
            bad += end - at
        at = end
    return bad <= bands.bad_chunk_share * len(data)


def test_verdicts_match_brute_force(spark):
    rnd = random.Random(12)
    parts = [a + b for a in "bcdfghlmnprst" for b in ("a", "e", "on", "ing")]
    prose = lambda n: " ".join("".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 5))) for _ in range(n))
    noise = lambda n: "".join(chr(rnd.randrange(33, 0x2FF)) for _ in range(n))
    texts = [None, "", prose(10)] + [prose(rnd.randrange(20, 3000)) + noise(rnd.choice([0, 0, 300, 4000])) + "ab " * rnd.choice([0, 0, 50, 3000]) for _ in range(60)]
    got = quality_rules(spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, prose(30))], "doc_id long, text string")).collect()
    verdicts = [(r.kept, not r.base_failed and brute_verdict(texts[r.doc_id], Bands())) for r in got if r.doc_id is not None]
    assert all(a == b for a, b in verdicts) and 10 < sum(a for a, _ in verdicts) < 55


def test_bands(spark):
    rnd = random.Random(1)
    parts = [a + b for a in "bcdfghlmnprst" for b in ("a", "e", "on", "ing")]
    prose = " ".join("".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 5))) for _ in range(400))
    noise = " ".join("".join(chr(rnd.randrange(33, 0x2FF)) for _ in range(9)) for _ in range(400))
    boring = " ".join(f"{i} {i % 3}" for i in range(2000))
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame([(1, prose), (2, noise), (3, boring)], "doc_id long, text string")).collect()}
    assert got[1].kept and not got[2].kept and not got[3].kept
    assert not got[2].base_failed and not got[3].base_failed


def test_tail_under_a_chunk_is_judged(spark):
    rnd = random.Random(3)
    parts = [a + b for a in "bcdfghlmnprst" for b in ("a", "e", "on", "ing")]
    prose = " ".join("".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 5))) for _ in range(6000))
    junk = "".join(f"{i} {i % 3} " for i in range(2000))
    rows = [(n, prose[: 4096 * n] + junk[:4095]) for n in (1, 4)] + [(11, prose[: 4096 * 10 + 1]), (12, prose[:8191]), (13, prose[:4095])]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[n].n_chunks, got[n].n_bad_chunks, got[n].kept) for n in (1, 4)] == [(2, 1, False), (5, 1, False)]
    assert [(got[n].n_chunks, got[n].n_bad_chunks, got[n].kept) for n in (11, 12, 13)] == [(11, 0, True), (2, 0, True), (0, 0, True)]
    assert not any(got[n].base_failed for n in got)


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [0, 63, 64, 10**6])
def test_every_length_has_a_band(n):
    low, high = Bands().band(n)
    assert low < high


def test_windows_that_differ_in_a_word_a_polynomial_confuses(spark):
    a, b = thue_morse_words()
    texts = [" ".join([*"1234567", a, *(f"w{i}" for i in range(20)), *"1234567", x]) for x in (a, b)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].n_repeat_words for i in (0, 1)] == [16, 0] and not got[1].base_failed


@pytest.mark.parametrize("base", [1, 0x9E3779B97F4A7C15])
def test_repeats_are_told_whatever_the_hash(base):
    rnd = random.Random(3)
    numbers = np.array([rnd.randrange(3) for _ in range(4000)], np.uint64)
    grams = [tuple(numbers[i : i + 8].tolist()) for i in range(len(numbers) - 7)]
    times = {g: grams.count(g) for g in set(grams)}
    assert twice(numbers, Rolling(base)).tolist() == [times[g] > 1 for g in grams]


def test_a_very_long_text(spark):
    words = [f"word{i}" for i in range(300_000)]
    text = " ".join(words + words[:100])
    (got,) = quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (got.n_words, got.n_repeat_words, got.n_chunks) == (300_100, 200, -(-len(text) // 4096))
